import numpy as np

from refweave.llm.elias_fano import Sequence, encode


def test_get_and_find():
    rng = np.random.default_rng(1)
    for n, bound in [(0, 10), (1, 1), (1, 1 << 63), (5, 6), (1000, 1 << 20), (3000, (1 << 64) - 1), (4000, 4500), (2000, 1 << 40)]:
        pool = rng.integers(0, bound, size=n * 2, dtype=np.uint64) if n else np.zeros(0, np.uint64)
        if n == 2000:  # one dense context
            pool = np.concatenate([pool, np.arange(1000, dtype=np.uint64) + np.uint64(12345)])
        values = np.unique(pool)
        s = Sequence(encode(values, bound))
        assert (s.get(np.arange(len(values))) == values).all()
        ask = np.concatenate([values, rng.integers(0, bound, size=500, dtype=np.uint64)])
        place = {int(v): k for k, v in enumerate(values)}
        assert s.find(ask).tolist() == [place.get(int(v), -1) for v in ask]


def test_repeated_numbers():
    values = np.array([0, 3, 3, 3, 9, 9], np.uint64)
    assert Sequence(encode(values, 10)).get(np.arange(6)).tolist() == values.tolist()
