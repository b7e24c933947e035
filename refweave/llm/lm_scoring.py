"""Language-model scoring with an n-gram trie in Elias-Fano levels.

Level 1 holds the words of the training texts, by 64-bit hash, in sorted order; a word's
number is its place. Level k holds all k-grams of the training texts (``MIN_COUNT`` is 1), each as the monotone number
``place of its first k-1 words in level k-1 * V + last word``: the upper part is the monotone pointer to the
context, and a lookup is a successor search relative to the context's range. Levels are cut
into shards by ranges of these numbers; a shard is a file of flat arrays, memory-mapped by
every task that reads it: the numbers and the running sums of their counts in Elias-Fano
form, a byte for each quantised smoothed log probability, and a byte for each context's
quantised back-off weight.

Smoothing is interpolated absolute discounting: p(w | c) = (n(cw) - D) / n(c) + b(c) p(w | shorter c)
with b(c) the mass that the k-grams of c leave; words have
p = (n + 0.5) / (N + 0.5 (V + 1)), which unknown ones share. A k-gram that is seen
has its parts seen as often, so every level finds its lower ones.

A first pass over the texts counts hashed words, summed within each task before they are shuffled as numbers; a second one turns
all texts into word numbers, checkpointed, from which each level is counted: tasks sum sorted runs and send them, packed, to
the shards. A level's shards are cut by the counts of its contexts, not by their number, into about ``SHARD`` training tokens each. A
context that alone has more (a very common word) gets shards of its own, by ranges of the next word; their merged
runs wait in the checkpointed table of shards until the sums of all of them are known, from which follows the context's back-off weight. So no
task holds more n-grams than about twice ``SHARD``, and none holds the vocabulary; the driver keeps the list of shards.
Files lie in the shared folder under names of their own attempt and are moved into place whole, so lost tasks repeat. Executors that
cannot map the shared folder copy the shards that they read into Spark's own folder of the executor, which goes with it.

Limits: 2^32 - 2 distinct words, and 2^64 possible numbers (contexts times words) in a level; more raise an error.

Cases: a null or empty text is its end token alone; without training texts every word is
unknown; repeated rows and ids count and are scored each; null ids have the remainder of the empty text, 0, and are trained
on; ties don't matter, as counts alone decide; very long texts are whole (their words are held at once, a few bytes each); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.llm.common import bounded, bucket_of, cut, shared_dir, table
from refweave.llm.elias_fano import Sequence, encode

ORDER = 3
MIN_COUNT = 1
DISCOUNT = 0.75
SHARD = 2_000_000
#: Tokens that a task handles at once, and n-grams (words in the first pass) that it sums before it sends a run.
BATCH_TOKENS = 500_000
RUN = 2_000_000
#: Marks of running counts in each shard, by which the next level is cut: one for each GRAINth of a shard's tokens.
GRAIN = 8
#: Quantisation: codes are sixteenths of a decade below 1.
STEP = 1 / 16

_U = np.uint64
#: A blank is no word.
_END = xxhash.xxh64_intdigest(b" ")


def _code(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-log10 / STEP), 0, 255).astype(np.uint8)


def _plain(code: np.ndarray) -> np.ndarray:
    return code * -STEP


def _local(folder: str) -> tuple[fs.FileSystem, str, bool]:
    store, root = fs.FileSystem.from_uri(folder)
    return store, root, isinstance(store, fs.LocalFileSystem)


def save_arrays(folder: str, arrays: dict[str, np.ndarray]) -> tuple[str, str]:
    """Writes the arrays to one file; its name and the layout."""
    store, root, _ = _local(folder)
    store.create_dir(root, recursive=True)
    name, layout, at = uuid.uuid4().hex, [], 0
    with store.open_output_stream(f"{root}/{name}.part", compression=None) as out:
        for key, x in arrays.items():
            data = np.ascontiguousarray(x).tobytes()
            pad = -len(data) % 8
            out.write(data + bytes(pad))
            layout.append(f"{key}:{x.dtype.str}:{at}:{len(x)}")
            at += len(data) + pad
    store.move(f"{root}/{name}.part", f"{root}/{name}")
    return name, ",".join(layout)


def map_arrays(folder: str, name: str, layout: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; a file of a remote store is copied to the executor first."""
    store, root, local = _local(folder)
    path = f"{root}/{name}"
    if not local:
        path = os.path.join(SparkFiles.getRootDirectory(), name)
        if not os.path.exists(path):
            with store.open_input_stream(f"{root}/{name}", compression=None) as src, open(f"{path}.{uuid.uuid4().hex}", "wb") as out:
                while block := src.read(1 << 20):
                    out.write(block)
            os.replace(out.name, path)
    data = np.memmap(path, np.uint8, "r")
    out = {}
    for item in layout.split(","):
        key, kind, at, n = item.split(":")
        out[key] = data[int(at) :][: int(n) * np.dtype(kind).itemsize].view(kind)
    return out


@dataclass
class Level:
    """Shards of a level in the order of their first number."""

    folder: str
    starts: np.ndarray  # first number that a shard may hold, relative to which its numbers are kept
    contexts: np.ndarray  # first context of each shard
    offsets: np.ndarray  # place of each shard's first number
    files: list[tuple[str, str]]
    size: int  # of all shards
    marks: np.ndarray  # places at which running counts pass a grain
    hot: dict[int, int]  # counts above a shard's, by place
    _open: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_open": {}}

    def shard(self, k: int) -> dict:
        if k not in self._open:
            a = map_arrays(self.folder, *self.files[k])
            self._open[k] = a | {"numbers": Sequence({x: a[f"n_{x}"] for x in ("low", "bits", "before", "head")}), "sums": Sequence({x: a[f"s_{x}"] for x in ("low", "bits", "before", "head")})}
        return self._open[k]

    def _by_shard(self, of: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        which = np.searchsorted(starts, of, side="right") - 1
        order = np.argsort(which.astype(np.int16) if len(starts) < 1 << 15 else which, kind="stable")  # numbers of 16 bits are sorted by their digits
        cuts = np.flatnonzero(np.diff(which[order])) + 1
        for part in np.split(order, cuts):
            if len(part) and which[part[0]] >= 0:
                yield int(which[part[0]]), part

    def find(self, numbers: np.ndarray) -> np.ndarray:
        """Places of the numbers in the level, or -1."""
        out = np.full(len(numbers), -1, np.int64)
        for k, part in self._by_shard(numbers, self.starts):
            found = self.shard(k)["numbers"].find(numbers[part] - self.starts[k])
            out[part] = np.where(found >= 0, found + self.offsets[k], -1)
        return out

    def _read(self, places: np.ndarray, body, dtype) -> np.ndarray:
        out = np.zeros(len(places), dtype)
        for k, part in self._by_shard(places, self.offsets):
            out[part] = body(self.shard(k), places[part] - self.offsets[k], k)
        return out

    def numbers(self, places: np.ndarray) -> np.ndarray:
        return self._read(places, lambda s, p, k: s["numbers"].get(p) + self.starts[k], _U)

    def counts(self, places: np.ndarray) -> np.ndarray:
        return self._read(places, lambda s, p, k: (s["sums"].get(p) - np.where(p > 0, s["sums"].get(np.maximum(p - 1, 0)), 0).astype(_U)).astype(np.int64), np.int64)

    def log_p(self, places: np.ndarray) -> np.ndarray:
        return self._read(places, lambda s, p, k: _plain(s["log_p"][p]), float)

    def back_off(self, contexts: np.ndarray) -> np.ndarray:
        """log10 of the mass that this level leaves to the one below, for contexts (places in the level below)."""
        out = np.zeros(len(contexts))
        for k, part in self._by_shard(contexts, self.contexts):
            own, at = self.shard(k)["back_off"], contexts[part] - self.contexts[k]
            out[part] = np.where(at < len(own), _plain(own[np.minimum(at, max(0, len(own) - 1))]), 0.0) if len(own) else 0.0
        return out


@dataclass
class Trie:
    levels: list[Level]
    n_tokens: int
    n_words: int

    def word_log_p(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.n_tokens + 0.5 * (self.n_words + 1)))

    def places(self, ids: np.ndarray, starts: np.ndarray, upto: int) -> list[np.ndarray]:
        """For each order from 1 to ``upto`` the place of the n-gram that ends at each token, or -1. Unknown words have the id V; ``starts`` marks the first tokens of texts."""
        at = [np.where(ids < self.n_words, ids, -1)]
        for k in range(1, upto):
            context = np.concatenate([[-1], at[-1][:-1]])
            context[starts] = -1
            at.append(self._step(k, context, at[0]))
        return at

    def _step(self, k: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.full(len(word), -1, np.int64)
        ok = np.flatnonzero((context >= 0) & (word >= 0))
        number, back = np.unique(context[ok].astype(_U) * _U(self.n_words) + word[ok].astype(_U), return_inverse=True)
        out[ok] = self.levels[k].find(number)[back]
        return out


def _packed(keys: np.ndarray, counts: np.ndarray, start: int) -> tuple[bytes, bytes]:
    """Sorted keys from ``start`` on, and counts."""
    steps = np.diff(keys, prepend=_U(start)).astype(_U)
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)  # byte planes: the upper ones are zeros
    kind = np.uint32 if not len(counts) or int(counts.max()) < 1 << 32 else _U
    return zlib.compress(planes.tobytes(), 1), zlib.compress(counts.astype(kind).tobytes(), 1)


def _blobs(keys: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """Sorted keys and counts, packed for each shard (edges: the shards' first keys)."""
    cuts = np.searchsorted(keys, edges[1:])
    runs = zip(np.split(keys, cuts), np.split(counts, cuts), strict=True)
    return [(shard, *_packed(k, c, int(edges[shard]))) for shard, (k, c) in enumerate(runs) if len(k)]


def _unblob(keys: bytes, counts: bytes, start: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(keys), np.uint8)
    steps = np.ascontiguousarray(planes.reshape(8, -1).T).view(_U).ravel()
    plain = zlib.decompress(counts)
    return np.cumsum(steps, dtype=_U) + _U(start), np.frombuffer(plain, np.uint32 if len(plain) == 4 * len(steps) else _U).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _arrays(keys: np.ndarray, counts: np.ndarray, start: int, bound: int) -> dict[str, np.ndarray]:
    sums = np.cumsum(counts).astype(_U)
    total = int(sums[-1]) + 1 if len(sums) else 1
    return {f"n_{k}": v for k, v in encode(keys - _U(start), bound).items()} | {f"s_{k}": v for k, v in encode(sums, total).items()}


_MANIFEST = "shard int, size long, mass long, name string, layout string, marks array<long>, hot array<struct<place:long,count:long>>, keys binary, counts binary"


def _row(shard: int, counts: np.ndarray, per_shard: int, name: str | None = None, layout: str | None = None, keys: bytes | None = None, packed: bytes | None = None) -> pd.DataFrame:
    """A shard's row of the manifest: without a file, its packed keys and counts."""
    sums = np.cumsum(counts)
    mass = int(sums[-1]) if len(sums) else 0
    grain = max(1, per_shard // GRAIN)
    marks = np.searchsorted(sums, np.arange(grain, mass + 1, grain)) if len(sums) else np.zeros(0, np.int64)
    hot = [{"place": int(p), "count": int(counts[p])} for p in np.flatnonzero(counts > per_shard)]
    return pd.DataFrame({"shard": [shard], "size": [len(counts)], "mass": [mass], "name": [name], "layout": [layout], "marks": [marks.tolist()], "hot": [hot], "keys": [keys], "counts": [packed]})


def _level(folder: str, built: DataFrame, edges: np.ndarray, contexts: np.ndarray) -> Level:
    rows = sorted(built.select("shard", "size", "name", "layout", "marks", "hot").collect(), key=lambda r: r["shard"])  # one row for each shard
    sizes = np.array([r["size"] for r in rows], np.int64)
    at = np.array([r["shard"] for r in rows], np.int64)
    offsets = np.cumsum(sizes) - sizes
    marks = [np.array(r["marks"], np.int64) + o for r, o in zip(rows, offsets, strict=True)]
    hot = {int(h["place"] + o): h["count"] for r, o in zip(rows, offsets, strict=True) for h in r["hot"]}
    return Level(folder, edges[at], contexts[at], offsets, [(r["name"], r["layout"]) for r in rows], int(sizes.sum()), np.concatenate([*marks, np.zeros(0, np.int64)]), hot)


def _cuts(below: Level, v: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """The first number of each shard of the level above, and whether its context is cut."""
    first = {0, *(int(p) + 1 for p in below.marks[GRAIN - 1 :: GRAIN])} | {p + e for p in below.hot for e in (0, 1)}
    edges, split = [], []
    for c in sorted(x for x in first if x < max(1, below.size)):
        parts = min(v, -(-below.hot.get(c, 0) // shard)) or 1
        edges += [c * v + i * v // parts for i in range(parts)]
        split += [parts > 1] * parts
    return np.array(edges, _U), np.array(split)


def hashed_words(text: str | None) -> np.ndarray:
    """Hashes of the words in order, and of the end; bytes are lower-cased and split at ASCII letters and white space only."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.full(len(found) + 1, _END, _U)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, found), _U, len(found))
    return out


def build_words(texts: DataFrame, folder: str, shard: int = SHARD) -> Trie:
    """Level 1 from the training texts (t)."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"h": keys.view(np.int64), "c": n})

        for part in parts:
            for text in part["t"]:
                held.append(hashed_words(text))
                size += len(held[-1])
                if size >= RUN:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counts = cut(texts.select("t").mapInPandas(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"])
    if v >= (1 << 32) - 1:
        raise ValueError(f"{v} distinct words; at most 2^32 - 2 can be numbered")
    bits = max(0, (max(1, v) // max(1, shard // 4)).bit_length())
    edges = np.arange(1 << bits, dtype=_U) << _U(64 - bits) if bits else np.zeros(1, _U)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        k = int(part["shard"].iloc[0])
        keys = part["h"].to_numpy(np.int64).view(_U)
        order = np.argsort(keys)
        own = part["c"].to_numpy(np.int64)[order]
        return _row(k, own, shard, *save_arrays(folder, _arrays(keys[order], own, int(edges[k]), 1 << (64 - bits) if bits else (1 << 64) - 1)))

    which = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    built = cut(counts.select(which.alias("shard"), "h", "c").groupBy("shard").applyInPandas(build, _MANIFEST))
    return Trie([_level(folder, built, edges, np.zeros(len(edges), np.int64))], n, v)


def number_tokens(docs: DataFrame, trie: Trie) -> DataFrame:
    """(id, train, n_tokens, n_known, base_score, ids) from (id, train, t): ids are the words' numbers as four bytes each, V if unknown."""

    def numbered(part: pd.DataFrame, hashes: list[np.ndarray]) -> pd.DataFrame:
        sizes = np.array([len(x) for x in hashes], np.int64)
        unique, back = np.unique(np.concatenate(hashes), return_inverse=True)
        places = trie.levels[0].find(unique)
        counts = np.zeros(len(unique), np.int64)
        counts[places >= 0] = trie.levels[0].counts(places[places >= 0])
        starts = np.cumsum(sizes) - sizes
        ids = np.where(places >= 0, places, trie.n_words).astype(np.uint32)[back]
        return pd.DataFrame(
            {
                "id": part["id"], "train": part["train"], "n_tokens": sizes,
                "n_known": np.add.reduceat((counts > 0).astype(np.int64)[back], starts),
                "base_score": np.add.reduceat(trie.word_log_p(counts)[back], starts),
                "ids": [x.tobytes() for x in np.split(ids, starts[1:])],
            }
        )

    def number(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            lo, hashes, size = 0, [], 0
            for i, text in enumerate(part["t"]):
                hashes.append(hashed_words(text))
                size += len(hashes[-1])
                if size >= 2 * BATCH_TOKENS or i == len(part) - 1:
                    yield numbered(part.iloc[lo : i + 1], hashes)
                    lo, hashes, size = i + 1, [], 0

    return cut(docs.mapInPandas(number, "id string, train boolean, n_tokens long, n_known long, base_score double, ids binary"))


def _texts(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about BATCH_TOKENS, as even as they can be: the rows, all their ids, the places of first tokens."""
    for part in parts:
        sizes = part["ids"].map(len).to_numpy() // 4
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(part) else 0
        even = -(-total // max(1, total // BATCH_TOKENS))
        lo = 0
        while lo < len(part):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + even, side="right")))
            own = part.iloc[lo:hi]
            yield own, np.frombuffer(b"".join(own["ids"]), np.uint32).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[lo:hi])[:-1]]).astype(np.int64)
            lo = hi


def add_level(trie: Trie, numbered: DataFrame, folder: str, min_count: int = MIN_COUNT, shard: int = SHARD) -> Trie:
    """The trie with one more level, counted from the training rows of ``numbered``."""
    k, v = len(trie.levels), trie.n_words
    below = trie.levels[-1]
    if below.size * v >= 1 << 64:
        raise ValueError(f"{below.size} contexts times {v} words can't be numbered in 64 bits")
    edges, split = _cuts(below, v, shard)
    contexts = (edges // _U(max(1, v))).astype(np.int64)
    ends = [*map(int, edges[1:]), below.size * v]

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts, held = [], [], 0

        def flush() -> pd.DataFrame:
            out = _blobs(*_summed(np.concatenate(keys), np.concatenate(counts)), edges)
            return pd.DataFrame(out, columns=["shard", "keys", "counts"])

        for _, ids, starts in _texts(parts):
            at = trie.places(ids, starts, k)
            context = np.concatenate([[-1], at[-1][:-1]])
            context[starts] = -1
            ok = (context >= 0) & (at[0] >= 0)
            number, n = np.unique(context[ok].astype(_U) * _U(v) + at[0][ok].astype(_U), return_counts=True)
            keys.append(number)
            counts.append(n)
            held += len(number)
            if held > RUN:
                yield flush()
                keys, counts, held = [], [], 0
        if held:
            yield flush()

    def finished(s: int, keys: np.ndarray, counts: np.ndarray, of_split: tuple[int, int] | None = None) -> pd.DataFrame:
        """A shard's row, once its file is written. ``of_split``: counts and n-grams of its one context in all shards."""
        log_p = np.zeros(len(keys), np.uint8)
        back_off = np.zeros(-(-ends[s] // v) - int(contexts[s]), np.uint8)
        of = keys // _U(v)
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        own = of[first].astype(np.int64)
        del of
        of_context = below.counts(own)
        mass, n = (np.array([x]) for x in of_split) if of_split else (np.add.reduceat(counts, first), np.diff(first, append=len(keys)))
        left = np.maximum((of_context - mass + DISCOUNT * n) / of_context, 1e-9)
        back_off[own - int(contexts[s])] = _code(np.log10(left))
        shorter = None if k == 1 else _below(trie, own, k)
        for lo in range(0, len(keys), BATCH_TOKENS):  # in slices, for memory
            at = np.arange(lo, min(len(keys), lo + BATCH_TOKENS))
            back = np.searchsorted(first, at, side="right") - 1
            word = (keys[at] % _U(v)).astype(np.int64)
            if k == 1:
                lower = trie.word_log_p(below.counts(word))
            else:  # the n-gram without its first word is there, since it was seen as often
                place = below.find(shorter[back].astype(_U) * _U(v) + word.astype(_U))
                lower = below.log_p(np.maximum(place, 0))
            log_p[at] = _code(np.log10((counts[at] - DISCOUNT) / of_context[back] + left[back] * 10.0**lower))
        arrays = _arrays(keys, counts, int(edges[s]), ends[s] - int(edges[s]))
        return _row(s, counts, shard, *save_arrays(folder, arrays | {"log_p": log_p, "back_off": back_off}))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        s = int(part["shard"].iloc[0])
        runs = [_unblob(a, b, int(edges[s])) for a, b in zip(part["keys"], part["counts"], strict=True)]
        keys, counts = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
        del runs
        keys, counts = _summed(keys, counts)
        if min_count > 1:
            kept = counts >= min_count
            keys, counts = keys[kept], counts[kept]
        if split[s]:
            return _row(s, counts, shard, None, None, *_packed(keys, counts, int(edges[s])))
        return finished(s, keys, counts)

    runs = numbered.filter("train").select("ids").mapInPandas(count, "shard int, keys binary, counts binary")
    built = cut(runs.groupBy("shard").applyInPandas(build, _MANIFEST))
    if split.any():
        waiting = built.filter("name IS NULL")
        sums: dict[int, tuple[int, int]] = {}
        for r in waiting.select("shard", "mass", "size").collect():  # a row for each shard of a cut context
            mass, n = sums.get(int(contexts[r["shard"]]), (0, 0))
            sums[int(contexts[r["shard"]])] = mass + r["mass"], n + r["size"]

        def finish(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for s, keys, counts in zip(part["shard"], part["keys"], part["counts"], strict=True):
                    yield finished(s, *_unblob(keys, counts, int(edges[s])), sums[int(contexts[s])])

        done = waiting.select("shard", "keys", "counts").repartition(int(split.sum()), "shard").mapInPandas(finish, _MANIFEST)
        built = cut(built.filter("name IS NOT NULL").union(done))
    return Trie([*trie.levels, _level(folder, built, edges, contexts)], trie.n_tokens, v)


def _below(trie: Trie, contexts: np.ndarray, k: int) -> np.ndarray:
    """For contexts of k words (places in level k) the place of each without its first word in level k - 1."""
    word = []
    at = contexts
    for level in range(k - 1, 0, -1):
        number = trie.levels[level].numbers(at)
        word.append((number % _U(trie.n_words)).astype(np.int64))
        at = (number // _U(trie.n_words)).astype(np.int64)
    place = word.pop()
    for level in range(1, k - 1):
        place = trie.levels[level].find(place.astype(_U) * _U(trie.n_words) + word.pop().astype(_U))
    return place


def token_log_p(trie: Trie, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 p of each token after the ones before it in its text."""
    at = trie.places(ids, starts, len(trie.levels))
    unique, back = np.unique(ids, return_inverse=True)
    counts = np.zeros(len(unique), np.int64)
    counts[unique < trie.n_words] = trie.levels[0].counts(unique[unique < trie.n_words])
    out = trie.word_log_p(counts)[back]
    for k in range(1, len(trie.levels)):
        context = np.concatenate([[-1], at[k - 1][:-1]])
        context[starts] = -1
        has = np.flatnonzero(context >= 0)
        out[has] += trie.levels[k].back_off(context[has])
        found = np.flatnonzero(at[k] >= 0)
        out[found] = trie.levels[k].log_p(at[k][found])
    return out


def build_trie(docs: DataFrame, train, order: int = ORDER, folder: str | None = None, text: str = "text", key: str = "doc_id", shard: int = SHARD) -> tuple[Trie, DataFrame]:
    """The model of the rows where ``train`` holds, and ``number_tokens`` of all rows."""
    folder = folder or os.path.join(shared_dir(docs.sparkSession), f"trie-{uuid.uuid4().hex}")
    # Ids travel as text: pandas would make a nullable long a double.
    texts = bounded(docs).select(F.col(key).cast("string").alias("id"), train.alias("train"), F.col(text).alias("t"))
    trie = build_words(texts.filter("train"), folder, shard)
    numbered = number_tokens(texts, trie)
    for _ in range(1, order):
        trie = add_level(trie, numbered, folder, shard=shard)
    return trie, numbered


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trie, numbered = build_trie(docs, bucket_of(F.col("doc_id"), 5) != 1)

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own, ids, starts in _texts(parts):
            yield own.drop(columns=["ids"]).assign(score=np.add.reduceat(token_log_p(trie, ids, starts), starts))

    scored = numbered.mapInPandas(score, "id string, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        F.col("id").cast("long").alias("doc_id"),
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(trie.n_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
