"""Hot keys: hubs are dealt to more tasks than one, and results don't change."""

import random

import numpy as np
from pyspark.sql import functions as F
from refweave.llm import ngram_join as join
from refweave.llm import warc
from refweave.operators.components import component_labels
from refweave.operators.skew import lookup


def test_lookup_equals_a_join_and_leaves_hub_rows_where_they_are(spark):
    rng = random.Random(21)
    rows = [(None if k % 50 == 0 else "hub" if k % 3 else f"k{rng.randrange(3000)}", k) for k in range(6000)]
    df = spark.createDataFrame(rows, "key string, v long").repartition(8)
    table = df.filter("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.max("v").alias("most"))
    got = lookup(df, table, "key", "n", len(rows))
    want = df.join(table.drop("n"), "key").select("key", "v", "most")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    left = lookup(df, table.filter("key <> 'hub'"), "key", "n", len(rows), "left")
    assert left.count() == len(rows) and left.filter("most is null").count() == sum(k in (None, "hub") for k, _ in rows)
    tasks = got.filter("key = 'hub'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 4


def test_a_star_and_a_long_path(spark):
    star = [(0, k) for k in range(1, 4000)]
    path = [(10_000 + k, 10_001 + k) for k in range(120)]
    got = {r.id: r.label for r in component_labels(spark.createDataFrame(star + path, "src long, dst long")).collect()}
    assert set(got.values()) == {0, 10_000} and len(got) == 4000 + 121


def test_one_token_of_many_texts_and_many_copies(spark):
    rng = random.Random(22)
    passage = "the one passage that all of these texts begin with"
    word = lambda: f"x{rng.randrange(10**7)}"
    rows = [(k, f"{passage} " + " ".join(word() for _ in range(12))) for k in range(600)]  # share five-word runs, link with nothing
    near = [word() for _ in range(60)]
    rows += [(1000 + k, " ".join(near[:-1] + [f"end{k}"])) for k in range(700)]  # one large group of near copies, more than PARTNERS
    rows += [(5000 + k, rows[5][1].upper()) for k in range(900)]  # one large group of exact copies
    got = {r["doc_id"]: r["component_id"] for r in join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert all(got[k] == k for k in range(600)) and all(got[1000 + k] == 1000 for k in range(700)) and all(got[5000 + k] == 5 for k in range(900))
    assert join.PARTNERS < 700


def test_many_ids_pass_without_a_filter(spark, monkeypatch):
    rng = random.Random(23)
    base = [f"y{rng.randrange(10**6)}" for _ in range(40)]
    rows = [(k, " ".join([*base[:39], f"e{k}"])) for k in range(30)] + [(100 + k, f"alone {k} with five words more") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, join.components(docs).collect()))
    monkeypatch.setattr(join, "FILTER_IDS", 0)
    assert sorted(map(tuple, join.components(docs).collect())) == want


def test_pairs_that_need_several_matches(spark, monkeypatch):
    """Prefixes of 2, 3 and 4 matches, against all pairs."""
    from test_ngram_join import _brute as brute

    rng = random.Random(24)
    common = [f"c{k}" for k in range(40)]
    rows = []
    for k in range(60):  # texts of frequent words only: all their shingles come up often, so longer prefixes are cheaper
        base = [common[(k % 6 + j * (1 + k % 6)) % 40] for j in range(50)]
        for _ in range(rng.randrange(3)):
            base[rng.randrange(50)] = rng.choice(common)
        rows.append((k, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    used = set()
    for _, text in rows:
        tokens = join.shingle_set(text)
        for background in (0.0, 5.0):
            used.add(join.prefix(tokens, np.full(len(tokens), 30), background)[1])
    assert max(used) > 1
    for paired in (join.PAIRED, 2):  # with tokens in one slot, and in several
        monkeypatch.setattr(join, "PAIRED", paired)
        got = sorted(map(tuple, join.components(docs).select("doc_id", "n_shingles", "component_id").collect()))
        assert got == brute(rows)


def test_archives_are_read_by_as_many_tasks_as_files(spark):
    pages = spark.createDataFrame([(k, "u", "page " * 200 + str(k)) for k in range(60)], "page_id long, url string, html string").repartition(6)
    folder = warc.shared_dir(spark) + "/warc-tasks"
    files = warc.write_warc(warc.planned_records(pages), folder, file_bytes=300)
    read = warc.read_warc(files, folder)
    n = files.count()
    assert n > 20 and read.rdd.getNumPartitions() == min(n, 4 * spark.sparkContext.defaultParallelism) > 1
    assert read.count() == 60
