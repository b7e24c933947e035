"""The pipeline's stages and the table operators on awkward tables."""

import pytest
from refweave.llm import catalog

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node int, mix int, item_id long"
ITEM = "a benchmark question about the seven colours of the rainbow and their usual order in the sky"


def _write(spark, folder, docs):
    def put(rows, schema, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")

    put(docs, DOCS, "documents")
    put([(k, k % 2, int(k % 3 == 0)) for k in range(40)] + [(None, None, None)] if docs else [], "doc_id long, quality int, toxic int", "labels")
    put([(1, ITEM), (2, None), (None, ""), (3, ITEM)] if docs else [], "item_id long, text string", "benchmark")
    put([(1, "u", "<p>x</p>"), (2, "u", "<p>x</p>"), (3, None, None), (4, "u", "")] if docs else [], "page_id long, url string, html string", "pages")
    return str(folder)


def _row(doc_id, text, source="web"):
    return (doc_id, text, "en", source, None if text is None else len(text), 1, 2, 3)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    prose = [_row(k, " ".join(f"word{(k * 7 + j * (k + 3)) % 97}" for j in range(60 + k))) for k in range(30)]
    odd = [_row(30, None), _row(31, ""), _row(32, "x " * 60_000), _row(33, f"before {ITEM} after"), _row(34, "mail a.b@example.org now", None), _row(None, "no id here", None), _row(None, None), prose[3], prose[3]]
    return _write(spark, tmp_path_factory.mktemp("awkward"), prose + odd)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("empty"), [])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"op10_ngram_join"}))
def test_awkward_and_empty_tables(spark, awkward, empty, name):
    rows = catalog.QUERIES[name](spark, awkward).collect()
    if name == "op8_warc":
        assert len(rows) == 4
    elif name != "op5_decontamination":
        assert len(rows) == 39
    else:
        assert {(r["doc_id"], r["item_id"]) for r in rows} == {(33, 1), (33, 3)}
    assert catalog.QUERIES[name](spark, empty).count() == 0


def test_stages(spark, awkward, empty):
    columns = list(corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.read.parquet(f"{awkward}/documents.parquet"), awkward)
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name != "mixing":
            assert out.columns == columns
        if name == "decontamination":
            assert 33 not in ids and 32 in ids
        if name == "pii":
            assert [r["text"] for r in out.filter("doc_id = 34").collect()] == ["mail [email] now"]
        if name == "ngram_join":
            assert out.filter("doc_id = 3").count() == 1
        assert stage(spark, spark.read.parquet(f"{empty}/documents.parquet"), empty).count() == 0


def test_mix_is_bounded_and_repeatable(spark, awkward):
    once, again = (sorted(map(str, catalog.QUERIES["op9_mixing"](spark, awkward).collect())) for _ in range(2))
    assert once == again
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in catalog.QUERIES["op9_mixing"](spark, awkward).collect())
