"""The comma-separated file gives back what was written: blanks at the ends, empty texts and nulls."""

import hashlib

from refweave.plans import catalog, records  # noqa: F401
from refweave.sources import readers

TEXTS = [None, "", " ", "  lead", "trail \t", "\nx\n", "\r\n", "a\rb", '"', '"a,"b', "\\", '\\"', "\x00a", "#c", "null", ',"\n']


def test_blanks_empty_texts_and_nulls_come_back(spark, tmp_path):
    sources = [None, "", " web "]
    rows = [(i, t, sources[i % 3]) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.source) for r in catalog.QUERIES["csv_round_trip"](spark, str(tmp_path)).collect()}
    assert got == {str(i): (None if t is None else hashlib.md5(t.encode()).hexdigest(), s) for i, t, s in rows}


def test_empty_cells_of_an_export_are_null_by_default(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"",\n')
    assert [tuple(r) for r in readers.read_csv(spark, f"{tmp_path}/a.csv").collect()] == [(None, None)]
    assert [tuple(r) for r in readers.read_csv(spark, f"{tmp_path}/a.csv", keep_empty=True).collect()] == [("", None)]
