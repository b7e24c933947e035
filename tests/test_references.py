"""Incremental resolution with recorded answers."""

import json

import pytest

from refweave.operators import references as R
from refweave.operators.unify import merge_precedence
from refweave.streaming.incremental import refresh

FIVE = ["10.1/a", "10.1/b", "10.1/c", "10.1/d", "10.1/e"]


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "doi string")


def loaded(spark, values):
    return spark.createDataFrame([(v, [f"{v}/x"]) for v in values], "citing_doi string, cited_dois array<string>")


@pytest.fixture
def answer():
    def ask(asked):  # executors don't import this file, so it travels by value
        return [(k, 200, json.dumps([{"citing": f"omid:br/1 doi:{k}", "cited": f"omid:br/2 doi:{k}/x"}, {"citing": f"omid:br/1 doi:{k}", "cited": "omid:br/3"}])) for k in asked]

    return ask


@pytest.mark.parametrize("n, left", [(2, 3), (0, 5), (5, 0)])
def test_only_unanswered_keys_are_asked(spark, n, left):
    assert R.keys_to_query(keys(spark, FIVE), loaded(spark, FIVE[:n])).count() == left


def test_loaded_and_fetched_make_all(spark, answer):
    todo = R.keys_to_query(keys(spark, FIVE), loaded(spark, FIVE[:2]))
    found, errors = R.parse_pairs(R.fetch(todo, answer, pause=0))
    assert errors.count() == 0
    fetched = found.select("citing_doi", "cited_dois")
    assert {(r.citing_doi, tuple(r.cited_dois)) for r in R.append_new(loaded(spark, FIVE[:2]), fetched).collect()} == {(k, (f"{k}/x",)) for k in FIVE}
    merged = merge_precedence(loaded(spark, FIVE[:2]), fetched, "citing_doi", "cited_dois")
    assert merged.count() == 5


def test_bad_answers_are_errors_with_a_fixed_schema(spark):
    def odd(asked):
        return [(k, s, b) for k, (s, b) in zip(asked, [(200, "[]"), (500, "x"), (200, "no json"), (200, "[]"), (404, None)], strict=True)]

    found, errors = R.parse_pairs(R.fetch(keys(spark, FIVE).coalesce(1), odd, batch=5, pause=0))
    assert found.filter("size(cited_dois) = 0").count() == 2
    assert errors.columns == ["error_omid", "error_doi", "error_message"] and errors.count() == 3


def test_raising_transport_and_works(spark):
    def broken(asked):
        raise OSError("down")

    _, errors = R.parse_works(R.fetch(keys(spark, FIVE), broken, batch=100, pause=0, retries=1, retry_pause=0))
    assert errors.count() == 5

    def works(asked):
        return [(k, 200, json.dumps({"message": {"DOI": k.upper(), "reference": [{"DOI": "10.2/Q"}, {"key": "n"}]}})) for k in asked[:3]]

    found, errors = R.parse_works(R.fetch(keys(spark, FIVE).coalesce(1), works, batch=100, pause=0))
    assert found.count() == 3 and errors.count() == 2
    assert found.first()["cited_dois"] == ["10.2/Q"]


def test_cleaned_keys(spark):
    df = keys(spark, ["10.1/A", "10.1/a", "UNKNOWN", "", None])
    assert [r.doi for r in R.cleaned_keys(df).collect()] == ["10.1/a"]
    assert R.cleaned_keys(df, literal=True).count() == 3


def test_refresh_takes_new_files_once(spark, tmp_path, answer):
    paths = [f"file://{tmp_path}/{x}" for x in ("in", "refs", "errs", "state")]
    for k in range(2):
        keys(spark, FIVE[: 3 + k]).write.mode("append").parquet(paths[0])
        refresh(spark, *paths, answer, pause=0)
    got = spark.read.option("recursiveFileLookup", True).parquet(paths[1])
    assert sorted(r.citing_doi for r in got.collect()) == FIVE[:4]


def test_a_batch_that_failed_before_its_commit_loses_nothing(spark, tmp_path, answer):
    paths = [f"file://{tmp_path}/{x}" for x in ("in", "refs", "errs", "state")]
    keys(spark, FIVE[:3]).write.parquet(paths[0])
    refresh(spark, *paths, answer, pause=0)
    keys(spark, FIVE).write.mode("append").parquet(paths[0])
    refresh(spark, *paths, answer, pause=0)
    for commit in (tmp_path / "state" / "commits").glob("*1*"):  # batch 1 wrote its answers, but was not committed
        commit.unlink()
    asked = []

    def again(some):
        asked.extend(some)
        return answer(some)

    refresh(spark, *paths, again, pause=0)
    got = spark.read.option("recursiveFileLookup", True).parquet(paths[1])
    assert sorted(r.citing_doi for r in got.collect()) == FIVE
