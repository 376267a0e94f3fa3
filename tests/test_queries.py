"""Every registered query runs at sf0.001; oracle queries equal DuckDB there."""

import math

import duckdb
import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL

TABLES = ["documents", "labels", "pages", "orders", "events"]
# Queries without SQL whose results other tests check value by value (tests/llm, test_models,
# test_permutation, test_markup, test_softboost); here the rest: what each must give at least.
ELSEWHERE = set(E.queries()) & ({n for n in E.queries() if n.startswith("op")} | {
    "pipeline", "strip_markup_full", "forest_permutation", "boosted_permutation", "boosted_importance",
    "boosted_accuracy", "boosted_bow_accuracy", "tree_attribution_top", "row_importance",
    "boosted_attribution_top", "boosted_biased_words", "boosted_interactions", "softmax_accuracy", "softmax_history",
    "softmax_value_change"})


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        if math.isinf(v):
            return (1, str(v))
        return (2, round(v, 6))
    if isinstance(v, int) and not isinstance(v, bool):
        return (2, float(v))
    return (3, str(v))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["class", "term", "score", "max_other"]
    assert df.count() > 0


def test_every_query_has_a_callable():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle_matches(spark, duck, name):
    sp = E.queries()[name](spark, SF_SMALL)
    rows = sp.collect()
    cols = sp.columns
    d = duck.execute(E.oracle_sql()[name])
    dcols = [c[0] for c in d.description]
    drows = d.fetchall()
    assert sorted(cols) == sorted(dcols)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    dorder = sorted(range(len(dcols)), key=lambda i: dcols[i])
    a = sorted(tuple(_norm(r[i]) for i in order) for r in rows)
    b = sorted(tuple(_norm(r[i]) for i in dorder) for r in drows)
    assert a == b


def _rows(spark, name):
    return E.queries()[name](spark, SF_SMALL).collect()


CHECKS = {
    "clean_text_full": lambda rows: all(r.nr_of_words == len(r.clean_post.split())
                                        and r.nr_of_characters == len(r.clean_post) for r in rows),
    "forest_accuracy": lambda rows: len(rows) == 1 and rows[0].accuracy > 0.7,
    "forest_report": lambda rows: {r["class"] for r in rows} >= {"macro avg", "weighted avg"} and all(
        0 <= r.f1 <= 1 and abs(r.f1 - (2 * r.precision * r.recall / ((r.precision + r.recall) or 1))) < 1e-9
        for r in rows if "avg" not in r["class"]),
    "forest_importance": lambda rows: [r.rank for r in sorted(rows, key=lambda r: -r.importance)] == list(
        range(1, 11)),
    "gain_importance": lambda rows: len(rows) == 10 and all(r.gain > 0 and r.splits > 0 for r in rows),
    "interactions": lambda rows: rows and all(r.feature_a != r.feature_b and r.score >= 0 for r in rows),
    "logistic_attribution_top": lambda rows: len(rows) == 40 and all(r.mean_abs >= 0 for r in rows),
    "logistic_permutation": lambda rows: len(rows) == 40 and all(-1 <= r.importance <= 1 for r in rows),
    "boosted_history": lambda rows: all(r.log_loss > 0 for r in rows) and {r.label for r in rows} == {0, 1, 2, 3},
    "boosted_multiclass_history": lambda rows: sum(r.kept for r in rows) == 1 and min(
        rows, key=lambda r: (r.log_loss, r.iteration)).kept,
    "boosted_gain": lambda rows: all(r.gain >= 0 and 1 <= r.rank <= 10 for r in rows),
}


def test_no_query_without_a_check():
    assert set(E.queries()) == set(E.oracle_sql()) | ELSEWHERE | set(CHECKS)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_rows_only_queries(spark, name):
    rows = _rows(spark, name)
    assert rows and CHECKS[name](rows)
