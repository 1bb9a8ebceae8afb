"""The vector index against all rows: its recall, and the same rows where every cell is looked into."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docuflux.operators import retrieval, vectors
from docuflux.plans import retrieval as plans
from docuflux.registry import queries

from .compare import TINY


@pytest.mark.parametrize("folder", [TINY, "/root/testdata/sf0.1"])
def test_recall_over_all_rows(spark, folder):
    exact = retrieval.top(retrieval.dense(*plans.vectors(spark, folder)), 10).select("query_id", "id")
    found = queries()["j8_vector_index"](spark, folder)
    assert vectors.recall(found, exact) >= 0.9
    assert found.groupBy("query_id").count().filter("count <> 10").count() == 0


def test_all_cells_are_exact(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 10)  # every cell is searched in parts
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((200, 6)).round(1))] + [(500 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0]) for i in range(90)]
    rows += [(900, None), (901, [0.0] * 6), (902, [1.0]), (903, [math.nan] * 6)]
    all_ = spark.createDataFrame([(*r, "x") for r in rows], "id long, embedding array<double>, cell string")
    asked = all_.filter("id % 7 = 0 and id < 600").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    centres = vectors.fit(all_, cells=9)
    assert centres.shape == (9, 6)
    got = {(r.query_id, r.rank): (r.id, round(r.score, 6)) for r in vectors.search(vectors.indexed(all_, centres), asked, centres, 5, probes=9).collect()}
    known = {i: np.array(v) / np.linalg.norm(v) for i, v in rows[:290]}
    for q in [i for i in known if i % 7 == 0]:
        best = sorted(((-round(float(known[q] @ v), 9), i) for i, v in known.items()))[:5]
        assert [got[q, n + 1] for n in range(5)] == [(i, round(-s, 6)) for s, i in best]


def test_few_and_no_rows(spark):
    none = spark.createDataFrame([], "id long, embedding array<float>")
    assert vectors.fit(none).shape == (0, 0)
    one = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], none.schema)
    centres = vectors.fit(one)
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [(r.id, r.score) for r in vectors.search(vectors.indexed(one, centres), asked, centres, 3).collect()] == [(1, 0.0), (2, 0.0)]


@pytest.mark.parametrize("others", [False, True])
def test_nearest_in_blocks_as_all_pairs(spark, monkeypatch, others):
    """Copies, null and odd vectors, and other sizes; few rows go on, not all pairs."""
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 60)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((150, 6)).round(1))] + [(500 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0]) for i in range(90)]
    rows += [(900, None), (901, [1e-200, 0.0, 0.0, 0.0, 0.0, 0.0]), (902, [1.0]), (903, [math.nan] * 6), (904, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (905, []), (906, [3.0, 4.0]), (907, [math.inf, 1.0, 0.0, 0.0, 0.0, 0.0])]
    all_ = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = all_.filter("id % 7 = 0 or id >= 900").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    got = retrieval.nearest(all_, asked, 5, others)
    known = {}
    for i, v in rows:
        x = np.array([math.nan if c is None else c for c in v or []], float)
        n = np.sqrt((x * x).sum())
        known[i] = x / n if np.isfinite(n) and n > 0 else np.zeros(len(x))
    want = {}
    for q in [i for i in known if i % 7 == 0 or i >= 900]:
        score = lambda i: float(known[q] @ known[i]) if len(known[q]) == len(known[i]) else 0.0  # noqa: B023, E731
        best = sorted((-round(score(i), 9), i) for i in known if i != q or not others)[:5]
        want |= {(q, n + 1): (i, round(-s, 6) + 0.0) for n, (s, i) in enumerate(best)}
    assert {(r.query_id, r.rank): (r.id, round(r.score, 6) + 0.0) for r in retrieval.top(got, 5).collect()} == want
    assert got.groupBy("query_id").count().filter("count > 60").isEmpty()


def test_beside(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 10)
    ids = [1, 2, 3, 9, 10, 40, 41, 60, *range(100, 130)]
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {(r.query_id, r.rank): r.id for r in retrieval.beside(rows, rows.select(F.col("id").alias("query_id")), 4).collect()}
    assert got == {(q, n + 1): i for q in ids for n, i in enumerate(sorted(ids, key=lambda i: (abs(i - q), i))[:4])}
