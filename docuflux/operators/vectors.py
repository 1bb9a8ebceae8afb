"""A vector index: cells around centres, of which a query looks into the nearest few.

Centres are fitted on a bounded sample, every row is put into a cell, and what lies in the cells that
a query looks into is scored exactly. A cell above `BLOCK` rows is searched in parts, so neither a
frequent vector nor a large cell is one task's; a part hands on a query's k best only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuflux.operators.retrieval import top
from docuflux.session import ship

#: Rows that centres are fitted on (those of least hash of their id), rounds of the fit, rows of a part of a cell.
SAMPLE, ROUNDS, BLOCK = 20_000, 12, 16_384
#: Centres, and cells that a query looks into. The test tables' vectors hardly cluster, so that recall at ten
#: of 0.95 and more takes five cells of eight; where vectors do cluster fewer will do.
CELLS, PROBES = 64, 40


def unit(lists: pa.Array, size: int) -> np.ndarray:
    """Rows of length one; zeros for null vectors, those of another size, and those without a direction."""
    out = np.zeros((len(lists), size))
    for i, v in enumerate(lists):
        row = v.values
        if row is not None and len(row) == size and not row.null_count:
            out[i] = row.to_numpy(zero_copy_only=False)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=np.isfinite(norm) & (norm > 0))


def fit(vectors: DataFrame, cells: int = CELLS, sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """Centres (cells, size) by spherical k-means over at most `sample` rows; fewer where there are fewer
    rows. vectors: id, embedding. The size is that of the first vector that is not null."""
    rows = vectors.filter("embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("v")).orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()["v"].combine_chunks()
    if not len(rows):
        return np.zeros((0, 0))
    v = unit(rows, len(rows[0]))
    v = v[np.abs(v).sum(1) > 0]
    if not len(v):
        return np.zeros((1, len(rows[0])))
    rng = np.random.default_rng(seed)
    centres = v[rng.choice(len(v), min(cells, len(v)), replace=False)]
    for _ in range(ROUNDS):
        own = (v @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres


def _nearest(centres: np.ndarray, name: str, probes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = unit(batch.column(1), centres.shape[1])
            near = np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :probes]
            row = np.repeat(np.arange(len(v)), near.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(near.ravel().astype(np.int32)), pa.array(list(v[row]), pa.list_(pa.float64()))], [name, "cell", "vector"])

    return work


def indexed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, cell, vector of length one) of every row. vectors: id (integer), embedding."""
    ship(vectors.sparkSession)
    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", F.col("embedding").cast("array<double>")).mapInArrow(_nearest(centres, "id", 1), f"id {kind}, cell int, vector array<double>")


def search(index: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, probes: int = PROBES) -> DataFrame:
    """(query_id, id, score, rank): the k rows of highest cosine in the `probes` cells nearest to each query,
    as `top` ranks them. index: as `indexed` gives it; queries: query_id, vector."""
    ship(index.sparkSession)
    query, row = queries.schema["query_id"].dataType.simpleString(), index.schema["id"].dataType.simpleString()
    asked = queries.select("query_id", F.col("vector").cast("array<double>")).mapInArrow(_nearest(centres, "query_id", probes), f"query_id {query}, cell int, vector array<double>")
    # as many rows as there are cells
    parts = index.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    rows = index.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    asked = asked.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def best(rows: pa.Table, asked: pa.Table) -> pa.Table:
        q, i, s = [], [], []
        if len(rows) and len(asked):
            ids = rows["id"].to_numpy()
            v, every = (np.array(t["vector"].to_pylist()) for t in (rows, asked))
            names = asked["query_id"].to_pylist()
            for at in range(0, len(every), 1024):
                scores = every[at : at + 1024] @ v.T
                for name, one in zip(names[at : at + 1024], scores, strict=True):
                    near = np.round(one, 9)
                    # all that may be among the k best, whatever their ids
                    hold = np.flatnonzero(near >= np.partition(near, -k)[-k]) if len(near) > k else np.arange(len(near))
                    hold = hold[np.lexsort((ids[hold], -near[hold]))][:k]
                    q += [name] * len(hold)
                    i += ids[hold].tolist()
                    s += one[hold].tolist()
        return pa.table({"query_id": pa.array(q, asked.schema.field("query_id").type), "id": pa.array(i, rows.schema.field("id").type), "score": pa.array(s, pa.float64())})

    found = rows.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInArrow(best, f"query_id {query}, id {row}, score double")
    return top(found, k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact rows (query_id, id) that were found."""
    n, hit = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").agg(F.count("*"), F.count("hit")).first()
    return hit / n if n else 1.0
