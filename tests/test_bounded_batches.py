"""Python workers take texts in batches of bounded bytes."""

import pyarrow as pa
from pyspark.sql import functions as F

from docuflux.operators import groups, structure


def test_cut_takes_and_hands_on_little(spark, monkeypatch):
    rows = spark.range(0, 3000, 1, 1).select(F.lit("k").alias("k"), "id", F.lit("ab " * 2000).alias("text"))
    sizes = groups.cut(rows, "text", lambda x: x.split(), "n", "part").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").agg(F.sum("n")).first()[0]
    assert sizes == 3000 * 2000
    seen = structure.chunked(rows, "id").select("id").groupBy("id").count().count()
    assert seen == 3000 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_cut_keeps_columns_and_order(spark):
    rows = spark.createDataFrame([("a b", 1, "x"), (None, 2, "y"), ("", 3, None), ("c", None, "z"), ("  ", 4, "w")], "text string, id long, more string")
    got = {tuple(r) for r in groups.cut(rows, "text", str.split, "n", "part").collect()}
    assert got == {(1, "x", 0, "a"), (1, "x", 1, "b"), (None, "z", 0, "c")}
