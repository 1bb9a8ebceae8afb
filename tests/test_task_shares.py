"""Shuffles that grow with their table have partitions by its splits, so that no task's share grows."""

import re

from docuflux.plans.blocks import read
from docuflux.registry import queries
from docuflux.session import parts_for

TINY = "/root/testdata/sf0.001"


def test_layout_run_is_dealt_by_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        parts = []
        for size in ("128m", "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            n = parts_for(read(spark, TINY, "documents"))
            plan = queries()["b19_layout_run"](spark, TINY)._jdf.queryExecution().executedPlan().toString()
            assert {int(x) for x in re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", plan)} == {n}
            parts.append(n)
        assert parts[1] > parts[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
