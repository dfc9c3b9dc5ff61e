from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridpulse.llm import sharding
from tests.llm.conftest import SCHEMA


def check(rows, edge_rows, shards):
    assert Counter((r.doc_id, r.text, r.size) for r in rows) == Counter((r[0], r[1], len((r[1] or "").encode()) + 1) for r in edge_rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(shards))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_edges(edge_docs, edge_rows, shards):
    check(sharding.shard_by_bytes(edge_docs, shards, rows_per_bin=10).collect(), edge_rows, shards)


def test_bytes_near_equal_and_copies_together(spark):
    rows = [(i, f"text {i % 4000} " * (i % 4000 % 37), "", "", 0, 0, "", 0, 0) for i in range(6000)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, SCHEMA), 8, rows_per_bin=100)
    sizes = [r["sum(size)"] for r in out.groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 8 and max(sizes) / min(sizes) < 1.05
    assert out.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_group_of_copies_larger_than_a_shard(spark):
    rows = [(i, "same text" if i % 3 else f"other {i}", "", "", 0, 0, "", 0, 0) for i in range(3000)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, SCHEMA), 8)
    sizes = [r["sum(size)"] for r in out.groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 8 and max(sizes) / min(sizes) < 1.05


def test_empty_table_and_native_plan(spark, no_docs, edge_docs):
    assert sharding.shard_by_bytes(no_docs).count() == 0
    plan = sharding.shard_by_bytes(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
