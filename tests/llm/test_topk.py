import numpy as np
import pytest
from pyspark.sql import functions as F

from gridpulse.llm import topk


def brute(rows, queries, k):
    out = []
    for q, v in queries:
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [7, 40, 8192])
@pytest.mark.parametrize("spread", [2, 60])
def test_equals_brute_force(spark, monkeypatch, shard, spread):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    r = np.random.default_rng(shard + spread)
    rows = [(i, r.integers(-spread, spread + 1, 12).tolist()) for i in range(150)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, [0] * 12), (203, [5]), (204, [])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").withColumn("score", F.lit(0)).withColumn("shard", F.lit(1))
    queries = df.where("vec_id % 25 = 0 or vec_id > 199")
    got = sorted(tuple(x) for x in topk.top_k(df, queries, 5).collect())
    assert got == brute(rows, [x for x in rows if x[0] % 25 == 0 or x[0] > 199], 5)


def test_unusable_vectors_and_few_rows(spark):
    rows = [(0, [0.1, -0.2]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (50, [0.5, 0.5]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = df.where(topk.usable("embedding")).select("vec_id", topk.quantise("embedding").alias("v"))
    got = sorted(tuple(x) for x in topk.top_k(v, v.where("vec_id % 50 = 0"), 5).collect())
    assert got == [(0, 1, 50, 25 * 128 - 52 * 128), (50, 1, 0, 25 * 128 - 52 * 128)]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0
