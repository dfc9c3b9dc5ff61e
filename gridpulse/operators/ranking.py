"""Running totals, exact quantiles and ranks over a whole table without sorting it in one task.

The table is first reduced to one row per distinct value. It is dealt to tasks by ranges of the order, each task adds up its
own range, and the ranges' totals, one row per task, give each range its offset (a prefix scan over ranges). Results are
exact wherever the ranges end, and there may be as many ranges as there are shuffle partitions.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from gridpulse.sources.store import materialize


def _scan(sums: list[str], keys: list[str]):
    """Running sums of sorted batches within each key, and the number of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, carry = TaskContext.get().partitionId(), None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            named = list(zip(*[batch.column(k).to_pylist() for k in keys])) if keys else [()] * batch.num_rows
            cuts = [0, *(i for i in range(1, len(named)) if named[i] != named[i - 1]), len(named)] if keys else [0, len(named)]
            values = {c: batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in sums}
            totals = {c: np.empty_like(v) for c, v in values.items()}
            for lo, hi in zip(cuts, cuts[1:]):
                if named[lo] != last:
                    last, carry = named[lo], dict.fromkeys(sums, 0)
                for c, v in values.items():
                    totals[c][lo:hi] = np.cumsum(v[lo:hi]) + carry[c]
                    carry[c] = totals[c][hi - 1]
            made = [pa.array(totals[c]) for c in sums] + [pa.array(np.full(batch.num_rows, part, dtype=np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *[f"cum_{c}" for c in sums], "__range"])

    return run


def running_totals(df: DataFrame, order: str, sums: list[str], keys: list[str] = (), descending: bool = False,
                   ranges: int | None = None) -> DataFrame:
    """Add cum_<col>: total of <col> over this and all earlier rows in `order`, per `keys`.

    Expects one row per (keys, order), and numbers to sum (a missing one counts as 0). `keys` must be few (column names,
    splits), not data values. Ranges are as many as shuffle partitions unless given.
    """
    keys, spark = list(keys), df.sparkSession
    df = df.withColumns({c: F.col(c).cast("double" if dict(df.dtypes)[c] in ("float", "double") else "long") for c in sums})
    kinds = {c: DoubleType() if t == "double" else LongType() for c, t in df.dtypes if c in sums}
    schema = StructType([*df.schema.fields, *[StructField(f"cum_{c}", kinds[c]) for c in sums], StructField("__range", IntegerType())])
    by = [*keys, F.col(order).desc() if descending else F.col(order).asc()]
    d = materialize(df, "distinct")  # choosing the ranges reads it once more
    dealt = d.repartitionByRange(ranges, *by) if ranges else d.repartitionByRange(*by)
    scanned = materialize(dealt.sortWithinPartitions(*by).mapInArrow(_scan(list(sums), keys), schema), "ranked")
    totals = scanned.groupBy(*keys, "__range").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(  # at most one row per key and task
        *keys, "__range", *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in sums]
    )
    offsets = F.broadcast(spark.createDataFrame(offsets.collect(), offsets.schema))
    return (
        scanned.join(offsets, [*keys, "__range"])
        .withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"__o_{c}") for c in sums})
        .drop("__range", *[f"__o_{c}" for c in sums])
    )


def _counts(df: DataFrame, cols: list[str]) -> DataFrame:
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(df: DataFrame, cols: list[str], qs: list[float], accuracy: int = 10_000) -> DataFrame:
    """(column, q, quantile) with linear interpolation between neighbours; missing values are left out.

    A sketch brackets each quantile: its rank error is at most n / accuracy, so the true neighbours lie inside. Then one
    pass counts what is below each bracket, and only the values inside it are shuffled and ranked.
    """
    spark = df.sparkSession
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    sizes = d.agg(*[F.count(c).alias(c) for c in cols]).first().asDict()
    cols = [c for c in cols if sizes[c]]
    want = [(c, float(q)) for c in cols for q in qs]
    if not want:
        return spark.createDataFrame([], "column string, q double, quantile double")

    def edge(c: str, q: float, side: int) -> Column:
        at = min(1.0, max(0.0, q + side * (2.0 / accuracy + 2.0 / sizes[c])))
        return F.percentile_approx(F.col(c), at, accuracy)

    edges = d.agg(*[edge(c, q, side).alias(f"{side}_{i}") for i, (c, q) in enumerate(want) for side in (-1, 1)]).first()
    low, high = ([edges[f"{side}_{i}"] for i in range(len(want))] for side in (-1, 1))
    below = d.agg(*[F.count_if(F.col(c) < low[i]).alias(str(i)) for i, (c, _) in enumerate(want)]).first()
    inside = F.array(*[
        F.when(F.col(c).between(low[i], high[i]), F.struct(F.lit(i).alias("i"), F.col(c).alias("value"))) for i, (c, _) in enumerate(want)])
    counts = d.select(F.explode(F.filter(inside, lambda x: x.isNotNull())).alias("x")).groupBy("x.i", "x.value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, "value", ["n"], ["i"])
    targets = spark.createDataFrame(
        [(i, c, q, q * (sizes[c] - 1), below[str(i)]) for i, (c, q) in enumerate(want)],
        "i int, column string, q double, __h double, __below long")  # columns x quantiles rows

    def holds(rank: Column) -> Column:
        last = F.col("__below") + F.col("cum_n")
        return (last - F.col("n") <= rank) & (rank < last)

    lo, hi = F.floor("__h"), F.ceil("__h")
    found = ranked.join(F.broadcast(targets), "i").where(holds(lo) | holds(hi))
    left, right = F.max(F.when(holds(lo), F.col("value"))), F.max(F.when(holds(hi), F.col("value")))
    return found.groupBy("column", "q").agg(left.alias("__lo"), right.alias("__hi"), F.max("__h").alias("__h")).select(
        "column", "q", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (F.col("__h") - F.floor("__h"))).alias("quantile")
    )


def approximate_quantiles(df: DataFrame, cols: list[str], qs: list[float], accuracy: int = 100_000) -> DataFrame:
    """Single-pass variant of the same table for very wide inputs."""
    one = df.agg(*[F.percentile_approx(F.col(c).cast("double"), list(qs), accuracy).alias(c) for c in cols])
    return one.unpivot([], cols, "column", "v").select("column", F.posexplode("v").alias("i", "quantile")).select(
        "column", F.element_at(F.array(*[F.lit(float(v)) for v in qs]), F.col("i") + 1).alias("q"), "quantile"
    )


def value_at_rank(df: DataFrame, col: str, rank: int) -> DataFrame:
    """One row: the value at 0-based position `rank` of the sorted column."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, col, ["n"])
    return ranked.where((F.col("cum_n") - F.col("n") <= rank) & (F.col("cum_n") > rank)).select(col)


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, distinct_values) exactly: one shuffle of distinct pairs instead of one expansion per column."""
    return _counts(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))


def split_position(rows: int, ratio: float) -> int:
    return int(math.floor(rows * ratio))
