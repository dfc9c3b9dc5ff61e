"""Attaching per-key facts to rows when one key may own a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridpulse.sources.store import materialize

BROADCAST_BYTES = 16 << 20


def written_bytes(df: DataFrame) -> int:
    """Size of the files behind a table that was just written, as the optimizer knows it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def attach_by_key(df: DataFrame, facts: DataFrame, keys: list[str], broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Left-join `facts`, a narrow table with one row per key.

    The facts are written first, so their size in bytes is known before the large side is touched. Up to
    `broadcast_bytes` of files they are broadcast and the rows of `df` are not shuffled at all. Beyond, both sides are
    shuffled, and adaptive execution cuts the partition of a key that owns a large share of the rows into as many tasks
    as its bytes need.
    """
    facts = materialize(facts, "facts")
    return df.join(F.broadcast(facts) if written_bytes(facts) <= broadcast_bytes else facts, keys, "left")


def attach_bounded(df: DataFrame, facts: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Broadcast join for tables whose row count is fixed by configuration (tag catalogue, rules, column lists)."""
    return df.join(F.broadcast(facts), keys, how)
