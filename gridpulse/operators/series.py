"""Exact window operators over time series of any length.

A window keyed by asset alone would put a whole asset into one task. Here every series is cut into time chunks and
windows are keyed by (asset, chunk):

* bounded frames: each chunk receives copies of the rows just outside its edges (the halo), the window runs inside
  the chunk and the copies are dropped again. Only rows near an edge are copied.
* unbounded frames (last value before, first value after): each chunk is summarised to one row, a window over these
  few rows carries the facts across chunks, and they are joined back on (asset, chunk).

Both give the same result as one window over the whole series. Row frames assume the gap-free hourly panel.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from gridpulse.functions.columns import epoch_hour

CHUNK, HOME = "__chunk", "__home"


@dataclass(frozen=True)
class Series:
    """Names the key columns and time column of a panel and the length of a chunk."""

    keys: tuple = ("asset_id",)
    time: str = "ts"
    chunk_hours: int = 4320

    @property
    def by_chunk(self) -> list[str]:
        return [*self.keys, CHUNK]

    def hour(self) -> Column:
        return epoch_hour(F.col(self.time))

    def chunk(self) -> Column:
        return F.floor(self.hour() / self.chunk_hours).cast("long")

    def ahead(self) -> WindowSpec:
        """Time order inside a chunk."""
        return Window.partitionBy(*self.by_chunk).orderBy(F.col(self.time).asc())

    def back(self) -> WindowSpec:
        """Reverse time order inside a chunk: a running frame here is the linear-time form of `following`."""
        return Window.partitionBy(*self.by_chunk).orderBy(F.col(self.time).desc())

    def across(self) -> WindowSpec:
        """Over the chunk summaries of one series, earlier chunks only."""
        return Window.partitionBy(*self.keys).orderBy(F.col(CHUNK).asc()).rowsBetween(Window.unboundedPreceding, -1)

    def across_back(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)


HOURLY = Series()


def rows(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the n-1 rows before it."""
    return w.rowsBetween(-(n - 1), 0)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def add_chunk(df: DataFrame, s: Series = HOURLY) -> DataFrame:
    return df.withColumn(CHUNK, s.chunk())


def by_chunk(df: DataFrame, s: Series = HOURLY) -> DataFrame:
    """Rows shuffled once by (key, chunk).

    The callers split this into a summary branch and a row branch and join them again. Stating the shuffle and the
    non-null keys here gives both branches the same exchange, which Spark then runs once and reuses.
    """
    named = reduce(and_, [F.col(c).isNotNull() for c in s.by_chunk])
    return add_chunk(df, s).where(named).repartition(*s.by_chunk)


def with_halo(df: DataFrame, s: Series, before: int, after: int) -> DataFrame:
    """Copy each row into every chunk that needs it; `before`/`after` are hours looked back/ahead."""
    h, size = s.hour(), s.chunk_hours
    first = F.floor((h - after) / size).cast("long")
    last = F.floor((h + before) / size).cast("long")
    return df.withColumn(HOME, s.chunk()).withColumn(CHUNK, F.explode(F.sequence(first, last)))


Stage = Callable[[WindowSpec], dict]


def over_chunks(
    df: DataFrame, stages: list[Stage], s: Series = HOURLY, before: int = 0, after: int = 0, drop: list[str] = ()
) -> DataFrame:
    """Add columns computed by bounded frames.

    Each stage maps the chunk window to {column: expression}; later stages may use columns of earlier ones. All
    stages share one exchange and one sort.
    """
    out = with_halo(df, s, before, after)
    for stage in stages:
        out = out.withColumns(stage(s.ahead()))
    return out.where(F.col(CHUNK) == F.col(HOME)).drop(CHUNK, HOME, *drop)


def fill_across(
    df: DataFrame, last: dict[str, Column] | None = None, first: dict[str, Column] | None = None, s: Series = HOURLY,
    strict: bool = False,
) -> DataFrame:
    """For each `last` item the latest non-null value at or before the row, for each `first` the earliest at or after.

    strict=True leaves the row itself out.
    """
    last, first = last or {}, first or {}
    src = {f"__src_{k}": e for k, e in {**last, **first}.items()}
    d = by_chunk(df, s).withColumns(src)

    def at(col: str) -> Column:
        return F.when(F.col(col).isNotNull(), F.col(s.time))

    edge = d.groupBy(*s.by_chunk).agg(
        *[F.max_by(f"__src_{k}", at(f"__src_{k}")).alias(f"__edge_{k}") for k in last],
        *[F.min_by(f"__src_{k}", at(f"__src_{k}")).alias(f"__edge_{k}") for k in first],
    )
    carry = edge.select(
        *s.by_chunk,
        *[F.last(f"__edge_{k}", ignorenulls=True).over(s.across()).alias(f"__carry_{k}") for k in last],
        *[F.last(f"__edge_{k}", ignorenulls=True).over(s.across_back()).alias(f"__carry_{k}") for k in first],
    )
    out = d.join(carry, s.by_chunk)
    end = -1 if strict else 0
    fwd = s.ahead().rowsBetween(Window.unboundedPreceding, end)
    bwd = s.back().rowsBetween(Window.unboundedPreceding, end)
    out = out.withColumns(
        {
            **{k: F.coalesce(F.last(f"__src_{k}", True).over(fwd), F.col(f"__carry_{k}")) for k in last},
            **{k: F.coalesce(F.last(f"__src_{k}", True).over(bwd), F.col(f"__carry_{k}")) for k in first},
        }
    )
    return out.drop(CHUNK, *src, *[f"__carry_{k}" for k in [*last, *first]])


def with_position(df: DataFrame, s: Series = HOURLY, name: str = "pos", length: str | None = None) -> DataFrame:
    """0-based row position inside each series and, if asked, the series length, without one task per series."""
    d = add_chunk(df, s)
    # counting needs two narrow columns and is reduced before its shuffle, so it does not share the rows' exchange
    per_chunk = d.groupBy(*s.by_chunk).agg(F.count(F.lit(1)).alias("__n"))
    facts = per_chunk.select(
        *s.by_chunk,
        F.coalesce(F.sum("__n").over(s.across()), F.lit(0)).alias("__before"),
        *([F.sum("__n").over(Window.partitionBy(*s.keys)).alias(length)] if length else []),
    )
    return (
        d.join(facts, s.by_chunk)
        .withColumn(name, (F.row_number().over(s.ahead()) - 1 + F.col("__before")).cast("long"))
        .drop(CHUNK, "__before")
    )


def latest_rows(df: DataFrame, n: int, s: Series = HOURLY) -> DataFrame:
    """Newest n rows of each series; the row_number limit is applied before the shuffle as well."""
    w = Window.partitionBy(*s.keys).orderBy(F.col(s.time).desc())
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
