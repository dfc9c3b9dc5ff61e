"""Thermal cycles: peaks of a series and their count in a trailing window.

A peak is a local maximum (a plateau counts once, at its middle) not lower than the series mean; of peaks closer than
`distance` rows of the non-null series only the higher survives, the later one on equal height.

Suppression in order of height looks sequential, and on a rising series it is: every candidate waits for the next one. But
what a chunk of the series needs to know of its neighbours is bounded: survivors are `distance` rows apart, so at most
one lies close enough to each edge.

1. Each chunk settles what does not depend on its edges and, for every possible survivor beyond either edge, works out
   which survivors of its own lie near the edges: a table of a few rows, whatever the chunk's length.
2. Tables of neighbouring chunks must agree on the survivors at their common edge. As every candidate waits for higher
   ones only, exactly one choice agrees along the whole series. It is found from one small table per chunk.
3. With the survivors beyond its edges known, each chunk names its peaks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridpulse.functions.joins import attach_by_key
from gridpulse.operators.series import CHUNK, HOME, HOURLY, Series, fill_across, over_chunks, with_halo, with_position
from gridpulse.sources.store import materialize

WEEK_ROWS = 168
NONE = -1  # no survivor close enough to the edge


@dataclass(frozen=True)
class Positions(Series):
    """A series in row positions: chunks and halos count rows of the non-null series."""

    time: str = "pos"

    def hour(self) -> Column:
        return F.col(self.time)


def candidates(df: DataFrame, col: str, s: Series = HOURLY) -> DataFrame:
    """(keys, time, pos, height) of local maxima; plateaus are collapsed to the middle row. pos counts non-null rows."""
    x, pos, by_row = F.col("height"), F.col("pos"), Positions(s.keys, chunk_hours=s.chunk_hours)
    d = with_position(df.where(F.col(col).isNotNull()).select(*s.keys, s.time, F.col(col).alias("height")), s)
    d = over_chunks(d, [lambda w: {"__prev": F.lag(x).over(w), "__next": F.lead(x).over(w)}], by_row, before=1, after=1)
    starts = F.col("__prev").isNull() | (F.col("__prev") != x)
    ends = F.col("__next").isNull() | (F.col("__next") != x)
    runs = fill_across(
        d,
        last={
            "run_start": F.when(starts, pos),
            "rise": F.when(starts, F.coalesce((F.col("__prev") < x).cast("int"), F.lit(0))),
        },
        first={
            "run_end": F.when(ends, pos),
            "fall": F.when(ends, F.coalesce((F.col("__next") < x).cast("int"), F.lit(0))),
        },
        s=by_row,
    )
    middle = F.floor((F.col("run_start") + F.col("run_end")) / 2)
    return runs.where((F.col("rise") == 1) & (F.col("fall") == 1) & (pos == middle)).select(
        *s.keys, s.time, "pos", "height"
    )


class _Chunk:
    """Candidates of one chunk and those of its neighbours that are close enough to matter."""

    def __init__(self, pdf: pd.DataFrame, distance: int):
        self.distance = distance
        pos, height, own = pdf["pos"].to_numpy(), pdf["height"].to_numpy(), pdf["own"].to_numpy()
        self.base = int(pos.min()) - distance
        self.cells = int(pos.max()) - self.base + distance + 1
        self.rank = dict(zip(pos.tolist(), zip(height.tolist(), pos.tolist())))
        mine = sorted(pos[own].tolist(), key=self.rank.get, reverse=True)
        self.low, self.high = min(mine), max(mine)
        self.left = [p for p in pos[~own].tolist() if p < self.low]
        self.right = [p for p in pos[~own].tolist() if p > self.high]
        # settled without a look beyond the edges; the rest may depend on a higher neighbour's fate
        self.blocked = np.zeros(self.cells, dtype=bool)
        doubt = self.blocked.copy()
        self.kept, self.open = [], []
        for p in mine:
            if self.blocked[p - self.base]:
                continue
            if doubt[p - self.base] or any(abs(p - o) < distance and self.rank[o] > self.rank[p] for o in (*self.left, *self.right)):
                self.open.append(p)
                self._mark(doubt, p)
            else:
                self.kept.append(p)
                self._mark(self.blocked, p)

    def _mark(self, cells: np.ndarray, p: int) -> None:
        cells[p - self.base - self.distance + 1 : p - self.base + self.distance] = True

    def survivors(self, left: int, right: int) -> list[int] | None:
        """Own survivors if those beyond the edges are `left` and `right`; None if that contradicts them."""
        beyond = [p for p in (left, right) if p != NONE]
        if any(self.blocked[p - self.base] for p in beyond):
            return None
        blocked, kept = self.blocked.copy(), list(self.kept)
        for p in self.open:
            if blocked[p - self.base]:
                continue
            near = [o for o in beyond if abs(p - o) < self.distance]
            if any(self.rank[o] > self.rank[p] for o in near):
                continue
            if near:
                return None
            kept.append(p)
            self._mark(blocked, p)
        return kept

    def table(self) -> list[tuple[int, int, int, int]]:
        """(left, right, own first, own last) for all choices beyond the edges; own ones only where a neighbour sees them."""
        out = []
        for left in (NONE, *self.left):
            for right in (NONE, *self.right):
                kept = self.survivors(left, right)
                if kept is not None:
                    first, last = min(kept, default=NONE), max(kept, default=NONE)
                    out.append((left, right, first, last))
        return out


def _agree(chunks: list[tuple[int, list[tuple[int, int, int, int]]]], chunk_rows: int, distance: int) -> list[tuple[int, int, int]]:
    """(chunk, left, right): the one choice on which the tables of all neighbouring chunks agree."""

    def seen(p: int, edge: int) -> int:
        return p if p != NONE and abs(p - edge) < distance else NONE

    # (last survivor, assumed one beyond) -> choices so far; for each assumption there is one way at most
    states: dict[tuple[int, int], tuple] = {(NONE, NONE): ()}
    before = None
    for chunk, table in chunks:
        alone = before is None or chunk != before + 1
        start = next((v for (_, right), v in states.items() if right == NONE), None) if alone else None
        after: dict[tuple[int, int], tuple] = {}
        # what the neighbours see of a chunk lies within `distance` of the nearest row beyond its edge
        low, high = chunk * chunk_rows - 1, (chunk + 1) * chunk_rows
        for left, right, first, last in table:
            came = start if alone and left == NONE else states.get((left, seen(first, low)))
            if came is not None:
                after[seen(last, high), right] = (came, (chunk, left, right))
        states, before = after, chunk
    chosen, out = next(v for (last, right), v in states.items() if right == NONE), []
    while chosen:
        chosen, step = chosen
        out.append(step)
    return out


def peaks(df: DataFrame, col: str, distance: int = 12, min_rows: int = 48, s: Series = HOURLY) -> DataFrame:
    """(keys, time, pos, height) of the surviving peaks; series with at most `min_rows` values have none.

    The candidates are written before they are suppressed, as two passes read them. A task holds one chunk at a time.
    """
    if s.chunk_hours < 2 * distance:
        raise ValueError("a chunk must be at least twice as long as the distance between peaks")
    facts = df.groupBy(*s.keys).agg(F.avg(col).alias("__mean"), F.count(col).alias("__len"))
    found = attach_by_key(candidates(df, col, s), facts, list(s.keys))
    live = materialize(found.where((F.col("height") >= F.col("__mean")) & (F.col("__len") > min_rows)).drop("__mean", "__len"), "candidates")

    by_row = Positions(s.keys, chunk_hours=s.chunk_hours)
    near = with_halo(live, by_row, distance - 1, distance - 1).withColumn("own", F.col(CHUNK) == F.col(HOME)).drop(HOME)
    keys = live.select(*s.keys).schema
    chunk_rows = s.chunk_hours
    declared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)

    def transfer(pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf["own"].any():
            return pd.DataFrame(columns=[*s.keys, CHUNK, "table"])
        table = np.array(_Chunk(pdf, distance).table(), dtype="<i8").tobytes()
        return pdf[[*s.keys, CHUNK]].head(1).assign(table=table)

    def agree(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted((c, [tuple(r) for r in np.frombuffer(t, "<i8").reshape(-1, 4).tolist()]) for c, t in zip(pdf[CHUNK].tolist(), pdf["table"]))
        out = pd.DataFrame(_agree(rows, chunk_rows, distance), columns=[CHUNK, "left", "right"])
        for k in s.keys:
            out[k] = pdf[k].iloc[0]
        return out[[*s.keys, CHUNK, "left", "right"]]

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = set(_Chunk(pdf, distance).survivors(int(pdf["left"].iloc[0]), int(pdf["right"].iloc[0])))
        return pdf.loc[pdf["own"] & pdf["pos"].isin(kept), [*s.keys, s.time, "pos", "height"]]

    tables = near.select(*s.by_chunk, "pos", "height", "own").groupBy(*s.by_chunk).applyInPandas(transfer, f"{declared}, `{CHUNK}` long, table binary")
    choices = tables.groupBy(*s.keys).applyInPandas(agree, f"{declared}, `{CHUNK}` long, left long, right long")
    return near.join(choices, s.by_chunk).groupBy(*s.by_chunk).applyInPandas(settle, live.schema)


def peak_counts(df: DataFrame, col: str = "temp_oil_value", out: str = "thermal_cycles_7d", window: int = WEEK_ROWS,
                distance: int = 12, min_rows: int = 48, s: Series = HOURLY) -> DataFrame:
    """Peaks among the current row and the `window` rows before it; NULL for series too short to have the feature."""
    marks = peaks(df, col, distance, min_rows, s=s).select(*s.keys, s.time, F.lit(1).alias("__peak"))
    enough = df.groupBy(*s.keys).agg((F.count(col) > min_rows).alias("__enough"))
    d = attach_by_key(df.join(marks, [*s.keys, s.time], "left"), enough, list(s.keys))
    count = F.coalesce(F.sum("__peak").over(s.ahead().rowsBetween(-window, 0)), F.lit(0)).cast("double")
    return over_chunks(
        d, [lambda w: {out: F.when(F.col("__enough"), count)}], s, before=window, drop=["__peak", "__enough"]
    )
