"""Principal components of lookback windows from lagged products of rows; no window is ever built.

A window of L rows of f features is a vector of L * f numbers. The products of its parts at places a and b depend on the
rows b - a apart, so the blocks of the windows' product matrix are nearly constant along diagonals: the first block of
each diagonal is one product of two shifted slices of the rows, and every next one differs only by the rows where runs of
windows begin or end. Errors need no windows either: a projection is a sum of L products of shifted slices.

Series are cut into chunks of row positions with the L - 1 rows before them. Tasks add up their chunks and send one matrix
each, as large as the one that any distributed principal component analysis of these windows sends.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gridpulse.catalog import DEFAULT_PARAMS
from gridpulse.models.reconstruction import Reconstruction
from gridpulse.operators.peaks import Positions
from gridpulse.operators.series import CHUNK, HOME, HOURLY, Series, with_halo, with_position


def _rows_by_chunk(df: DataFrame, cols: list[str], lookback: int, horizon_shift: int, s: Series) -> DataFrame:
    """(keys, chunk, time, pos, hour, closes, x): rows and those before the chunk; `closes` marks where a window may end."""
    d = with_position(df.select(*s.keys, s.time, *cols), s, "pos", length="__len")
    d = with_halo(d, Positions(s.keys, chunk_hours=s.chunk_hours), lookback - 1, 0)
    closes = (F.col(CHUNK) == F.col(HOME)) & (F.col("pos") < F.col("__len") - horizon_shift)
    return d.select(*s.by_chunk, s.time, "pos", s.hour().alias("hour"), closes.alias("closes"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))


def _ends(pos: np.ndarray, hour: np.ndarray, closes: np.ndarray, lookback: int, allow_gaps: bool) -> np.ndarray:
    """For each row of a chunk, whether a full window ends there."""
    full = np.zeros(len(pos), dtype=bool)
    at = np.arange(lookback - 1, len(pos))
    full[at] = closes[at] & (pos[at] - pos[at - lookback + 1] == lookback - 1)
    if not allow_gaps:
        full[at] &= hour[at] - hour[at - lookback + 1] == lookback - 1
    return full


def add_products(total: np.ndarray, sums: np.ndarray, x: np.ndarray, full: np.ndarray, lookback: int) -> None:
    """Add the products and sums of the windows that end at the rows `full` of x (rows, features).

    total[a, b] is the block of places a <= b, sums[a] the sum at place a.
    """
    last = lookback - 1
    ends = np.flatnonzero(full)
    if not len(ends):
        return
    for a in range(lookback):
        sums[a] += x[ends - last + a].sum(0)
    # where runs of windows begin, and the rows right after they end
    step = np.diff(np.concatenate([[0], full.astype(np.int8), [0]]))
    begin, after = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    for apart in range(lookback):
        left, right = x[ends - last], x[ends - last + apart]
        block = left.T @ right
        total[0, apart] += block
        for a in range(1, lookback - apart):
            # one place on: each run loses its first row pair and gains the one after its last
            lose, gain = begin - last + a - 1, after - last + a - 1
            block = block - x[lose].T @ x[lose + apart] + x[gain].T @ x[gain + apart]
            total[a, a + apart] += block


def _chunks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole chunks from rows sorted by them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        pdf = batch.to_pandas()
        if not len(pdf):
            continue
        names = pdf[keys].apply(tuple, axis=1) if len(keys) > 1 else pdf[keys[0]]
        cuts = [0, *(np.flatnonzero((names != names.shift()).to_numpy()[1:]) + 1).tolist(), len(pdf)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and tuple(held[-1][keys].iloc[-1]) != tuple(pdf[keys].iloc[lo]):
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(pdf.iloc[lo:hi])
    if held:
        yield pd.concat(held, ignore_index=True)


def fit_windows(df: DataFrame, cols: list[str], k: int = 8, lookback: int = DEFAULT_PARAMS.lookback,
                horizon_shift: int = DEFAULT_PARAMS.horizon_shift, allow_gaps: bool = False, s: Series = HOURLY) -> Reconstruction:
    """The reconstruction model of all full windows of `lookback` rows; same windows as `prep.sequences`.

    Rows are shuffled once. Raises ValueError where fewer than two windows are full.
    """
    width, keys = len(cols), s.by_chunk

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, n = np.zeros((lookback, lookback, width, width)), np.zeros((lookback, width)), 0
        for pdf in _chunks(batches, keys):
            full = _ends(pdf["pos"].to_numpy(), pdf["hour"].to_numpy(), pdf["closes"].to_numpy(), lookback, allow_gaps)
            add_products(total, sums, np.stack(pdf["x"].tolist()), full, lookback)
            n += int(full.sum())
        if n:
            flat = total.transpose(0, 2, 1, 3).reshape(lookback * width, lookback * width)
            rows = [np.append(line, [m, n]) for line, m in zip(flat, sums.reshape(-1))]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["row", "line"])

    d = _rows_by_chunk(df, cols, lookback, horizon_shift, s).select(*keys, "pos", "hour", "closes", "x")
    parts = d.repartition(*keys).sortWithinPartitions(*keys, "pos").mapInArrow(gather, "row int, line array<double>")
    lines = parts.select("row", F.posexplode("line").alias("i", "v")).groupBy("row", "i").agg(F.sum("v").alias("v"))
    lines = lines.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("line"))
    found = {r["row"]: np.array(r["line"]) for r in lines.collect()}  # as many rows as a window has numbers
    if not found or (n := found[0][-1]) < 2:
        raise ValueError("fewer than two full windows")
    matrix = np.stack([found[i] for i in range(lookback * width)])
    mean, upper = matrix[:, -2] / n, np.triu(matrix[:, :-2])
    # below the diagonal blocks nothing was added up; the diagonal blocks are whole
    products = upper + np.triu(upper, 1).T
    values, vectors = np.linalg.eigh((products - n * np.outer(mean, mean)) / (n - 1))
    picked = vectors[:, np.argsort(values)[::-1][: min(k, len(mean))]]
    picked = picked * np.where(np.take_along_axis(picked, np.abs(picked).argmax(0)[None, :], 0) < 0, -1.0, 1.0)
    return Reconstruction(list(cols), lookback, mean, picked)


def window_errors(df: DataFrame, model: Reconstruction, horizon_shift: int = DEFAULT_PARAMS.horizon_shift, allow_gaps: bool = False,
                  s: Series = HOURLY) -> DataFrame:
    """(keys, time, per_feature, recon_error) at each row that closes a full window; as `Reconstruction.errors` of `sequences`."""
    lookback, width, keys = model.steps, len(model.features), list(s.keys)
    mean, parts = model.mean.reshape(lookback, width), model.components.reshape(lookback, width, -1)
    d = _rows_by_chunk(df, model.features, lookback, horizon_shift, s)
    schema = df.select(*keys, s.time).schema.add("per_feature", ArrayType(DoubleType())).add("recon_error", DoubleType())

    def errors(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        ends = np.flatnonzero(_ends(pdf["pos"].to_numpy(), pdf["hour"].to_numpy(), pdf["closes"].to_numpy(), lookback, allow_gaps))
        if not len(ends):
            return pdf.loc[ends, [*keys, s.time]].assign(per_feature=pd.Series(dtype=object), recon_error=pd.Series(dtype=float))
        x = np.stack(pdf["x"].tolist())
        at = lambda a: x[ends - lookback + 1 + a] - mean[a]
        shadow = sum(at(a) @ parts[a] for a in range(lookback))
        by_feature = sum((at(a) - shadow @ parts[a].T) ** 2 for a in range(lookback)) / lookback
        out = pdf.loc[ends, [*keys, s.time]].reset_index(drop=True)
        return out.assign(per_feature=list(by_feature), recon_error=by_feature.mean(axis=1))

    return d.groupBy(*s.by_chunk).applyInPandas(errors, schema)
