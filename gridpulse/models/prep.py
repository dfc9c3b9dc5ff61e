"""Model input: imputation, scaling, label encoding and lookback sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridpulse.catalog import DEFAULT_PARAMS, NORMAL
from gridpulse.functions.columns import finite
from gridpulse.operators.ranking import approximate_quantiles, exact_quantiles
from gridpulse.operators.series import HOURLY, Series, over_chunks, rows, with_position


def clean_infinite(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c).cast("double")) for c in cols})


def train_medians(train: DataFrame, cols: list[str], exact: bool = True) -> dict[str, float]:
    """Column medians of the training rows: one number per column comes back to the driver."""
    find = exact_quantiles if exact else approximate_quantiles
    return {r["column"]: r["quantile"] for r in find(clean_infinite(train, cols), cols, [0.5]).collect()}


def impute_medians(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return clean_infinite(df, list(medians)).fillna(medians)


def fit_scaler(df: DataFrame, cols: list[str], rows_used: Column | None = None) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column over the rows used (normal operation); constant columns get 1."""
    d = df.where(rows_used) if rows_used is not None else df
    aggs = [f(F.col(c).cast("double")).alias(f"{n}__{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    got = d.agg(*aggs).first()
    return {c: (got[f"m__{c}"] or 0.0, got[f"s__{c}"] or 1.0) for c in cols}


def scale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(sd) for c, (m, sd) in scaler.items()})


def encode_labels(df: DataFrame, col: str, out: str = "label_id"):
    """Alphabetical label ids; returns the encoded frame and the label list."""
    from pyspark.ml.feature import StringIndexer

    model = StringIndexer(inputCol=col, outputCol="__idx", stringOrderType="alphabetAsc").fit(df)
    encoded = model.transform(df).withColumn(out, F.col("__idx").cast("int")).drop("__idx")
    return encoded, list(model.labels)


def normal_class(df: DataFrame, col: str) -> str:
    """NORMAL, or the most frequent class where it does not occur."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    pick = counts.orderBy((F.col(col) == NORMAL).desc(), F.col("n").desc(), F.col(col)).limit(1).first()
    return pick[col] if pick else NORMAL


def sequences(df: DataFrame, cols: list[str], lookback: int = DEFAULT_PARAMS.lookback,
              horizon_shift: int = DEFAULT_PARAMS.horizon_shift, allow_gaps: bool = False, s: Series = HOURLY) -> DataFrame:
    """(keys, time, seq): the last `lookback` rows as array<array<double>>, at each row that closes a full window.

    The last `horizon_shift` rows of a series close none. Windows must cover consecutive hours unless allow_gaps,
    where they run over row positions instead.
    """
    d = with_position(df.select(*s.keys, s.time, *cols), s, "__pos", length="__len")
    p = s
    if allow_gaps:
        p = Series(s.keys, "__at", s.chunk_hours)
        d = d.withColumn("__at", F.timestamp_seconds(F.col("__pos") * 3600))
    row = F.array(*[F.col(c).cast("double") for c in cols])
    d = over_chunks(
        d.withColumn("__row", row).select(*s.keys, s.time, "__pos", "__len", "__row", *(["__at"] if allow_gaps else [])),
        [
            lambda w: {
                "seq": F.collect_list("__row").over(rows(w, lookback)),
                "__first": F.lag(s.hour(), lookback - 1).over(w),
            }
        ],
        p, before=lookback,
    )
    full = (F.size("seq") == lookback) & (F.col("__pos") < F.col("__len") - horizon_shift)
    if not allow_gaps:
        full = full & (s.hour() - F.col("__first") == lookback - 1)
    return d.where(full).select(*s.keys, s.time, "seq")
