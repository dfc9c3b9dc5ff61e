"""Names, types, plausibility and missing values of the hourly panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridpulse.catalog import (
    ACCENTED, CATEGORIES, DEFAULT_NAME, NAME_TOKENS, PLAIN, SIGNAL_ALIASES, category_of, plausible_range,
)
from gridpulse.operators.series import HOURLY, Series, fill_across, with_position


# ---- names ------------------------------------------------------------------------------------------------------

def standard_name_of(name: Column) -> Column:
    """Panel name of a column name. Tables of the catalogue drive it: aliases first, then tokens, then plain letters and digits."""
    known = F.create_map(*[F.lit(x) for a, sig in SIGNAL_ALIASES.items() for x in (f"{a}_value", sig)])
    token = [(F.replace, F.lit(old), F.lit(new)) for old, new in NAME_TOKENS.items()]
    letters = [(F.translate, ACCENTED, PLAIN)]
    shape = [(F.regexp_replace, p, n) for p, n in ((r"\s+", "_"), (r"[^a-z0-9_]", ""), (r"_+", "_"), (r"^_|_$", ""))]
    out = reduce(lambda x, step: step[0](x, *step[1:]), [*token, *letters, *shape], F.lower(name))
    return F.coalesce(F.try_element_at(known, name), F.when(out != "", out), F.lit(DEFAULT_NAME))


def standard_name_column(tag: Column) -> Column:
    """Panel name of a tag."""
    return standard_name_of(F.concat(tag, F.lit("_value")))


def numbered_names(names: DataFrame) -> DataFrame:
    """(position, name) with _1, _2, ... added to repeats, in order of position."""
    nth = F.row_number().over(Window.partitionBy("name").orderBy("position")) - 1
    return names.withColumn("name", F.when(nth > 0, F.concat_ws("_", "name", nth)).otherwise(F.col("name")))


def rename_columns(df: DataFrame, keep: tuple = ("asset_id", "ts")) -> DataFrame:
    """Columns by their standard names; one small job over the column names, which the schema bounds."""
    data = [c for c in df.columns if c not in keep]
    listed = df.sparkSession.createDataFrame(list(enumerate(data)), "position int, name string")
    found = numbered_names(listed.select("position", standard_name_of(F.col("name")).alias("name"))).collect()
    return df.withColumnsRenamed({data[r["position"]]: r["name"] for r in found})


# ---- types and ranges -------------------------------------------------------------------------------------------

def signal_columns(df: DataFrame, keep: tuple = ("asset_id", "ts")) -> list[str]:
    return [c for c in df.columns if c not in keep]


def nullify_implausible(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Numeric cast (bad text becomes NULL), then values outside the plausibility range become NULL."""
    exprs = {}
    for c in cols or signal_columns(df):
        x = F.col(c).try_cast("double")
        x = F.nanvl(x, F.lit(None).cast("double"))
        bounds = plausible_range(c)
        exprs[c] = F.when(x.between(*bounds), x) if bounds else x
    return df.withColumns(exprs)


# ---- filling ----------------------------------------------------------------------------------------------------

def _fill(df: DataFrame, s: Series, line: list[str], edges: str, forward: list[str], backward: list[str],
          axis: Column) -> DataFrame:
    """One pass over the chunks for every column to fill: straight lines, forward fill, backward fill.

    With edges="inside" lines and forward fills end at the last value of a series."""
    inside = edges == "inside"
    last, first = {}, {}
    for c in line:
        known = F.when(F.col(c).isNotNull(), F.col("__x"))  # the named column keeps both branches of the fill alike
        last |= {f"__pv_{c}": F.col(c), f"__pt_{c}": known}
        first |= {f"__nv_{c}": F.col(c), f"__nt_{c}": known}
    for c in [*forward, *backward]:
        last[f"__pv_{c}"] = F.col(c)
    for c in [*backward, *(forward if inside else ())]:
        first[f"__nv_{c}"] = F.col(c)
    if not last:
        return df
    d = fill_across(df.withColumn("__x", axis), last, first, s)
    out = {}
    for c in line:
        pv, pt, nv, nt = (F.col(f"__{k}_{c}") for k in ("pv", "pt", "nv", "nt"))
        between = pv + F.try_divide(nv - pv, nt - pt) * (F.col("__x") - pt)
        edge = {"both": [pv, nv], "forward": [pv], "inside": []}[edges]
        out[c] = F.coalesce(F.col(c), F.when(pt.isNotNull() & nt.isNotNull(), between), *edge)
    for c in forward:
        out[c] = F.when(F.col(f"__nv_{c}").isNotNull(), F.col(f"__pv_{c}")) if inside else F.col(f"__pv_{c}")
    for c in backward:
        out[c] = F.coalesce(F.col(f"__pv_{c}"), F.col(f"__nv_{c}"))
    return d.withColumns(out).drop("__x", *last, *first)


def interpolate(df: DataFrame, cols: list[str], by: str = "time", edges: str = "forward", s: Series = HOURLY) -> DataFrame:
    """Straight-line filling weighted by elapsed time or by row position.

    edges="inside" fills between the first and the last value only; edges="forward" also holds the last value to the end
    of the rows; edges="both" holds values at both ends.
    """
    if by == "position":
        d = with_position(df, s, "__pos")
        return _fill(d, s, cols, edges, [], [], F.col("__pos").cast("double")).drop("__pos")
    return _fill(df, s, cols, edges, [], [], F.unix_micros(F.col(s.time)).cast("double"))


def fill_forward(df: DataFrame, cols: list[str], then_back: bool = False, s: Series = HOURLY) -> DataFrame:
    return _fill(df, s, [], "forward", [] if then_back else cols, cols if then_back else [], F.lit(0.0))


def fill_edges(df: DataFrame, time: list[str], forward: list[str], s: Series = HOURLY) -> DataFrame:
    """Consolidation fill: time interpolation and forward fill, each between the first and the last value of a tag.

    A tag's hourly series ends at its last reading inside the range, so later hours of the panel stay empty."""
    return _fill(df, s, time, "inside", forward, [], F.unix_micros(F.col(s.time)).cast("double"))


def impute(df: DataFrame, cols: list[str] | None = None, s: Series = HOURLY) -> DataFrame:
    """Final filling: thermal and electrical columns in time with both ends held, mechanical forward then backward."""
    cols = cols or signal_columns(df)
    kinds = {c: category_of(c) for c in cols}
    mech = [c for c in cols if "Mecánica" in kinds[c]]
    line = [c for c in cols if c not in mech and ("Térmica" in kinds[c] or "Eléctrica" in kinds[c])]
    return _fill(df, s, line, "both", [], mech, F.unix_micros(F.col(s.time)).cast("double"))


# ---- missing-value reports --------------------------------------------------------------------------------------

def _null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, missing, total) from one aggregation pass."""
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.unpivot("__n", cols, "column", "missing").withColumnRenamed("__n", "total")


def missing_by_category(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Columns, values, missing values, percent and affected columns per category, plus a __global__ row."""
    cols = cols or signal_columns(df)
    spark = df.sparkSession
    pairs = [(c, cat) for c in cols for cat in [*category_of(c), "__global__"]]
    cats = spark.createDataFrame(pairs, "column string, category string")
    return (
        _null_counts(df, cols)
        .join(F.broadcast(cats), "column")  # one row per column and category: fixed by the schema
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("columns"),
            F.sum("missing").alias("missing"),
            F.sum("total").alias("total"),
            F.count_if(F.col("missing") > 0).alias("affected"),
        )
        .withColumn("percent", F.coalesce(F.try_divide(F.col("missing") * 100.0, F.col("total")), F.lit(0.0)))
    )
