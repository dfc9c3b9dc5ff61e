"""Column helpers shared by all operators. Everything here stays in whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def null_double() -> Column:
    return F.lit(None).cast("double")


def finite(x: Column) -> Column:
    """NaN and infinities become NULL, so comparisons behave as they do on missing values."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def not_nan(x: Column) -> Column:
    return F.nanvl(x, null_double())


def ratio(num: Column, den: Column) -> Column:
    """Division that yields NULL on a zero denominator whatever the ANSI setting."""
    return F.try_divide(num, den)


def flag(cond: Column) -> Column:
    """1/0 indicator; an unknown condition counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def fixed(x: Column, digits: int = 6) -> Column:
    """Half-up rounding with a nudge far above float noise, so decimal ties round the same in every engine."""
    return F.round(x + F.lit(1e-9), digits)


def epoch_hour(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / 3600).cast("long")


def hour_start(hour: Column) -> Column:
    return F.timestamp_seconds(hour * 3600)


def nearest_hour(ts: Column) -> Column:
    """Epoch hour nearest to ts; an exact half goes to the even hour."""
    return F.bround(F.unix_micros(ts.cast("timestamp")) / F.lit(3.6e9)).cast("long")


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(8.64e10)


def min_max_scale(x: Column, lo: Column, hi: Column) -> Column:
    return (x - lo) / F.greatest(hi - lo, F.lit(1e-12))


def batch_scale(x: Column, lo: Column, hi: Column) -> Column:
    """Scaling of a request by its own range; a constant request scores 0."""
    return (x - lo) / (hi - lo + F.lit(1e-8))


def weighted_score(first: Column, second: Column, alpha: float) -> Column:
    return F.lit(alpha) * first + F.lit(1.0 - alpha) * second


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def float_text_to_double(text: Column) -> Column:
    """Text to number: plain, else with decimal comma. Type suffixes such as 1d are not numbers."""
    s = F.trim(text)
    numeric = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
    named = F.lower(s).rlike(r"^[+-]?(nan|inf|infinity)$")
    dotted = F.replace(s, F.lit(","), F.lit("."))
    return (
        F.when(s.rlike(numeric) | named, s.try_cast("double"))
        .when(dotted.rlike(numeric), dotted.try_cast("double"))
    )


def one_decimal(x: Column) -> Column:
    """Non-negative number as text with one decimal, rounded by its exact binary value and half to even.

    The built-in formatter rounds the shortest decimal form half up instead. With m/20 the middle of the cell that x
    lies in, (16x - m) + 4x is 20x - m without rounding error, so its sign decides exactly.
    """
    cell = F.floor(x * 10)
    middle = (cell * 2 + 1).cast("double")
    rest = (x * 16 - middle) + x * 4
    up = (rest > 0) | ((rest == 0) & (cell % 2 == 1))
    return F.format_string("%.1f", (cell + up.cast("int")) / F.lit(10.0))


def number_text(x: Column) -> Column:
    """A double as decimal text: plain from 0.0001 up to 1e16, otherwise with an exponent of at least two digits."""
    java, size = x.cast("string"), F.abs(x)

    def plain(scale: int) -> Column:
        digits = F.regexp_replace(x.cast(f"decimal(38,{scale})").cast("string"), "0+$", "")
        return F.regexp_replace(digits, r"\.$", ".0")

    # the fewest digits that read back as the same number
    full = F.format_string("%.16e", x)
    cut = F.regexp_replace(full, "[0-9]e", "e")  # rounding up half-way cases may miss the number, cutting them off does not
    tries = [F.format_string("%.14e", x), F.format_string("%.15e", x), cut, full]
    short = F.coalesce(*[F.when(t.cast("double") == x, t) for t in tries])
    short = F.regexp_replace(short, r"\.?0*e", "e")
    return (
        F.when(~F.contains(java, F.lit("E")), java)
        .when((size >= 1e7) & (size < 1e16), plain(12))
        .when((size >= 1e-4) & (size < 1e-3), plain(24))
        .otherwise(short)
    )
