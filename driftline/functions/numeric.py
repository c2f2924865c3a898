"""Numeric column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN -> NULL, so aggregates skip it the way ``na.rm`` skips NaN."""
    x = _col(c)
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def row_sum(cols: Sequence[str | Column]) -> Column:
    """Sum across columns, missing values skipped; all missing gives 0.0."""
    total = None
    for c in cols:
        term = F.coalesce(nan_to_null(c).cast("double"), F.lit(0.0))
        total = term if total is None else total + term
    return total


def half_min_log(x: str | Column, minimum: str | Column, base: str = "10") -> Column:
    """``log(x + minimum / 2)`` in base 10 or natural log (``base='e'``)."""
    arg = _col(x) + _col(minimum) / F.lit(2.0)
    if base == "10":
        return F.log10(arg)
    if base == "e":
        return F.log(arg)
    raise ValueError(f"unsupported log base {base!r}")


def fourth_root(x: str | Column) -> Column:
    """``x ** (1/4)``; NaN for negative input, NULL for NULL."""
    return F.pow(_col(x), F.lit(0.25))


def infinity() -> Column:
    """+Infinity literal (the minimum of an empty set in the parity mode)."""
    return F.lit(math.inf)


def short_decimal(x: str | Column, digits: int = 15) -> Column:
    """A double as text in the fewest of at most ``digits`` significant digits that give
    the same value to ``digits`` digits; fixed notation unless the scientific one is
    shorter (``1e+05``, ``1e-05``, ``123456789.125``); the digits left of the point are
    never rounded. NaN and NULL give NULL.
    """
    def written(value: Column) -> Column:
        whole = F.format_string(f"%.{digits - 1}e", F.abs(value))            # d.ddde+XX
        figures = F.regexp_replace(F.replace(F.substring_index(whole, "e", 1), F.lit("."), F.lit("")), "0+$", "")
        return _bound(F.struct(value.alias("value"), F.substring_index(whole, "e", -1).alias("power"), figures.alias("figures")), placed)

    def placed(p: Column) -> Column:
        figures, exponent, count = p["figures"], p["power"].cast("int"), F.length(p["figures"])
        point = F.when(count > 1, F.concat(F.substring(figures, 1, 1), F.lit("."), figures.substr(F.lit(2), count))).otherwise(figures)
        fixed = (F.when(exponent.between(digits, 18), F.abs(p["value"]).cast("long").cast("string"))  # whole: all its digits
                  .when(exponent >= count - 1, F.concat(figures, F.repeat(F.lit("0"), exponent - count + 1)))
                  .when(exponent >= 0, F.concat(figures.substr(F.lit(1), exponent + 1), F.lit("."), figures.substr(exponent + 2, count)))
                  .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), figures)))
        texts = F.struct(fixed.alias("fixed"), F.concat(point, F.lit("e"), p["power"]).alias("scientific"))
        shorter = _bound(texts, lambda t: F.when(F.length(t["fixed"]) <= F.length(t["scientific"]), t["fixed"]).otherwise(t["scientific"]))
        return F.concat(F.when(p["value"] < 0, "-").otherwise(""), shorter)

    value = _col(x).cast("double")
    return (F.when(F.isnan(value), F.lit(None)).when(value == infinity(), "Inf").when(value == -infinity(), "-Inf")
             .when(value == 0, "0").when(value.isNotNull(), _bound(value, written)))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, as a variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
