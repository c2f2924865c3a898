"""First-row distinct and preferred-row dedupe under a total order.

Spark rows have no order, so "the first row" is made explicit: the row with
the smallest ordering key. The pick is an aggregate (``min_by``), not a
window, so a key holding a third of all rows is collapsed map-side by the
partial aggregate before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.plans.materialize import reuse


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def asc_nulls_last(cols: Sequence[str | Column]) -> list[Column]:
    """Ordering key for ascending order with missing values last.

    Column names become one ``struct(isnull(a), a, isnull(b), b, ...)``
    expression (struct comparison is lexicographic), built in one call.
    """
    if all(isinstance(c, str) for c in cols):
        parts = ", ".join(f"isnull({_quoted(c)}), {_quoted(c)}" for c in cols)
        return [F.expr(f"struct({parts})")]
    out: list[Column] = []
    for c in cols:
        x = _col(c)
        out.extend([x.isNull(), x])
    return out


def preference_flag(col: str | Column, preferred) -> Column:
    """0 for the preferred value, 1 for any other value, 2 for missing.

    Sorting on it ascending equals R's ``desc(col == preferred)``.
    """
    x = _col(col)
    return F.when(x == preferred, 0).when(x.isNotNull(), 1).otherwise(2)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
             carry: Sequence[str] | None = None) -> DataFrame:
    """One row per ``keys`` (NULL is a key value), the one smallest by ``order``.

    ``order`` must be a total order within each key for a deterministic pick.
    Only the ``carry`` columns (default: all) travel with a row; column order
    is that of ``carry``, after keys it does not name.
    """
    keys = list(keys)
    cols = df.columns if carry is None else [k for k in keys if k not in carry] + list(carry)
    payload = [c for c in cols if c not in keys]
    if not payload:
        return df.select(*cols).dropDuplicates(keys)
    row = F.expr("struct(" + ", ".join(_quoted(c) for c in payload) + ")")
    picked = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_first"))
    return picked.selectExpr(*[_quoted(c) if c in keys else f"_first.{_quoted(c)} AS {_quoted(c)}"
                               for c in cols])


def prefer_then_first(df: DataFrame, keys: Sequence[str], prefer_col: str, preferred,
                      order: Sequence[Column], carry: Sequence[str] | None = None) -> DataFrame:
    """Keep one row per key: the preferred-gear row if any, else the first by ``order``."""
    return first_by(df, keys, [preference_flag(prefer_col, preferred), *order], carry)


def prefer_where_repeated(df: DataFrame, keys: Sequence[str], prefer_col: str, preferred,
                          order: Sequence[Column], carry: Sequence[str] | None = None) -> DataFrame:
    """:func:`prefer_then_first` for a table in which few keys repeat.

    A first pass counts key hashes (eight bytes a row, summed map-side) and
    stores those that occur twice; only rows with such a hash are exchanged and
    picked from, all others pass by. Unequal keys of one hash are merely looked
    at together. ``df`` is read three times, so it should be a plain table. The
    stored hashes have a known size: the planner broadcasts them only if they are few.
    """
    keys = list(keys)
    hashed = df.withColumn("_hash", F.xxhash64(*[F.col(_quoted(k)) for k in keys]))
    twice = reuse(hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_hash"))
    picked = prefer_then_first(hashed.join(twice, "_hash", "leftsemi").drop("_hash"), keys, prefer_col, preferred, order, carry)
    alone = hashed.join(twice, "_hash", "leftanti")
    return picked.unionByName(alone.select(*[_quoted(c) for c in picked.columns]))
