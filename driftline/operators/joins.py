"""Attaching group statistics back onto rows (null-safe equi-joins)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``right``'s non-key columns onto ``left`` by ``keys``.

    Keys compare null-safe (a missing key matches a missing key, as dplyr's
    joins do). The planner picks the join by the right side's size; a side that
    is bounded by construction comes hinted (``materialize.broadcast_bounded``).
    """
    keys = list(keys)
    tmp = {k: f"__key_{i}" for i, k in enumerate(keys)}
    r = right.select(*[F.col(k).alias(tmp[k]) for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = [left[k].eqNullSafe(r[tmp[k]]) for k in keys]
    return left.join(r, on=cond, how=how).drop(*tmp.values())
