"""Categorical derivations: season, region name, ordered factor, split label."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.constants import (
    REGION_OTHERWISE,
    REGIONS_MERGED,
    SEASON_BANDS,
    SEASON_OTHERWISE,
)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def season(month: str | Column = "month", bands=SEASON_BANDS,
           otherwise: str = SEASON_OTHERWISE) -> Column:
    """Month -> season name; months outside every band (and NULL) get ``otherwise``."""
    x, expr = _col(month), None
    for name, lo, hi in bands:
        cond = x.between(lo, hi)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.otherwise(otherwise)


def region_name(region: str | Column = "region",
                mapping: Mapping[int, str] = REGIONS_MERGED,
                otherwise: str = REGION_OTHERWISE) -> Column:
    """Region code -> name; unknown and NULL codes get ``otherwise``."""
    x, expr = _col(region), None
    for code, name in mapping.items():
        expr = F.when(x == code, name) if expr is None else expr.when(x == code, name)
    return expr.otherwise(otherwise)


def region_names(mapping: Mapping[int, str] = REGIONS_MERGED,
                 otherwise: str = REGION_OTHERWISE) -> tuple[str, ...]:
    """Every value ``region_name`` can produce (a size bound for group tables)."""
    return tuple(sorted(set(mapping.values()) | {otherwise}))


def factor_rank(value: str | Column, levels: Sequence[str]) -> Column:
    """1-based position of ``value`` in ``levels``; values not listed (and NULL) give NULL."""
    v = _col(value)
    expr = None
    for i, level in enumerate(levels, start=1):
        expr = F.when(v == level, i) if expr is None else expr.when(v == level, i)
    return expr


def split_pair(value: str | Column, sep: str) -> tuple[Column, Column]:
    """Split on a regex into (first, second) piece.

    Extra pieces are dropped; a missing second piece is NULL; NULL input gives
    two NULLs. ``get`` returns NULL out of range, so this is safe under ANSI mode.
    """
    parts = F.split(_col(value), sep)
    return F.get(parts, 0), F.get(parts, 1)
