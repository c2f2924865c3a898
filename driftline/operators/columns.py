"""Column-set operators: positional select, name ranges, and the order of columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def positions(spec: Iterable[int | range]) -> list[int]:
    """Flatten 1-based positions and ranges (``range(1, 22)`` = R's ``1:21``)."""
    out: list[int] = []
    for item in spec:
        out.extend(item if isinstance(item, range) else [item])
    return out


def select_positions(df: DataFrame, spec: Iterable[int | range]) -> DataFrame:
    """Project by 1-based column position, in the order given."""
    cols = df.columns
    idx = positions(spec)
    bad = [i for i in idx if not 1 <= i <= len(cols)]
    if bad:
        raise IndexError(f"column positions out of range: {bad}")
    return df.select(*[cols[i - 1] for i in idx])


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` inclusive, in frame order (R's ``a:b``)."""
    cols = df.columns
    i, j = cols.index(first), cols.index(last)
    if i > j:
        i, j = j, i
        return list(reversed(cols[i:j + 1]))
    return cols[i:j + 1]


def rest_first(columns: Sequence[str], known: Sequence[str]) -> list[str]:
    """The set difference of two column lists, then everything else, both in frame order."""
    return [c for c in columns if c not in known] + [c for c in columns if c in known]


def relocate(columns: Sequence[str], moved: Sequence[str], after: str | None = None,
             before: str | None = None) -> list[str]:
    """``columns`` with ``moved`` (in that order) behind ``after`` or ahead of ``before``; to the
    front without either. An anchor that itself moves keeps its place."""
    if after is not None and before is not None:
        raise ValueError("name one of after and before")
    anchor = after if before is None else before
    missing = [c for c in [*moved, *([] if anchor is None else [anchor])] if c not in columns]
    if missing:
        raise KeyError(f"no such columns: {missing}")
    rest = [c for c in columns if c not in moved or c == anchor]
    moved = [c for c in moved if c != anchor]
    at = 0 if anchor is None else rest.index(anchor) + (before is None)
    return rest[:at] + moved + rest[at:]


def column_profile(df: DataFrame) -> DataFrame:
    """(position, column, n_present): the columns in order, with their numbers of values."""
    counts = df.agg(*[F.count(F.col("`" + c.replace("`", "``") + "`")).alias(f"_{i}") for i, c in enumerate(df.columns)])
    cells = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("column"), F.col(f"_{i}").alias("n_present"))
                      for i, c in enumerate(df.columns)])
    return counts.select(F.inline(cells))
