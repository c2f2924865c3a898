"""Column-level functions (JVM-side expressions, no Python UDFs)."""

from driftline.functions.classify import factor_rank, region_name, season, split_pair
from driftline.functions.numeric import (
    fourth_root,
    half_min_log,
    infinity,
    nan_to_null,
    row_sum,
    short_decimal,
)

__all__ = [
    "factor_rank",
    "fourth_root",
    "half_min_log",
    "infinity",
    "nan_to_null",
    "region_name",
    "row_sum",
    "season",
    "short_decimal",
    "split_pair",
]
