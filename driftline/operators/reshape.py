"""Wide -> long reshaping and chart-ready layer tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str],
            names_to: str = "taxa", values_to: str = "ind") -> DataFrame:
    """``pivot_longer``: one row per (input row, value column); missing values kept.

    A narrow map-side ``Expand``: no shuffle, output = rows x len(values). Name
    only the columns that are wanted: no filter on the names is pushed below it.
    """
    return df.unpivot(list(ids), list(values), names_to, values_to)


def layer_table(layers: Sequence[tuple[str, DataFrame, str]], keys: Sequence[str],
                layer: str = "layer", value: str = "value") -> DataFrame:
    """Stack (name, frame, value column) layers into one long table.

    Output columns: ``layer``, ``keys``..., ``value``.
    """
    out = None
    for name, frame, col in layers:
        part = frame.select(F.lit(name).alias(layer), *keys, F.col(col).cast("double").alias(value))
        out = part if out is None else out.unionByName(part)
    return out
