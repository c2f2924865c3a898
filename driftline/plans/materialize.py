"""Reuse of intermediate tables, lineage cuts, and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import ensure_checkpoint_dir, scratch_path

# A broadcast side must stay well inside executor memory on any cluster.
MAX_BROADCAST_ROWS = 1_000_000


def reuse(df: DataFrame) -> DataFrame:
    """Keep a table that several passes read.

    Written as parquet under the shared checkpoint folder and read back: a
    lost executor re-reads files, later plans start from a plain scan, and
    each pass reads only its own columns (with filters pushed into the scan).
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's shared checkpoint folder.

    Cuts the lineage: partition contents and ids are fixed from here on, and
    a lost executor re-reads files instead of recomputing upstream.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_bounded(df: DataFrame, bound_rows: int) -> DataFrame:
    """Broadcast a side whose row count is bounded by construction.

    ``bound_rows`` documents the proof (e.g. regions x seasons) and must stay
    under :data:`MAX_BROADCAST_ROWS`.
    """
    if bound_rows > MAX_BROADCAST_ROWS:
        raise ValueError(f"bound {bound_rows} exceeds the broadcast limit")
    return F.broadcast(df)
