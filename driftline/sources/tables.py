"""Parquet table reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Column layout of the driver's star-schema tables (TESTDATA.md). A declared
# schema spares the footer-inference job each read would otherwise start.
DRIVER_SCHEMAS = {
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``{root}/{name}.parquet`` (columnar scan: filters and projections are pushed down)."""
    reader = spark.read
    if name in DRIVER_SCHEMAS:
        reader = reader.schema(DRIVER_SCHEMAS[name])
    return reader.parquet(f"{root.rstrip('/')}/{name}.parquet")


def read_indicator(spark: SparkSession, root: str, name: str, epu: str, var: str, time: str,
                   value: str) -> DataFrame:
    """An indicator table as (EPU, Var, Time, Value), from expressions over its own columns."""
    return read_table(spark, root, name).selectExpr(
        "*", f"{epu} AS EPU", f"{var} AS Var", f"{time} AS Time", f"{value} AS Value")


def write_split(df: DataFrame, path: str, *by: str) -> DataFrame:
    """Write a Parquet table with one folder per value of ``by``, and read it back.

    A filter on ``by`` then lists and reads only its folders. Rows are rebalanced
    on ``by`` first, so that a folder gets few files of even size; a value that
    holds most rows is split among tasks.
    """
    df.hint("rebalance", *by).write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path).select(*df.columns)
