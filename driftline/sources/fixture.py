"""The survey-shaped ``tow`` view over the driver's star-schema tables.

One row per lineitem stands for one station tow. Column meanings (fixed, see
FIXTURES.md): cruise_name = market segment, station = customer key,
zoo_gear = order priority ('5-LOW' -> blank), ich_gear = order status
('P' -> blank), region = nation's region key, date/month/year from the order
date, four sparse abundance columns and a displacement volume from the line.
``date`` is ISO text ('yyyy-MM-dd'), as the survey file's date column is text;
ISO text sorts chronologically.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.sources.tables import read_table

# fixed values: the blank markers and the preferred gear of the fixture
BLANK_ZOO_GEAR = "5-LOW"
BLANK_ICH_GEAR = "P"
FIXTURE_PREFERRED_GEAR = "1-URGENT"
FIXTURE_TAXA = ("f1_10m2", "f2_10m2", "f3_10m2", "f4_10m2")
# total "file order" tie-break, unique at every scale factor
FIXTURE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                 "sfc_temp", "l_extendedprice")
EARLY = (1995, 1997)
RECENT_START = 1999

TOW_COLUMNS = (
    "cruise_name", "station", "zoo_gear", "ich_gear", "region", "date", "month", "year",
    "sfc_temp", "f1_10m2", "f2_10m2", "f3_10m2", "f4_10m2", "volume_1m2",
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
)


def tow_view(spark: SparkSession, root: str, keys: DataFrame | None = None) -> DataFrame:
    """Build ``tow``, or with ``keys`` (a small table with ``l_orderkey``) the tows of those orders.

    Join order is chosen for scale: orders -> customer -> nation is joined
    first, so the largest table (lineitem) is shuffled once, on the order key.
    The two fact-sized joins are sort-merge joins by hint: file-size estimates
    of compressed parquet can fall under the broadcast threshold and would
    broadcast a fact table; sort-merge spills instead of failing, and AQE
    splits skewed keys of it. Only nation (a fixed 25-row dimension) is left
    to the planner, which broadcasts it.

    ``keys`` filter lineitem and orders by semi joins below the fact joins; the
    planner sees the size of ``keys`` and of what is left, so these joins carry
    no hints.
    """
    li = read_table(spark, root, "lineitem")
    orders = read_table(spark, root, "orders")
    customer = read_table(spark, root, "customer")
    nation = read_table(spark, root, "nation")
    if keys is None:
        li, orders = li.hint("merge"), orders.hint("merge")
    else:
        wanted = keys.select(F.col("l_orderkey").alias("wanted_key"))
        li = li.join(wanted, li.l_orderkey == wanted.wanted_key, "leftsemi")
        orders = orders.join(wanted, orders.o_orderkey == wanted.wanted_key, "leftsemi")

    cust = (customer.join(nation, customer.c_nationkey == nation.n_nationkey)
                    .select("c_custkey", "c_mktsegment", "n_regionkey"))
    ords = (orders.join(cust, orders.o_custkey == cust.c_custkey)
                  .select("o_orderkey", "c_mktsegment", "c_custkey", "o_orderpriority",
                          "o_orderstatus", "n_regionkey", "o_orderdate"))
    tow = li.join(ords, li.l_orderkey == ords.o_orderkey).selectExpr(
        "c_mktsegment AS cruise_name",
        "CAST(c_custkey AS BIGINT) AS station",
        f"CASE WHEN o_orderpriority = '{BLANK_ZOO_GEAR}' THEN '' ELSE o_orderpriority END AS zoo_gear",
        f"CASE WHEN o_orderstatus = '{BLANK_ICH_GEAR}' THEN '' ELSE o_orderstatus END AS ich_gear",
        "n_regionkey AS region",
        "CAST(CAST(o_orderdate AS DATE) AS STRING) AS date",  # no time zone involved
        "CAST(month(o_orderdate) AS INT) AS month",
        "CAST(year(o_orderdate) AS INT) AS year",
        "l_quantity AS sfc_temp",
        "CASE WHEN l_returnflag = 'A' THEN l_tax END AS f1_10m2",
        "CASE WHEN l_returnflag = 'R' THEN l_tax END AS f2_10m2",
        "CASE WHEN l_returnflag = 'N' THEN l_discount END AS f3_10m2",
        "CASE WHEN l_linestatus = 'F' THEN l_discount END AS f4_10m2",
        "CASE WHEN l_discount > 0.095 THEN CAST(NULL AS DOUBLE) "
        "ELSE l_extendedprice * l_discount END AS volume_1m2",
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
    )
    return tow


# The same view as DuckDB SQL text (used by the SQL twins).
TOW_SQL = """
SELECT
  c.c_mktsegment                           AS cruise_name,
  CAST(c.c_custkey AS BIGINT)              AS station,
  CASE WHEN o.o_orderpriority = '5-LOW' THEN '' ELSE o.o_orderpriority END AS zoo_gear,
  CASE WHEN o.o_orderstatus  = 'P'     THEN '' ELSE o.o_orderstatus  END AS ich_gear,
  n.n_regionkey                            AS region,
  strftime(o.o_orderdate, '%Y-%m-%d')      AS date,
  CAST(month(o.o_orderdate) AS INT)        AS month,
  CAST(year(o.o_orderdate) AS INT)         AS year,
  l.l_quantity                             AS sfc_temp,
  CASE WHEN l.l_returnflag = 'A' THEN l.l_tax      END AS f1_10m2,
  CASE WHEN l.l_returnflag = 'R' THEN l.l_tax      END AS f2_10m2,
  CASE WHEN l.l_returnflag = 'N' THEN l.l_discount END AS f3_10m2,
  CASE WHEN l.l_linestatus = 'F' THEN l.l_discount END AS f4_10m2,
  CASE WHEN l.l_discount > 0.095 THEN NULL ELSE l.l_extendedprice * l.l_discount END AS volume_1m2,
  l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_extendedprice
FROM lineitem l
JOIN orders   o ON l.l_orderkey  = o.o_orderkey
JOIN customer c ON o.o_custkey   = c.c_custkey
JOIN nation   n ON c.c_nationkey = n.n_nationkey
"""
