"""Registered queries over the driver's tables.

Each entry takes ``(spark, root)`` and returns a DataFrame computed from the
whole ``tow`` view (or another driver table); nothing is sampled or capped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from driftline import constants as C
from driftline.functions.classify import factor_rank, region_name, season, split_pair
from driftline.functions.numeric import fourth_root, row_sum
from driftline.operators.category import as_category, count_levels
from driftline.operators.columns import column_profile, column_range, select_positions
from driftline.operators.dedupe import asc_nulls_last
from driftline.operators.filters import up_to_max
from driftline.operators.joins import attach
from driftline.operators.quality import blank_counts, is_blank, is_missing, null_profile, repeated_keys
from driftline.operators.reshape import to_long
from driftline.operators.series import descending_report, group_row_sum
from driftline.plans.materialize import reuse
from driftline.plans.survey import (
    SeriesSpec,
    analyse,
    classify,
    draft_fish,
    draft_volume,
    maintained_fish,
    maintained_volume,
    minimum_table,
    prepared,
    year_weighted_by_code,
)
from driftline.session import scratch_path
from driftline.sources.csv import read_csv, write_csv
from driftline.sources.fixture import (
    EARLY,
    FIXTURE_ORDER,
    FIXTURE_PREFERRED_GEAR,
    FIXTURE_TAXA,
    RECENT_START,
    tow_view,
)
from driftline.sources.tables import read_indicator, read_table, write_split

Query = Callable[[SparkSession, str], DataFrame]

# fixed values: tow columns of the fixture view, in output order
ORDER_COLS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
              "l_extendedprice")
META = ("cruise_name", "station", "zoo_gear", "ich_gear", "region", "region_name", "date",
        "month", "year", "season", "sfc_temp")

FISH = maintained_fish(keep=META + FIXTURE_TAXA + ORDER_COLS, parts=FIXTURE_TAXA,
                       preferred=FIXTURE_PREFERRED_GEAR, order=FIXTURE_ORDER)
ZOO = maintained_volume(keep=META + (C.VOLUME,) + ORDER_COLS, order=FIXTURE_ORDER)
# draft projections by position: metadata 1-9, taxa 10-13 | volume 14, order 15-20
DRAFT_FISH = draft_fish(positions=(range(1, 14), range(15, 21)), parts=FIXTURE_TAXA,
                        order=FIXTURE_ORDER)
DRAFT_ZOO = draft_volume(positions=(range(1, 10), 14, range(15, 21)), order=FIXTURE_ORDER)

TAXA_IDS = ("cruise_name", "station", "date", "year", "l_orderkey", "l_linenumber")
STAGES = ("1", "2", "3")
LABEL_LEVELS = ("URGENT", "HIGH", "MEDIUM")


def _series(spark: SparkSession, root: str, spec: SeriesSpec):
    return analyse(tow_view(spark, root), spec, fetch=lambda keys: tow_view(spark, root, keys))


def _long(spark: SparkSession, root: str, *taxa: str) -> DataFrame:
    """Long table of the named taxa (default: the whole column range)."""
    tow = tow_view(spark, root)
    return to_long(tow, TAXA_IDS, taxa or column_range(tow, "f1_10m2", "f4_10m2"))


# -- whole analyses -----------------------------------------------------------

def q_fish_full(spark, root):
    return _series(spark, root, FISH).final()


def q_fish_early(spark, root):
    return _series(spark, root, FISH).period(*EARLY).summary()


def q_fish_recent(spark, root):
    return _series(spark, root, FISH).period(RECENT_START).final()


def q_zoo_full(spark, root):
    return _series(spark, root, ZOO).tows()


def q_zoo_early(spark, root):
    return _series(spark, root, ZOO).period(*EARLY).summary()


def q_zoo_recent(spark, root):
    return _series(spark, root, ZOO).period(RECENT_START).final()


def q_fish_draft(spark, root):
    return _series(spark, root, DRAFT_FISH).summary()


def q_zoo_draft(spark, root):
    return _series(spark, root, DRAFT_ZOO).summary()


def q_fish_draft_early(spark, root):
    return _series(spark, root, DRAFT_FISH).period(*EARLY).summary()


def q_fish_draft_recent(spark, root):
    return _series(spark, root, DRAFT_FISH).period(RECENT_START).summary()


def q_zoo_draft_early(spark, root):
    return _series(spark, root, DRAFT_ZOO).period(*EARLY).summary()


def q_zoo_draft_recent(spark, root):
    return _series(spark, root, DRAFT_ZOO).period(RECENT_START).summary()


# -- series operators ---------------------------------------------------------

def q_sd_report(spark, root):
    return descending_report(_series(spark, root, ZOO).report(), "region_name", "season")


def q_fish_sd_report(spark, root):
    return descending_report(_series(spark, root, FISH).report(), "region_name", "season")


def q_run_mean_final(spark, root):
    return _series(spark, root, ZOO).final()


def q_sd_weighted(spark, root):
    return _series(spark, root, FISH).tows()


def q_sd_annual(spark, root):
    return year_weighted_by_code(_series(spark, root, DRAFT_FISH).period(RECENT_START))


def q_sd_smoothed(spark, root):
    """SD of the running mean (smoothing before the SD)."""
    return _series(spark, root, replace(ZOO, sd_source="running_mean")).report()


def q_sd_by_year(spark, root):
    """SD by named region with each year counted once."""
    return _series(spark, root, replace(ZOO, sd_weight="year")).report()


def q_run_mean(spark, root):
    n = ZOO.names
    return _series(spark, root, ZOO).series.select(n.region, "year", "season", n.mean, n.run)


def q_roll_mean_full(spark, root):
    n = ZOO.names
    return _series(spark, root, ZOO).series.select(n.region, "year", "season", n.mean, n.full)


def q_annual_mean(spark, root):
    return _series(spark, root, ZOO).annual


def q_group_broadcast(spark, root):
    return _series(spark, root, ZOO).with_annual_mean()


def q_min_nonzero(spark, root):
    return minimum_table(prepared(tow_view(spark, root), ZOO), ZOO)


def q_min_drop_zero(spark, root):
    return minimum_table(prepared(tow_view(spark, root), DRAFT_ZOO), DRAFT_ZOO)


def q_log_offset(spark, root):
    return _series(spark, root, ZOO).logged


def q_log_natural(spark, root):
    return _series(spark, root, DRAFT_ZOO).logged


def q_period_early(spark, root):
    return _series(spark, root, ZOO).period(*EARLY).logged


def q_period_recent(spark, root):
    return _series(spark, root, ZOO).period(RECENT_START).logged


def q_period_stored(spark, root):
    """The early period of a table stored by year: its scan reads three folders."""
    rows = write_split(prepared(tow_view(spark, root), ZOO), scratch_path(spark, "tows-by-year"), "year")
    return analyse(rows, ZOO, keep=False).period(*EARLY).logged.select(*ZOO.keep, ZOO.names.minimum, ZOO.names.log)


def q_period_literal(spark, root):
    """``between(year, lo, max(year))`` as it stands: whole, with missing years, and with them skipped."""
    rows = prepared(tow_view(spark, root), ZOO)
    gaps = rows.withColumn("year", F.when(F.col("l_linenumber") != 7, F.col("year")))
    cases = [("complete", up_to_max(rows, "year", RECENT_START)), ("missing", up_to_max(gaps, "year", RECENT_START)),
             ("skipped", up_to_max(gaps, "year", RECENT_START, skip_missing=True))]
    out = None
    for name, df in cases:
        part = df.groupBy("year").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("mode"), "year", "n")
        out = part if out is None else out.unionByName(part)
    return out


def q_zoo_recent_literal(spark, root):
    """The recent period up to the computed maximum."""
    return _series(spark, root, ZOO).period(RECENT_START, literal_max=True).summary()


def q_column_order(spark, root):
    """Columns of the running-mean table by position, with their numbers of values."""
    return column_profile(_series(spark, root, ZOO).final())


def q_distinct_first(spark, root):
    return _series(spark, root, ZOO).first_rows()


def q_plot_layers(spark, root):
    return _series(spark, root, ZOO).layers()


def q_fish_layers(spark, root):
    return _series(spark, root, FISH).layers()


def q_draft_layers(spark, root):
    return _series(spark, root, DRAFT_FISH).layers()


# -- row operators ------------------------------------------------------------

def q_dedupe_preferred(spark, root):
    return prepared(tow_view(spark, root), FISH)


def q_dedupe_rare(spark, root):
    """The same dedupe, with only repeated samples exchanged, over the tows as a stored table."""
    rows = reuse(classify(tow_view(spark, root), FISH).filter(F.col("ich_gear") != ""))
    return prepared(rows, replace(FISH, rare_repeats=True))


def q_multi_column_sum(spark, root):
    tow = tow_view(spark, root)
    return tow.select(*FIXTURE_ORDER, *FIXTURE_TAXA, row_sum(FIXTURE_TAXA).alias("fishsum"))


def q_group_sum(spark, root):
    # one pass over the tows, stored narrow; the totals are joined to its rows
    rows = reuse(tow_view(spark, root).select(*C.DRAFT_SAMPLE_KEY, *FIXTURE_ORDER, row_sum(FIXTURE_TAXA).alias("part")))
    totals = group_row_sum(rows, C.DRAFT_SAMPLE_KEY, ["part"], "fishsum")
    return attach(rows.drop("part"), totals, C.DRAFT_SAMPLE_KEY)


def q_filter_region(spark, root):
    return classify(tow_view(spark, root), ZOO)


def q_filter_sampled(spark, root):
    return tow_view(spark, root).filter(F.col("ich_gear") != "")


def q_drop_na(spark, root):
    out = classify(tow_view(spark, root), ZOO).select(*ZOO.keep)
    return out.dropna(subset=[C.VOLUME])


def q_season(spark, root):
    return tow_view(spark, root).select(*FIXTURE_ORDER, "month", season("month").alias("season"))


def q_region_name(spark, root):
    return tow_view(spark, root).select(
        *FIXTURE_ORDER, "region",
        region_name("region", C.REGIONS_MERGED).alias("region_name"),
        region_name("region", C.REGIONS_SPLIT).alias("region_name_split"))


def q_project(spark, root):
    return tow_view(spark, root).select("cruise_name", "station", "zoo_gear", "ich_gear",
                                        "region", "date", "month", "year", "sfc_temp")


def q_project_position(spark, root):
    return select_positions(read_table(spark, root, "lineitem"), (range(1, 5), 6))


def q_fourth_root(spark, root):
    return _long(spark, root, "f1_10m2").select("taxa", "year", "ind", fourth_root("ind").alias("r4r"))


def q_taxon_series(spark, root):
    return _long(spark, root, "f2_10m2").select("taxa", "year", "ind")


def q_taxa_all(spark, root):
    return _long(spark, root).select("taxa", "year", "ind", fourth_root("ind").alias("r4r"))


def q_taxa_split(spark, root):
    """All taxa written from one plan, a folder each; one of them read again."""
    every = write_split(_long(spark, root).select("taxa", "year", "ind"), scratch_path(spark, "taxa"), "taxa")
    return every.filter(F.col("taxa") == "f2_10m2")


def q_isin(spark, root):
    wanted = {"f3_10m2", "f4_10m2"}
    return _long(spark, root, *[t for t in FIXTURE_TAXA if t in wanted])


def q_unpivot(spark, root):
    return _long(spark, root)


# -- quality summaries --------------------------------------------------------

def q_null_profile(spark, root):
    tow = classify(tow_view(spark, root), ZOO)
    return null_profile(tow, column_range(tow, "f1_10m2", "f4_10m2"))


def q_blank_counts(spark, root):
    tow = classify(tow_view(spark, root), ZOO)
    return blank_counts(tow, {"n_missing_volume": is_missing(tow, C.VOLUME),
                              "n_blank_zoo_gear": is_blank("zoo_gear"),
                              "n_blank_ich_gear": is_blank("ich_gear")})


def q_duplicates(spark, root):
    tow = classify(tow_view(spark, root), FISH).select(*FISH.keep)
    return repeated_keys(tow.filter(F.col("ich_gear") != ""), C.SAMPLE_KEY, "n")


# -- indicator table (orders stand in for EPU / Var / Time / Value) -----------

def _indicator(spark, root) -> DataFrame:
    o = read_table(spark, root, "orders")
    var, label = split_pair("o_orderpriority", "-")
    return o.select("o_orderkey", F.col("o_orderstatus").alias("EPU"), var.alias("Var"),
                    label.alias("season"), F.year("o_orderdate").cast("int").alias("Time"),
                    F.col("o_totalprice").alias("Value"))


def q_indicator_stages(spark, root):
    """Filter by EPU, split the label, keep the stages, rank the season: one plan."""
    var, label = split_pair("Var", "-")
    return (read_indicator(spark, root, "orders", epu="o_orderstatus", var="o_orderpriority",
                           time="CAST(year(o_orderdate) AS INT)", value="o_totalprice")
            .filter(F.col("EPU") == "O")
            .select("o_orderkey", "EPU", var.alias("stage"), label.alias("season"), "Time", "Value")
            .filter(F.col("stage").isin(*STAGES))
            .withColumn("season_rank", factor_rank("season", LABEL_LEVELS).cast("double")))


def q_separate_filter(spark, root):
    return _indicator(spark, root).filter(F.col("EPU") == "O").filter(F.col("Var").isin(*STAGES))


def q_factor_order(spark, root):
    ind = _indicator(spark, root)
    # the rank leaves as a double: a NULL rank then reads back the same in every client
    return ind.select("o_orderkey", "Var", "season",
                      factor_rank("season", LABEL_LEVELS).cast("double").alias("season_rank"))


def q_factor_levels(spark, root):
    """Count and mean per level of an ordered category, unknown levels as missing."""
    ind = as_category(_indicator(spark, root), "season", [*LABEL_LEVELS, "NEVER"])
    out = count_levels(ind, "season", F.avg("Value").alias("Value"))
    return out.withColumn("level", F.col("level").cast("double"))  # a NULL reads back the same in every client


# -- CSV source / sink --------------------------------------------------------

NATION_CSV = StructType([
    StructField("row_id", IntegerType()),
    StructField("n_nationkey", IntegerType()),
    StructField("n_name", StringType()),
    StructField("n_regionkey", IntegerType()),
])


def q_csv_roundtrip(spark, root):
    path = scratch_path(spark, "nation-csv")
    nation = read_table(spark, root, "nation")
    write_csv(nation, path, row_names=True, order=asc_nulls_last(["n_nationkey"]))
    back = read_csv(spark, path, NATION_CSV)
    return back.withColumn("row_id", F.col("row_id").cast("bigint"))


CSV_TOW = ("row_id BIGINT, cruise_name STRING, station BIGINT, zoo_gear STRING, ich_gear STRING, region INT, "
           "date STRING, month INT, year INT, sfc_temp DOUBLE, f1_10m2 DOUBLE, f2_10m2 DOUBLE, f3_10m2 DOUBLE, "
           "f4_10m2 DOUBLE, volume_1m2 DOUBLE, l_orderkey BIGINT, l_linenumber INT")


def q_csv_survey(spark, root):
    """Every tow through the CSV sink and back: blanks, missing doubles, row numbers."""
    path = scratch_path(spark, "tow-csv")
    tow = tow_view(spark, root).drop("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    write_csv(tow, path, order=asc_nulls_last(["l_orderkey", "l_linenumber", "volume_1m2", "sfc_temp"]))
    return read_csv(spark, path, CSV_TOW).drop("row_id")


def q_csv_text(spark, root):
    """Every document text through the CSV sink and back: quotes, commas, line breaks, backslashes."""
    path = scratch_path(spark, "texts-csv")
    docs = read_table(spark, root, "documents").select("doc_id", _awkward().alias("text"), "source")
    write_csv(docs, path, row_names=False)
    return read_csv(spark, path, "doc_id BIGINT, text STRING, source STRING")


def _awkward():
    """A document text with more quotes, commas and backslashes than prose has."""
    return F.concat(F.translate("text", "eou", "\",\\"), F.lit("\n\"last, line\"\\"))


QUERIES: dict[str, Query] = {
    name: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)
}
