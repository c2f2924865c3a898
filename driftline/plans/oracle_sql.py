"""Independent SQL twins of the registered queries (DuckDB dialect).

Written in the *literal* row-level form of the method (grouped values as
window functions over tow rows, ``stddev_samp`` over tow rows carrying the
yearly mean, ``row_number()`` first-row picks), so they check the small-table
algebra the Spark plans use rather than repeat it.
"""

from __future__ import annotations

from driftline.sources.fixture import TOW_SQL

# Doubles are compared at 6 decimals on both sides (summation order differs).
DOUBLE_COLUMNS = (
    "sfc_temp", "f1_10m2", "f2_10m2", "f3_10m2", "f4_10m2", "volume_1m2", "l_extendedprice",
    "fishsum", "min_nonzero", "log10_FF", "log_mean_FF", "runMean_FF", "sd_FF",
    "log10_ZP", "log_mean_ZP", "runMean_ZP", "sd_ZP", "running_mean", "LogofSum", "aver",
    "runMean", "SD_ts", "ind", "r4r", "Value", "value", "season_rank",
)

META = "cruise_name, station, zoo_gear, ich_gear, region, region_name, date, month, year, season, sfc_temp"
ORDER_COLS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"
FILE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, sfc_temp, l_extendedprice"
TAXA = ("f1_10m2", "f2_10m2", "f3_10m2", "f4_10m2")
ROW_SUM = " + ".join(f"coalesce({t}, 0.0)" for t in TAXA)
INF = "CAST('Infinity' AS DOUBLE)"

SEASON = ("CASE WHEN month BETWEEN 3 AND 5 THEN 'Spring' WHEN month BETWEEN 6 AND 8 THEN 'Summer' "
          "WHEN month BETWEEN 9 AND 11 THEN 'Fall' ELSE 'Winter' END")
REGION_MERGED = ("CASE WHEN region = 1 THEN 'MAB' WHEN region = 2 THEN 'MAB' WHEN region = 3 THEN 'GB' "
                 "WHEN region = 4 THEN 'GOM' ELSE 'Outside' END")
REGION_SPLIT = ("CASE WHEN region = 1 THEN 'MAB' WHEN region = 2 THEN 'SNE' WHEN region = 3 THEN 'GB' "
                "WHEN region = 4 THEN 'GOM' ELSE 'Outside' END")


def _round(body: str, skip: tuple[str, ...] = ()) -> str:
    # pad columns keep both COLUMNS selections non-empty; they are dropped again
    names = ", ".join(f"'{c}'" for c in DOUBLE_COLUMNS + ("pad_d__",) if c not in skip)
    return (f"SELECT * EXCLUDE (pad_d__, pad_o__) FROM (SELECT COLUMNS(lambda c: c NOT IN ({names})), "
            f"round(COLUMNS(lambda c: c IN ({names})), 6) + 0.0 "
            f"FROM (SELECT *, 0.0 AS pad_d__, 0 AS pad_o__ FROM ({body}) AS q) AS r) AS result")


def _with(*ctes: str) -> str:
    return "WITH tow AS (" + TOW_SQL + "),\n" + ",\n".join(ctes) + "\n"


CLS = f"cls AS (SELECT *, {SEASON} AS season, {REGION_MERGED} AS region_name FROM tow WHERE region <> 0)"


def _series_ctes(p: str, lbl: str, value: str) -> list[str]:
    """Log-level ctes ``{p}m`` (min), ``{p}l`` (log), ``{p}a`` (mean on rows), ``{p}s`` (sd on rows)."""
    return [
        f"{p}m AS (SELECT *, coalesce(min(CASE WHEN {value} > 0 THEN {value} END) "
        f"OVER (PARTITION BY region_name, season), {INF}) AS min_nonzero FROM {p}0)",
        f"{p}l AS (SELECT *, log10({value} + min_nonzero / 2) AS log10_{lbl} FROM {p}m)",
        f"{p}a AS (SELECT *, avg(log10_{lbl}) OVER (PARTITION BY region_name, year, season) "
        f"AS log_mean_{lbl} FROM {p}l)",
        f"{p}s AS (SELECT *, stddev_samp(log_mean_{lbl}) OVER (PARTITION BY region_name, season) "
        f"AS sd_{lbl} FROM {p}a)",
    ]


FISH = [
    CLS,
    f"ff_raw AS (SELECT {META}, {', '.join(TAXA)}, {ORDER_COLS} FROM cls WHERE ich_gear <> '')",
    "ff_pick AS (SELECT *, row_number() OVER (PARTITION BY cruise_name, station, region_name, date "
    "ORDER BY CASE WHEN zoo_gear = '1-URGENT' THEN 0 WHEN zoo_gear IS NOT NULL THEN 1 ELSE 2 END, "
    f"{FILE_ORDER}) AS rn FROM ff_raw)",
    f"ff0 AS (SELECT * EXCLUDE (rn), {ROW_SUM} AS fishsum FROM ff_pick WHERE rn = 1)",
    *_series_ctes("ff", "FF", "fishsum"),
]

ZOO = [
    CLS,
    f"zp0 AS (SELECT {META}, volume_1m2, {ORDER_COLS} FROM cls WHERE volume_1m2 IS NOT NULL)",
    *_series_ctes("zp", "ZP", "volume_1m2"),
]


def _final(p: str, lbl: str, rep_order: str, where: str = "") -> list[str]:
    """Running-mean table joined to the first row of each (region, season, year)."""
    rows = f"(SELECT * FROM {p}l {where})"
    return [
        f"rows_ AS {rows}",
        f"rows_a AS (SELECT *, avg(log10_{lbl}) OVER (PARTITION BY region_name, year, season) "
        f"AS log_mean_{lbl} FROM rows_)",
        f"rows_s AS (SELECT *, stddev_samp(log_mean_{lbl}) OVER (PARTITION BY region_name, season) "
        f"AS sd_{lbl} FROM rows_a)",
        f"ann AS (SELECT region_name, year, season, avg(log10_{lbl}) AS log_mean_{lbl} "
        f"FROM rows_ GROUP BY region_name, year, season)",
        f"run AS (SELECT *, avg(log_mean_{lbl}) OVER (PARTITION BY region_name, season ORDER BY year "
        f"ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS runMean_{lbl} FROM ann)",
        f"rep AS (SELECT * EXCLUDE (rn, log_mean_{lbl}) FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY region_name, season, year ORDER BY {rep_order}) AS rn FROM rows_s) WHERE rn = 1)",
    ]


FINAL_SELECT = ("SELECT run.*, rep.* EXCLUDE (region_name, season, year) FROM run "
                "LEFT JOIN rep USING (region_name, season, year)")


def _summary(p: str, lbl: str, where: str) -> list[str]:
    """Annual series of a period with both running means and the tow-weighted SD."""
    return [
        f"per AS (SELECT * FROM {p}l {where})",
        f"per_a AS (SELECT *, avg(log10_{lbl}) OVER (PARTITION BY region_name, year, season) "
        f"AS log_mean_{lbl} FROM per)",
        f"per_sd AS (SELECT region_name, season, stddev_samp(log_mean_{lbl}) AS sd_{lbl} "
        f"FROM per_a GROUP BY region_name, season)",
        f"per_ann AS (SELECT region_name, season, year, avg(log10_{lbl}) AS log_mean_{lbl} "
        f"FROM per GROUP BY region_name, season, year)",
        f"per_run AS (SELECT *, avg(log_mean_{lbl}) OVER w AS runMean_{lbl}, "
        f"CASE WHEN count(*) OVER w = 5 AND count(log_mean_{lbl}) OVER w = 5 "
        f"THEN avg(log_mean_{lbl}) OVER w END AS running_mean FROM per_ann "
        f"WINDOW w AS (PARTITION BY region_name, season ORDER BY year "
        f"ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))",
    ]


SUMMARY_SELECT = "SELECT per_run.*, per_sd.* EXCLUDE (region_name, season) FROM per_run LEFT JOIN per_sd USING (region_name, season)"

FISH_REP = f"cruise_name, station, region_name, date, {FILE_ORDER}"

# draft analyses: positional projection, split region map, zeros dropped, natural log
DRAFT_FISH = [
    f"d0 AS (SELECT cruise_name, station, zoo_gear, ich_gear, region, date, month, year, sfc_temp, "
    f"{', '.join(TAXA)}, {ORDER_COLS} FROM tow)",
    f"d1 AS (SELECT *, sum({ROW_SUM}) OVER (PARTITION BY cruise_name, station, region, date) "
    f"AS fishsum FROM d0)",
    f"d2 AS (SELECT *, {SEASON} AS season, {REGION_SPLIT} AS region_name FROM d1 WHERE region <> 0)",
    "d3 AS (SELECT * FROM d2 WHERE fishsum <> 0)",
    "d4 AS (SELECT *, min(fishsum) OVER (PARTITION BY region_name, season) AS min_nonzero FROM d3)",
    "d5 AS (SELECT *, ln(fishsum + min_nonzero / 2) AS LogofSum FROM d4)",
]

DRAFT_ZOO = [
    "d0 AS (SELECT cruise_name, station, zoo_gear, ich_gear, region, date, month, year, sfc_temp, "
    f"volume_1m2, {ORDER_COLS} FROM tow)",
    f"d2 AS (SELECT *, {SEASON} AS season, {REGION_SPLIT} AS region_name FROM d0)",
    "d3 AS (SELECT * FROM d2 WHERE volume_1m2 <> 0)",
    "d4 AS (SELECT *, min(volume_1m2) OVER (PARTITION BY region_name, season) AS min_nonzero FROM d3)",
    "d5 AS (SELECT *, ln(volume_1m2 + min_nonzero / 2) AS LogofSum FROM d4)",
]

DRAFT_SUMMARY = [
    "d6 AS (SELECT *, avg(LogofSum) OVER (PARTITION BY region_name, year, season) AS aver FROM d5)",
    "dsd AS (SELECT region_name, season, stddev_samp(aver) AS SD_ts FROM d6 GROUP BY region_name, season)",
    "dann AS (SELECT region_name, season, year, avg(LogofSum) AS aver FROM d5 GROUP BY region_name, season, year)",
    "drun AS (SELECT *, avg(aver) OVER w AS runMean, CASE WHEN count(*) OVER w = 5 AND "
    "count(aver) OVER w = 5 THEN avg(aver) OVER w END AS running_mean FROM dann "
    "WINDOW w AS (PARTITION BY region_name, season ORDER BY year ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))",
]
DRAFT_SUMMARY_SELECT = "SELECT drun.*, dsd.SD_ts FROM drun LEFT JOIN dsd USING (region_name, season)"


def _draft(ctes: list[str], where: str) -> list[str]:
    """Draft ctes of a period: the minimum still comes from the whole record."""
    return [*ctes[:-1], ctes[-1].removesuffix(")") + f" WHERE {where})"]


DRAFT_EARLY = "year BETWEEN 1995 AND 1997"
DRAFT_RECENT = "year BETWEEN 1999 AND (SELECT max(year) FROM d4)"


def _layers(log: str, rows: str, annual: str, mean: str, run: str, running: str) -> str:
    return (f"SELECT 'tow' AS layer, region_name, season, year, {log} AS value FROM {rows} "
            f"UNION ALL SELECT 'annual', region_name, season, year, {mean} FROM {annual} "
            f"UNION ALL SELECT 'running_mean', region_name, season, year, {run} FROM {running}")


def _long(taxa: tuple[str, ...], cols: str) -> str:
    return " UNION ALL ".join(f"SELECT {cols.format(t=t)} FROM tow" for t in taxa)


LONG_COLS = "cruise_name, station, date, year, l_orderkey, l_linenumber, '{t}' AS taxa, {t} AS ind"
INDICATOR = ("ind AS (SELECT o_orderkey, o_orderstatus AS EPU, string_split(o_orderpriority, '-')[1] AS Var, "
             "string_split(o_orderpriority, '-')[2] AS season, CAST(year(o_orderdate) AS INT) AS Time, "
             "o_totalprice AS Value FROM orders)")

ZOO_RUN = _final("zp", "ZP", FILE_ORDER)
LITERAL_MAX = "CASE WHEN count(*) = count(year) THEN max(year) END"
# fixed values: columns of the running-mean table, in order
ZOO_FINAL_COLUMNS = (f"{META}, volume_1m2, {ORDER_COLS}, min_nonzero, log10_ZP, log_mean_ZP, sd_ZP, runMean_ZP").split(", ")

RAW: dict[str, str] = {
    # whole analyses
    "q_fish_full": _with(*FISH, *_final("ff", "FF", FISH_REP)) + FINAL_SELECT,
    "q_fish_early": _with(*FISH, *_summary("ff", "FF", "WHERE year BETWEEN 1995 AND 1997")) + SUMMARY_SELECT,
    "q_fish_recent": _with(*FISH, *_final("ff", "FF", FISH_REP,
                                          "WHERE year BETWEEN 1999 AND (SELECT max(year) FROM ffl)")) + FINAL_SELECT,
    "q_zoo_full": _with(*ZOO) + "SELECT * FROM zps",
    "q_zoo_early": _with(*ZOO, *_summary("zp", "ZP", "WHERE year BETWEEN 1995 AND 1997")) + SUMMARY_SELECT,
    "q_zoo_recent": _with(*ZOO, *_final("zp", "ZP", FILE_ORDER,
                                        "WHERE year BETWEEN 1999 AND (SELECT max(year) FROM zpl)")) + FINAL_SELECT,
    "q_fish_draft": _with(*DRAFT_FISH, *DRAFT_SUMMARY) + DRAFT_SUMMARY_SELECT,
    "q_zoo_draft": _with(*DRAFT_ZOO, *DRAFT_SUMMARY) + DRAFT_SUMMARY_SELECT,
    "q_fish_draft_early": _with(*_draft(DRAFT_FISH, DRAFT_EARLY), *DRAFT_SUMMARY) + DRAFT_SUMMARY_SELECT,
    "q_fish_draft_recent": _with(*_draft(DRAFT_FISH, DRAFT_RECENT), *DRAFT_SUMMARY) + DRAFT_SUMMARY_SELECT,
    "q_zoo_draft_early": _with(*_draft(DRAFT_ZOO, DRAFT_EARLY), *DRAFT_SUMMARY) + DRAFT_SUMMARY_SELECT,
    "q_zoo_draft_recent": _with(*_draft(DRAFT_ZOO, DRAFT_RECENT), *DRAFT_SUMMARY) + DRAFT_SUMMARY_SELECT,
    # series operators
    "q_sd_smoothed": _with(*ZOO, *ZOO_RUN) + "SELECT region_name, season, stddev_samp(runMean_ZP) AS sd_ZP FROM zpl "
                     "JOIN run USING (region_name, season, year) GROUP BY region_name, season",
    "q_sd_by_year": _with(*ZOO, *ZOO_RUN) + "SELECT region_name, season, stddev_samp(log_mean_ZP) AS sd_ZP FROM ann GROUP BY region_name, season",
    "q_sd_report": _with(*ZOO) + "SELECT region_name, season, stddev_samp(log_mean_ZP) AS sd_ZP FROM zpa GROUP BY region_name, season",
    "q_fish_sd_report": _with(*FISH) + "SELECT region_name, season, stddev_samp(log_mean_FF) AS sd_FF FROM ffa GROUP BY region_name, season",
    "q_run_mean_final": _with(*ZOO, *ZOO_RUN) + FINAL_SELECT,
    "q_sd_weighted": _with(*FISH) + "SELECT * FROM ffs",
    "q_sd_annual": _with(*DRAFT_FISH,
                         "r AS (SELECT *, avg(LogofSum) OVER (PARTITION BY region_name, year, season) AS aver "
                         "FROM d5 WHERE year BETWEEN 1999 AND (SELECT max(year) FROM d5))",
                         f"rd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region, year, season "
                         f"ORDER BY {FILE_ORDER}) AS rn FROM r) WHERE rn = 1)")
                   + "SELECT region, season, stddev_samp(aver) AS SD_ts FROM rd GROUP BY region, season",
    "q_run_mean": _with(*ZOO, *ZOO_RUN) + "SELECT region_name, year, season, log_mean_ZP, runMean_ZP FROM run",
    "q_roll_mean_full": _with(*ZOO, *ZOO_RUN[:4],
                              "full_ AS (SELECT *, CASE WHEN count(*) OVER w = 5 AND count(log_mean_ZP) OVER w = 5 "
                              "THEN avg(log_mean_ZP) OVER w END AS running_mean FROM ann WINDOW w AS "
                              "(PARTITION BY region_name, season ORDER BY year ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))")
                        + "SELECT region_name, year, season, log_mean_ZP, running_mean FROM full_",
    "q_annual_mean": _with(*ZOO) + "SELECT region_name, year, season, avg(log10_ZP) AS log_mean_ZP FROM zpl GROUP BY region_name, year, season",
    "q_group_broadcast": _with(*ZOO) + "SELECT * FROM zpa",
    "q_min_nonzero": _with(*ZOO) + f"SELECT region_name, season, coalesce(min(CASE WHEN volume_1m2 > 0 THEN volume_1m2 END), {INF}) AS min_nonzero FROM zp0 GROUP BY region_name, season",
    "q_min_drop_zero": _with(*DRAFT_ZOO) + "SELECT region_name, season, min(volume_1m2) AS min_nonzero FROM d3 GROUP BY region_name, season",
    "q_log_offset": _with(*ZOO) + "SELECT * FROM zpl",
    "q_log_natural": _with(*DRAFT_ZOO) + "SELECT * FROM d5",
    "q_period_early": _with(*ZOO) + "SELECT * FROM zpl WHERE year BETWEEN 1995 AND 1997",
    "q_period_recent": _with(*ZOO) + "SELECT * FROM zpl WHERE year BETWEEN 1999 AND (SELECT max(year) FROM zpl)",
    "q_period_stored": _with(*ZOO) + "SELECT * FROM zpl WHERE year BETWEEN 1995 AND 1997",
    "q_period_literal": _with(*ZOO, "gaps AS (SELECT CASE WHEN l_linenumber <> 7 THEN year END AS year FROM zp0)") + " UNION ALL ".join(
        f"SELECT '{mode}' AS mode, year, count(*) AS n FROM {rows} WHERE year BETWEEN 1999 AND "
        f"(SELECT {top} FROM {rows}) GROUP BY year"
        for mode, rows, top in (("complete", "zp0", LITERAL_MAX), ("missing", "gaps", LITERAL_MAX), ("skipped", "gaps", "max(year)"))),
    "q_zoo_recent_literal": _with(*ZOO, *_summary("zp", "ZP", f"WHERE year BETWEEN 1999 AND (SELECT {LITERAL_MAX} FROM zpl)")) + SUMMARY_SELECT,
    "q_column_order": _with(*ZOO, *ZOO_RUN, f"final_ AS ({FINAL_SELECT})") + " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", count({c}) AS n_present FROM final_" for i, c in enumerate(ZOO_FINAL_COLUMNS, 1)),
    "q_distinct_first": _with(*ZOO) + f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY region_name, season, year ORDER BY {FILE_ORDER}) AS rn FROM zpl) WHERE rn = 1",
    "q_plot_layers": _with(*ZOO, *ZOO_RUN)
                     + _layers("log10_ZP", "zpl", "ann", "log_mean_ZP", "runMean_ZP", "run"),
    "q_fish_layers": _with(*FISH, *_final("ff", "FF", FISH_REP))
                     + _layers("log10_FF", "ffl", "ann", "log_mean_FF", "runMean_FF", "run"),
    "q_draft_layers": _with(*DRAFT_FISH, *DRAFT_SUMMARY) + _layers("LogofSum", "d5", "dann", "aver", "runMean", "drun"),
    # row operators
    "q_dedupe_preferred": _with(*FISH) + "SELECT * FROM ff0",
    "q_dedupe_rare": _with(*FISH) + "SELECT * FROM ff0",
    "q_multi_column_sum": _with("x AS (SELECT 1)") + f"SELECT {FILE_ORDER}, {', '.join(TAXA)}, {ROW_SUM} AS fishsum FROM tow",
    "q_group_sum": _with("x AS (SELECT 1)") + f"SELECT cruise_name, station, region, date, {FILE_ORDER}, sum({ROW_SUM}) OVER (PARTITION BY cruise_name, station, region, date) AS fishsum FROM tow",
    "q_filter_region": _with(CLS) + "SELECT * FROM cls",
    "q_filter_sampled": _with("x AS (SELECT 1)") + "SELECT * FROM tow WHERE ich_gear <> ''",
    "q_drop_na": _with(CLS) + f"SELECT {META}, volume_1m2, {ORDER_COLS} FROM cls WHERE volume_1m2 IS NOT NULL",
    "q_season": _with("x AS (SELECT 1)") + f"SELECT {FILE_ORDER}, month, {SEASON} AS season FROM tow",
    "q_region_name": _with("x AS (SELECT 1)") + f"SELECT {FILE_ORDER}, region, {REGION_MERGED} AS region_name, {REGION_SPLIT} AS region_name_split FROM tow",
    "q_project": _with("x AS (SELECT 1)") + "SELECT cruise_name, station, zoo_gear, ich_gear, region, date, month, year, sfc_temp FROM tow",
    "q_project_position": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem",
    "q_fourth_root": _with("x AS (SELECT 1)") + "SELECT 'f1_10m2' AS taxa, year, f1_10m2 AS ind, pow(f1_10m2, 0.25) AS r4r FROM tow",
    "q_taxon_series": _with("x AS (SELECT 1)") + "SELECT 'f2_10m2' AS taxa, year, f2_10m2 AS ind FROM tow",
    "q_taxa_all": _with("x AS (SELECT 1)") + _long(TAXA, "'{t}' AS taxa, year, {t} AS ind, pow({t}, 0.25) AS r4r"),
    "q_taxa_split": _with("x AS (SELECT 1)") + "SELECT 'f2_10m2' AS taxa, year, f2_10m2 AS ind FROM tow",
    "q_isin": _with("x AS (SELECT 1)") + _long(("f3_10m2", "f4_10m2"), LONG_COLS),
    "q_unpivot": _with("x AS (SELECT 1)") + _long(TAXA, LONG_COLS),
    # quality summaries
    "q_null_profile": _with(CLS) + "SELECT " + ", ".join(f"count(*) FILTER (WHERE {t} IS NULL) AS {t}" for t in TAXA) + " FROM cls",
    "q_blank_counts": _with(CLS) + "SELECT count(*) FILTER (WHERE volume_1m2 IS NULL) AS n_missing_volume, "
                      "count(*) FILTER (WHERE zoo_gear IS NULL OR zoo_gear = '') AS n_blank_zoo_gear, "
                      "count(*) FILTER (WHERE ich_gear IS NULL OR ich_gear = '') AS n_blank_ich_gear FROM cls",
    "q_duplicates": _with(CLS) + "SELECT cruise_name, station, region_name, date, count(*) AS n FROM cls WHERE ich_gear <> '' GROUP BY cruise_name, station, region_name, date HAVING count(*) >= 2",
    # indicator table
    "q_separate_filter": "WITH " + INDICATOR + " SELECT * FROM ind WHERE EPU = 'O' AND Var IN ('1', '2', '3')",
    "q_factor_order": "WITH " + INDICATOR + " SELECT o_orderkey, Var, season, CAST(CASE season WHEN 'URGENT' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 END AS DOUBLE) AS season_rank FROM ind",
    "q_indicator_stages": "WITH " + INDICATOR + " SELECT o_orderkey, EPU, Var AS stage, season, Time, Value, CAST(CASE season WHEN 'URGENT' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 END AS DOUBLE) AS season_rank FROM ind WHERE EPU = 'O' AND Var IN ('1', '2', '3')",
    "q_factor_levels": "WITH " + INDICATOR + ", levels(season, level) AS (VALUES ('URGENT', 1), ('HIGH', 2), ('MEDIUM', 3), ('NEVER', 4)), "
                       "known AS (SELECT l.season, Value FROM ind LEFT JOIN levels l ON l.season = ind.season) "
                       "SELECT l.season, CAST(l.level AS DOUBLE) AS level, count(k.Value) AS n, avg(k.Value) AS Value FROM levels l LEFT JOIN known k ON k.season = l.season "
                       "GROUP BY l.season, l.level UNION ALL SELECT NULL, NULL, count(*), avg(Value) FROM known WHERE season IS NULL HAVING count(*) > 0",
    # CSV round trip
    "q_csv_text": "SELECT doc_id, translate(text, 'eou', '\",\\') || chr(10) || '\"last, line\"\\' AS text, source FROM documents",
    "q_csv_survey": _with("x AS (SELECT 1)") + "SELECT * EXCLUDE (l_partkey, l_suppkey, l_shipdate, l_extendedprice) FROM tow",
    "q_csv_roundtrip": "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS row_id, n_nationkey, n_name, n_regionkey FROM nation",
}

# outputs whose columns share a double column's name but hold counts
NOT_DOUBLE = {"q_null_profile": TAXA}

ORACLE: dict[str, str] = {name: _round(sql, NOT_DOUBLE.get(name, ())) for name, sql in RAW.items()}
