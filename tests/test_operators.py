"""Operators on hand-written rows, one test per rule of the semantic contract."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from driftline import constants as C
from driftline.operators.columns import column_range, select_positions
from driftline.operators.dedupe import asc_nulls_last, first_by
from driftline.operators.joins import attach
from driftline.operators.ordering import number_rows
from driftline.operators.quality import is_blank, null_profile, repeated_keys
from driftline.operators.reshape import layer_table, to_long
from driftline.operators.series import (annual_mean, positive_min, running_mean, with_weighted_sd,
                                        year_sd)
from driftline.plans.survey import analyse, draft_fish, maintained_fish, maintained_volume, prepared
from driftline.sources.csv import read_csv, write_csv


def _sorted(rows, key=lambda r: tuple((v is None, v) for v in r)):
    return sorted((tuple(r) for r in rows), key=key)


# S5 -------------------------------------------------------------------------
def test_csv_blank_quoted_empty_and_na(spark, tmp_path):
    path = tmp_path / "tows.csv"
    path.write_text('cruise_name,ich_gear,volume_1m2\nA,,1.5\nB,"",NA\nC,NA,\nD,20B,2.0\n')
    schema = StructType([StructField("cruise_name", StringType()),
                         StructField("ich_gear", StringType()),
                         StructField("volume_1m2", StringType())])
    df = read_csv(spark, str(path), "cruise_name STRING, ich_gear STRING, volume_1m2 DOUBLE")
    assert df.filter(is_blank("ich_gear")).count() == 3
    assert [r.cruise_name for r in df.filter(F.col("ich_gear") != "").collect()] == ["D"]
    assert df.filter(F.col("volume_1m2").isNull()).count() == 2
    assert schema  # the declared schema is applied, not inferred


# S7, S8 -------------------------------------------------------------------------
def test_group_sum_vs_row_sum(spark, tows):
    rows = [dict(cruise_name="PC1", station=1, region=1, date="d", month=4, year=1990,
                 ich_gear="x", cluhar_10m2=1.0, scosco_10m2=2.0),
            dict(cruise_name="PC1", station=1, region=1, date="d", month=4, year=1990,
                 ich_gear="x", pepspp_10m2=4.0),
            dict(cruise_name="PC2", station=1, region=1, date="d", month=4, year=1990,
                 ich_gear="x")]
    df = tows(rows)
    draft = prepared(df, draft_fish(zero_policy="keep"))
    assert _sorted(draft.select("cruise_name", "fishsum").collect()) == \
        [("PC1", 7.0), ("PC1", 7.0), ("PC2", 0.0)]
    spec = maintained_fish(dedupe_keys=None, sampled=None)
    rowwise = prepared(df, spec)
    assert _sorted(rowwise.select("cruise_name", "fishsum").collect()) == \
        [("PC1", 3.0), ("PC1", 4.0), ("PC2", 0.0)]


# S9, S11 --------------------------------------------------------------------------
def test_min_nonzero_keep_and_drop_zeros(spark, tows):
    rows = [dict(region=1, month=4, year=1990, volume_1m2=v) for v in (0.0, 2.0, 8.0)]
    keep = analyse(tows(rows), maintained_volume())
    got = sorted(r.log10_ZP for r in keep.logged.collect())
    assert got == pytest.approx([0.0, math.log10(3), math.log10(9)])
    assert {r.min_nonzero for r in keep.logged.collect()} == {2.0}
    from driftline.plans.survey import draft_volume
    drop = analyse(tows(rows), draft_volume())
    assert drop.logged.count() == 2
    assert {r.min_nonzero for r in drop.logged.collect()} == {2.0}


# S10 ------------------------------------------------------------------------------
def test_no_positive_value_gives_infinity_or_null(spark, tows):
    df = tows([dict(region=1, month=4, year=1990, volume_1m2=0.0)] * 2)
    inf = df.agg(positive_min("volume_1m2").alias("min_nonzero"))
    assert inf.first().min_nonzero == math.inf
    null = df.agg(positive_min("volume_1m2", "null").alias("min_nonzero"))
    assert null.first().min_nonzero is None


# S13 ------------------------------------------------------------------------------
def test_mean_skips_missing_and_nan(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", float("nan")), ("g", None)], "k STRING, x DOUBLE")
    row = annual_mean(df, ["k"], "x", "m", weight="n").first()
    assert row.m == 1.0 and row.n == 3


# S14, S15 -------------------------------------------------------------------------
def test_running_means_rows_not_years(spark):
    years = [1, 2, 4, 5, 9, 10, 11]
    vals = [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0]
    df = spark.createDataFrame([("g", y, v) for y, v in zip(years, vals)], "k STRING, year INT, x DOUBLE")
    out = running_mean(df, ["k"], "year", "x", "part")
    out = running_mean(out, ["k"], "year", "x", "full", complete=True)
    rows = sorted(out.collect(), key=lambda r: r.year)
    assert [r.part for r in rows] == pytest.approx([1, 1.5, 1.5, 7 / 3, 3, 4.25, 5.5])
    assert [r.full for r in rows] == [None] * 7
    k1 = running_mean(df, ["k"], "year", "x", "same", k=1).collect()
    assert all(r.same == r.x for r in k1)


# S16, S17, S19 ---------------------------------------------------------------------
def test_sd_weights(spark):
    annual = spark.createDataFrame([("g", 1, 0.0, 1), ("g", 2, 1.0, 3)],
                                   "k STRING, year INT, m DOUBLE, n BIGINT")
    assert with_weighted_sd(annual, ["k"], "m", "n", "sd").first().sd == pytest.approx(0.5)
    assert year_sd(annual, ["k"], "m", "sd").first().sd == pytest.approx(math.sqrt(0.5))
    single = spark.createDataFrame([("g", 1, 0.3, 1)], "k STRING, year INT, m DOUBLE, n BIGINT")
    assert with_weighted_sd(single, ["k"], "m", "n", "sd").first().sd is None
    assert year_sd(single, ["k"], "m", "sd").first().sd is None


def test_weighted_sd_equals_row_level_sd(spark):
    import random
    rnd = random.Random(7)
    rows = [(g, y, rnd.random(), rnd.randint(1, 5)) for g in "ab" for y in range(12)]
    annual = spark.createDataFrame(rows, "k STRING, year INT, m DOUBLE, n BIGINT")
    expanded = annual.select("k", "m", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))))
    want = {r.k: r.sd for r in expanded.groupBy("k").agg(F.stddev_samp("m").alias("sd")).collect()}
    got = {r.k: r.sd for r in with_weighted_sd(annual, ["k"], "m", "n", "sd").collect()}
    assert got == pytest.approx(want)


# S20, S21 ---------------------------------------------------------------------------
def test_preferred_gear_survives(spark, tows):
    base = dict(cruise_name="ZZ0001", station=7, region=1, date="2001-05-09", month=5,
                year=2001, ich_gear="6B3Z", cluhar_10m2=1.0)
    for first in ("6B3Z", "2B1Z"):
        other = "2B1Z" if first == "6B3Z" else "6B3Z"
        df = tows([dict(base, zoo_gear=first, volume_1m2=1.0),
                   dict(base, zoo_gear=other, volume_1m2=2.0)])
        out = prepared(df, maintained_fish()).collect()
        assert len(out) == 1 and out[0].zoo_gear == "6B3Z"


def test_first_row_is_file_order_and_idempotent(spark, tows):
    df = tows([dict(region=1, month=4, year=1990, volume_1m2=v) for v in (5.0, 1.0, 3.0)])
    df = df.withColumn("season", F.lit("Spring"))
    once = first_by(df, ["season"], asc_nulls_last(["_row"]))
    assert once.first().volume_1m2 == 5.0
    twice = first_by(once, ["season"], asc_nulls_last(["_row"]))
    assert _sorted(twice.collect()) == _sorted(once.collect())


# S22 -------------------------------------------------------------------------------
def test_ascending_missing_last(spark):
    df = spark.createDataFrame([(1, None), (1, "b"), (1, "A")], "k INT, name STRING")
    assert first_by(df, ["k"], asc_nulls_last(["name"])).first().name == "A"
    ordered = [r.name for r in df.orderBy(*asc_nulls_last(["name"])).collect()]
    assert ordered == ["A", "b", None]


# S23 -------------------------------------------------------------------------------
def test_missing_keys_match(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k STRING, v INT")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k STRING, w INT")
    got = _sorted(attach(left, right, ["k"]).collect())
    assert got == [("a", 2, 20), (None, 1, 10)]


# S24 -------------------------------------------------------------------------------
def test_periods(spark, tows):
    rows = [dict(region=1, month=4, year=y, volume_1m2=1.0) for y in (1977, 1978, 1987, 1988, 1998)]
    s = analyse(tows(rows), maintained_volume())
    early = sorted(r.year for r in s.period(*C.EARLY_PERIOD).logged.collect())
    recent = sorted(r.year for r in s.period(C.RECENT_START).logged.collect())
    assert early == [1978, 1987] and recent == [1998]


# O4-O9 -----------------------------------------------------------------------------
def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "a INT, b INT, c INT, d INT, e INT")
    assert select_positions(df, (range(1, 3), 5)).columns == ["a", "b", "e"]
    with pytest.raises(IndexError):
        select_positions(df, [6])
    assert column_range(df, "b", "d") == ["b", "c", "d"]


# O45 -------------------------------------------------------------------------------
def test_unpivot_keeps_missing(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "id INT, a DOUBLE, b DOUBLE")
    got = _sorted(to_long(df, ["id"], ["a", "b"]).collect())
    assert got == [(1, "a", 2.0), (1, "b", None)]


def test_layer_table(spark):
    a = spark.createDataFrame([("r", 1.0)], "g STRING, x DOUBLE")
    b = spark.createDataFrame([("r", 2.0)], "g STRING, y DOUBLE")
    out = layer_table([("one", a, "x"), ("two", b, "y")], ["g"])
    assert out.columns == ["layer", "g", "value"]
    assert _sorted(out.collect()) == [("one", "r", 1.0), ("two", "r", 2.0)]


# O18, O21 -------------------------------------------------------------------------
def test_quality(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", 2.0, None), ("b", None, None)],
                               "k STRING, x DOUBLE, y DOUBLE")
    prof = null_profile(df, ["x", "y"]).first()
    assert (prof.x, prof.y) == (2, 2)
    dup = repeated_keys(df, ["k"]).collect()
    assert [(r.k, r.n) for r in dup] == [("a", 2)]


# O2 --------------------------------------------------------------------------------
def test_number_rows_consecutive(spark):
    df = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 7919 % 1000).alias("v"))
    out = number_rows(df, [F.col("v")], "row_id").collect()
    assert sorted((r.row_id, r.v) for r in out) == [(i + 1, i) for i in range(1000)]


def test_csv_sink_writes_the_reference_form(spark, tmp_path):
    df = spark.createDataFrame([("MAB", "Spring", 0.5, 3, 2.0), ('G"B', "Fall, late", None, None, float("nan"))],
                               "region_name STRING, season STRING, sd_FF DOUBLE, n INT, v DOUBLE").coalesce(1)

    def text(path):
        parts = sorted(p for p in path.iterdir() if p.name.startswith("part-"))
        lines = [p.read_text().splitlines() for p in parts]
        assert len({x[0] for x in lines}) == 1
        return [lines[0][0], *(y for x in lines for y in x[1:])]
    write_csv(df, str(tmp_path / "kept"))
    assert text(tmp_path / "kept") == ['"","region_name","season","sd_FF","n","v"', '"1","MAB","Spring",0.5,3,2',
                                       '"2","G""B","Fall, late",NA,NA,NA']
    write_csv(df, str(tmp_path / "sorted"), order=[F.col("region_name")])
    assert [x.split(",")[:2] for x in text(tmp_path / "sorted")[1:]] == [['"1"', '"G""B"'], ['"2"', '"MAB"']]
    write_csv(df, str(tmp_path / "plain"), row_names=False)
    assert text(tmp_path / "plain")[0] == '"region_name","season","sd_FF","n","v"'
    back = spark.read.option("escape", '"').option("header", True).option("nullValue", "NA").csv(str(tmp_path / "kept"))
    assert _sorted(back.collect()) == [("1", "MAB", "Spring", "0.5", "3", "2"), ("2", 'G"B', "Fall, late", None, None, None)]


def test_csv_nan_is_missing_everywhere(spark, tmp_path):
    path = tmp_path / "tows.csv"
    path.write_text("station,volume_1m2,sfc_temp\n1,NaN,2.5\n2,3.5,NA\n3,,NaN\n")
    for schema in ("station INT, volume_1m2 DOUBLE, sfc_temp DOUBLE", None):
        df = read_csv(spark, str(path), schema)
        assert df.filter("volume_1m2 IS NULL").count() == 2 and df.filter("isnan(volume_1m2)").count() == 0
    raw = spark.createDataFrame([(float("nan"), 1), (None, 2), (0.0, 3)], "x DOUBLE, k INT")
    assert tuple(null_profile(raw, ["x", "k"]).first()) == (2, 0)


def test_draft_filter_drops_nan(spark, tows):
    df = tows([dict(region=1, month=4, year=1990, volume_1m2=v) for v in (float("nan"), 0.0, 2.0, None)])
    from driftline.plans.survey import draft_volume
    assert [r.volume_1m2 for r in prepared(df, draft_volume()).collect()] == [2.0]


def test_rows_of_several_files_follow_their_paths(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n" + "".join(f"1,{i}\n" for i in range(3)))
    (tmp_path / "b.csv").write_text("k,v\n" + "".join(f"1,{i}\n" for i in range(100, 5000)))
    df = read_csv(spark, str(tmp_path), "k INT, v INT", order_col="_row")
    assert [r.v for r in df.orderBy("_row").collect()] == [*range(3), *range(100, 5000)]
    assert first_by(df, ["k"], asc_nulls_last(["_row"])).first().v == 0


def test_first_by_carries_only_what_is_asked(spark):
    rows = [("a", 3, 1, "x"), ("a", 1, 2, "y"), ("a", 1, 1, "z"), (None, 2, 2, "nk")]
    df = spark.createDataFrame(rows, "g STRING, lead BIGINT, tie INT, v STRING")
    got = first_by(df, ["g"], asc_nulls_last(["lead", "tie"]), ["v", "g"])
    assert got.columns == ["v", "g"] and _sorted(got.collect()) == [("nk", None), ("z", "a")]


def test_materialize_helpers(spark):
    from driftline.plans.materialize import (MAX_BROADCAST_ROWS, broadcast_bounded, materialize,
                                             reuse)
    df = spark.range(0, 100, numPartitions=4).select((F.col("id") % 7).alias("k"), "id")
    want = _sorted(df.collect())
    assert _sorted(reuse(df).collect()) == want
    assert _sorted(materialize(df).collect()) == want
    with pytest.raises(ValueError):
        broadcast_bounded(df, MAX_BROADCAST_ROWS + 1)


# O1, O2: text and number forms, order ------------------------------------------------
def test_csv_text_comes_back_as_it_was(spark, tmp_path):
    texts = ['say "hi"', "back\\", "a,b", "two\nlines", "cr\r\nlf", '"', '""', ",", "\n", " lead and trail ", "", None, "tab\there", "x" * 200_000,
             '\\"', 'ends with "quote"', "'single'", "#not a comment", "ünï日本", "\\n"]
    df = spark.createDataFrame([(i, t, i / 3) for i, t in enumerate(texts)], "k INT, t STRING, v DOUBLE").repartition(3)
    for n, names in enumerate((True, False)):
        path = str(tmp_path / f"t{n}")
        write_csv(df, path, row_names=names, order=[F.col("k")])
        schema = "row INT, k INT, t STRING, v DOUBLE" if names else "k INT, t STRING, v DOUBLE"
        back = read_csv(spark, path, schema).select("k", "t").collect()
        assert {r.k: r.t for r in back} == dict(enumerate(texts))


def test_csv_without_rows_is_the_header(spark, tmp_path):
    write_csv(spark.createDataFrame([], "a INT, b STRING"), str(tmp_path / "none"))
    files = [p for p in (tmp_path / "none").iterdir() if p.name.startswith("part-")]
    assert [p.read_text() for p in files if p.stat().st_size] == ['"","a","b"\n']
    assert read_csv(spark, str(tmp_path / "none"), "row INT, a INT, b STRING").collect() == []


def test_numbers_have_fifteen_digits(spark):
    from driftline.functions.numeric import short_decimal
    want = {0.1 + 0.2: "0.3", 1e-5: "1e-05", 123456789.125: "123456789.125", 1e5: "1e+05", 100001.0: "100001", 0.0001: "1e-04",
            0.00012: "0.00012", 1e15: "1e+15", 123456.0: "123456", -2.5: "-2.5", 0.0: "0", -0.0: "0", 1 / 3: "0.333333333333333", 2 / 3: "0.666666666666667",
            1e300: "1e+300", 1.5e-300: "1.5e-300", 3.0: "3", 12345678901234567.0: "12345678901234568",
            float("inf"): "Inf", float("-inf"): "-Inf", 0.123456789012345: "0.123456789012345", 1234567.0: "1234567", 1e-15: "1e-15", 120000.0: "120000", 20.0: "20"}
    rows = spark.createDataFrame([(x,) for x in want], "x DOUBLE").select("x", short_decimal("x").alias("t")).collect()
    assert {r.x: r.t for r in rows} == want
    missing = spark.createDataFrame([(float("nan"),), (None,)], "x DOUBLE").select(short_decimal("x").alias("t")).collect()
    assert [r.t for r in missing] == [None, None]


def test_a_table_in_the_method_form_is_written_as_it_stands(spark, tmp_path):
    lines = ['"","region_name","season","sd"', '"1","MAB","Spring",0.123456789012345', '"2","MAB","Winter",0.0987654321098765',
             '"3","GOM","Fall",12.5', '"4","GOM","Summer",1e-05', '"5","GB","Fall",NA', '"6","GB","Winter",0.3']
    (tmp_path / "table.csv").write_text("\n".join(lines) + "\n")
    df = read_csv(spark, str(tmp_path / "table.csv"), "row INT, region_name STRING, season STRING, sd DOUBLE")
    write_csv(df.drop("row").coalesce(1), str(tmp_path / "again"))
    parts = sorted(p for p in (tmp_path / "again").iterdir() if p.name.startswith("part-"))
    assert [x for i, p in enumerate(parts) for x in p.read_text().splitlines()[i > 0:]] == lines


def test_file_order_survives_another_split(spark, tmp_path):
    """First rows of a CSV are the same whatever the split size of later scans."""
    from driftline.plans.survey import analyse, maintained_volume
    lines = ["region,month,year,volume_1m2,station"] + [f"{1 + i % 4},{1 + i % 12},{1980 + i % 30},{i % 17}.5,{i}" for i in range(6000)]
    (tmp_path / "big.csv").write_text("\n".join(lines) + "\n")
    schema = "region INT, month INT, year INT, volume_1m2 DOUBLE, station INT"
    found = []
    try:
        for before, later in (("128m", "128m"), ("20k", "7k"), ("7k", "128m")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            tows = read_csv(spark, str(tmp_path / "big.csv"), schema, order_col="_row", line_breaks=before == "128m")
            s = analyse(tows, maintained_volume(metadata=("region", "region_name", "month", "year", "season", "station")))
            s.record.values(order=True).count()
            spark.conf.set("spark.sql.files.maxPartitionBytes", later)
            found.append(_sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in s.final().collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {}
    for line in lines[1:]:
        region, month, year, _, station = line.split(",")
        name, when = {"1": "MAB", "2": "MAB", "3": "GB", "4": "GOM"}[region], int(month)
        when = "Spring" if 3 <= when <= 5 else "Summer" if 6 <= when <= 8 else "Fall" if 9 <= when <= 11 else "Winter"
        want.setdefault((name, when, int(year)), int(station))
    columns = analyse(tows, maintained_volume()).final().columns
    assert "volume_1m2" in columns
    for rows in found:
        assert rows == found[0] and len(rows) == len(want)
    stations = {(r[1], r[4], r[3]): r[5] for r in found[0]}
    assert stations == want


# O8, O9 -------------------------------------------------------------------------------
def test_column_order():
    from driftline.operators.columns import relocate, rest_first
    cols = list("abcdef")
    assert rest_first(cols, ["e", "b", "x"]) == list("acdfbe")
    assert relocate(cols, ["e"], after="a") == list("aebcdf")
    assert relocate(cols, ["f", "b"], before="d") == list("acfbde")
    assert relocate(cols, ["c", "a"]) == list("cabdef")
    assert relocate(cols, ["b", "c"], after="b") == list("abcdef")
    with pytest.raises(KeyError):
        relocate(cols, ["z"])
    with pytest.raises(ValueError):
        relocate(cols, ["a"], after="b", before="c")


# O14, O33 -----------------------------------------------------------------------------
def test_a_missing_year_empties_the_literal_period(spark, tows):
    from driftline.operators.filters import up_to_max
    from driftline.plans.survey import analyse, maintained_volume
    rows = [dict(region=1, month=4, year=y, volume_1m2=2.0) for y in (1990, 1999, 2001)]
    gap = rows + [dict(region=1, month=4, year=None, volume_1m2=2.0)]
    assert sorted(r.year for r in up_to_max(tows(rows), "year", 1998).collect()) == [1999, 2001]
    assert up_to_max(tows(gap), "year", 1998).collect() == []
    assert sorted(r.year for r in up_to_max(tows(gap), "year", 1998, skip_missing=True).collect()) == [1999, 2001]
    assert analyse(tows(rows), maintained_volume()).period(1998, literal_max=True).summary().count() == 2
    assert analyse(tows(gap), maintained_volume()).period(1998, literal_max=True).summary().count() == 0


# O26 ----------------------------------------------------------------------------------
def test_only_repeated_keys_are_picked_from(spark):
    from driftline.operators.dedupe import prefer_then_first, prefer_where_repeated
    rows = [(f"k{i}", None if i % 5 == 0 else i % 3, "a", i) for i in range(200)]
    rows += [("k7", 1, "b", 300), ("k8", 2, "a", 301), ("k10", None, "b", 302), ("k10", None, "b", 303), (None, 1, "a", 304), (None, 1, "b", 305)]
    df = spark.createDataFrame(rows, "k STRING, s INT, gear STRING, pos INT").repartition(4)
    order = asc_nulls_last(["pos"])
    for carry in (None, ["pos", "k"]):
        want = prefer_then_first(df, ["k", "s"], "gear", "b", order, carry)
        got = prefer_where_repeated(df, ["k", "s"], "gear", "b", order, carry)
        assert got.columns == want.columns and _sorted(got.collect()) == _sorted(want.collect())


# O44 ----------------------------------------------------------------------------------
def test_categories_carry_their_levels(spark, tmp_path):
    from driftline.operators.category import as_category, count_levels, levels, sort_by
    df = spark.createDataFrame([("Fall", 1.0), ("Spring", 2.0), ("Fall", 3.0), ("Monsoon", 4.0), (None, 5.0)], "season STRING, v DOUBLE")
    order = ["Winter", "Spring", "Summer", "Fall"]
    cat = as_category(df, "season", order)
    assert cat.columns == df.columns and levels(cat.filter("v > 0").select("v", "season"), "season") == order
    assert [(r.season, r.v) for r in sort_by(cat, "season", "v").collect()] == [("Spring", 2.0), ("Fall", 1.0), ("Fall", 3.0), (None, 4.0), (None, 5.0)]
    got = {(r.season, r.level, r.n, r.total) for r in count_levels(cat, "season", F.sum("v").alias("total")).collect()}
    assert got == {("Winter", 1, 0, None), ("Spring", 2, 1, 2.0), ("Summer", 3, 0, None), ("Fall", 4, 2, 4.0), (None, None, 2, 9.0)}
    assert {r.level for r in count_levels(cat, "season", keep_empty=False).collect()} == {2, 4, None}
    cat.write.parquet(str(tmp_path / "cat"))
    assert levels(spark.read.parquet(str(tmp_path / "cat")), "season") == order
    with pytest.raises(TypeError):
        levels(df, "season")
    with pytest.raises(ValueError):
        as_category(df, "season", ["a", "a"])
