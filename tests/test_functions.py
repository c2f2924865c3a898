"""Column functions on hand-written rows (rules S1, S3, S4, S7, O42-O44)."""

import math

import pytest
from pyspark.sql import functions as F

from driftline import constants as C
from driftline.functions import (factor_rank, fourth_root, half_min_log, region_name, row_sum,
                                 season, split_pair)


def test_season_bands_and_missing_month(spark):
    months = [2, 3, 5, 6, 8, 9, 11, 12, None]
    df = spark.createDataFrame([(m,) for m in months], "month INT")
    got = [r.s for r in df.select(season("month").alias("s")).collect()]
    assert got == ["Winter", "Spring", "Spring", "Summer", "Summer", "Fall", "Fall",
                   "Winter", "Winter"]


def test_region_filter_and_names(spark):
    codes = [0, 1, 2, 3, 4, 9, None]
    df = spark.createDataFrame([(c,) for c in codes], "region INT")
    kept = df.filter(F.col("region") != 0)
    merged = [r.n for r in kept.select(region_name("region").alias("n")).collect()]
    split = [r.n for r in kept.select(region_name("region", C.REGIONS_SPLIT).alias("n")).collect()]
    assert merged == ["MAB", "MAB", "GB", "GOM", "Outside"]  # 0 and NULL dropped
    assert split == ["MAB", "SNE", "GB", "GOM", "Outside"]


def test_row_sum_all_missing_is_zero(spark):
    df = spark.createDataFrame([(None, None, None, None), (1.0, None, 2.0, float("nan"))],
                               "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE")
    got = [r.s for r in df.select(row_sum(["a", "b", "c", "d"]).alias("s")).collect()]
    assert got == [0.0, 3.0]


def test_half_min_log(spark):
    df = spark.createDataFrame([(0.0, 2.0), (2.0, 2.0), (8.0, 2.0)], "x DOUBLE, m DOUBLE")
    got = [r.v for r in df.select(half_min_log("x", "m").alias("v")).collect()]
    assert got == pytest.approx([0.0, math.log10(3), math.log10(9)])
    ln = [r.v for r in df.select(half_min_log("x", "m", "e").alias("v")).collect()]
    assert ln == pytest.approx([0.0, math.log(3), math.log(9)])


def test_half_min_log_infinite_minimum(spark):
    df = spark.createDataFrame([(0.0,)], "x DOUBLE").withColumn("m", F.lit(math.inf))
    assert df.select(half_min_log("x", "m").alias("v")).first().v == math.inf


def test_fourth_root(spark):
    df = spark.createDataFrame([(16.0,), (None,), (0.0,)], "x DOUBLE")
    assert [r.v for r in df.select(fourth_root("x").alias("v")).collect()] == [2.0, None, 0.0]


def test_split_pair(spark):
    df = spark.createDataFrame([("c3-Spring",), ("c3",), ("a-b-c",), (None,)], "v STRING")
    a, b = split_pair("v", "-")
    got = [tuple(r) for r in df.select(a, b).collect()]
    assert got == [("c3", "Spring"), ("c3", None), ("a", "b"), (None, None)]


def test_factor_rank(spark):
    df = spark.createDataFrame([("Spring",), ("Summer",), ("Fall",), ("Winter",)], "s STRING")
    got = [r.k for r in df.select(factor_rank("s", ["Spring", "Summer", "Fall"]).alias("k")).collect()]
    assert got == [1, 2, 3, None]
