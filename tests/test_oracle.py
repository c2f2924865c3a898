"""Every registered query against its SQL twin (DuckDB) on the smallest tables,
plus the shape of the SD report (three regions x four seasons)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_every_query_has_a_twin():
    import __spark_entry__ as E
    from driftline.plans.catalog import QUERIES
    assert set(QUERIES) <= set(E.oracle_sql())


def test_queries_match_sql_twins(spark):
    from compare import compare
    from driftline.plans.catalog import QUERIES
    res = compare(spark, SF, names=list(QUERIES), verbose=False)
    bad = {k: v["status"] for k, v in res.items() if v["status"] != "match"}
    assert not bad


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert {"region_name", "season", "year", "log_mean_FF", "runMean_FF", "sd_FF"} <= set(df.columns)


def test_report_shape(spark):
    from driftline.operators.series import descending_report
    from driftline.plans.catalog import q_fish_sd_report, q_sd_report
    # fixed values: the three named regions in report order, and the seasons
    regions = ["MAB", "GOM", "GB"]
    seasons = {"Spring", "Summer", "Fall", "Winter"}
    for fn, col in ((q_sd_report, "sd_ZP"), (q_fish_sd_report, "sd_FF")):
        rep = descending_report(fn(spark, SF), "region_name", "season").collect()
        assert len(rep) == 12
        assert list(rep[0].asDict()) == ["region_name", "season", col]
        assert [r.region_name for r in rep[::4]] == regions
        assert all({r.season for r in rep if r.region_name == g} == seasons for g in regions)
        assert all(r[col] is not None and r[col] > 0 for r in rep)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="sf0.01 tables not present")
def test_fixture_check_values(spark):
    """Values measured on the fixture when it was designed (FIXTURES.md)."""
    from dataclasses import replace

    from driftline.plans.catalog import FISH, ZOO
    from driftline.plans.survey import analyse
    from driftline.sources.fixture import tow_view
    tow = tow_view(spark, "/root/testdata/sf0.01")
    cell = "region_name = 'GB' AND season = 'Fall'"
    fish = analyse(tow, FISH)
    assert fish.report().filter(cell).first().sd_FF == pytest.approx(0.0216013, abs=5e-8)
    assert fish.logged.filter(cell).count() == 465
    by_year = analyse(tow, replace(FISH, sd_weight="year"))
    assert by_year.report().filter(cell).first().sd_FF == pytest.approx(0.0237, abs=5e-5)
    zoo = analyse(tow, ZOO)
    assert zoo.report().filter(cell).first().sd_ZP == pytest.approx(0.0272266, abs=5e-8)
    assert zoo.logged.filter(cell).count() == 2699
