"""Whole analyses against a literal row-by-row pandas rendering of the method.

The pandas side follows the method step by step on every row (grouped
values written onto rows, SD over rows carrying the yearly mean, first-row
picks by sorting), so it checks the small-table algebra the Spark plans use.
"""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline import constants as C
from driftline.plans.survey import analyse, maintained_fish, maintained_volume

SEASONS = {m: s for s, lo, hi in C.SEASON_BANDS for m in range(lo, hi + 1)}


def random_tows(n=400, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        cruise = rnd.choice(["PC01", "PC02", "AL03"])
        station = rnd.randint(1, 15)
        date = f"20{rnd.randint(0, 9):02d}-0{rnd.randint(1, 9)}-1{rnd.randint(0, 2)}"
        year = int(date[:4])
        month = int(date[5:7]) if rnd.random() > 0.02 else None
        fish = [rnd.choice([None, None, 0.0, round(rnd.random() * 9, 3)]) for _ in range(4)]
        rows.append(dict(
            cruise_name=cruise, station=station, zoo_gear=rnd.choice(["6B3Z", "6B3", ""]),
            ich_gear=rnd.choice(["6B3Z", "6B3", ""]), region=rnd.choice([0, 1, 2, 3, 4, 4, 7, None]),
            date=date, month=month, year=year, cluhar_10m2=fish[0], scosco_10m2=fish[1],
            pepspp_10m2=fish[2], ammspp_10m2=fish[3],
            volume_1m2=rnd.choice([None, 0.0, round(rnd.random() * 50, 2), round(rnd.random(), 3)]),
        ))
    return rows


def literal(rows, fish: bool):
    df = pd.DataFrame(rows)
    df["_row"] = range(len(df))
    df["season"] = [SEASONS.get(m, "Winter") if m == m and m is not None else "Winter"
                    for m in df["month"]]
    df = df[df["region"].notna() & (df["region"] != 0)].copy()
    df["region_name"] = [C.REGIONS_MERGED.get(int(r), "Outside") for r in df["region"]]
    if fish:
        df = df[df["ich_gear"].notna() & (df["ich_gear"] != "")]
        df = df.assign(_pref=(df["zoo_gear"] == "6B3Z").astype(int))
        df = df.sort_values(["cruise_name", "station", "region_name", "date", "_pref", "_row"],
                            ascending=[True, True, True, True, False, True], kind="stable")
        df = df.drop_duplicates(["cruise_name", "station", "region_name", "date"], keep="first")
        df["value"] = df[list(C.FORAGE_FISH)].sum(axis=1, skipna=True)
        lbl = "FF"
    else:
        df = df[df["volume_1m2"].notna()].copy()
        df["value"] = df["volume_1m2"]
        lbl = "ZP"
    pos = df["value"].where(df["value"] > 0)
    df["min_nonzero"] = pos.groupby([df["region_name"], df["season"]]).transform("min").fillna(math.inf)
    df["log"] = np.log10(df["value"] + df["min_nonzero"] / 2)
    df["log_mean"] = df.groupby(["region_name", "year", "season"])["log"].transform("mean")
    df["sd"] = df.groupby(["region_name", "season"])["log_mean"].transform(lambda s: s.std(ddof=1))
    annual = (df.groupby(["region_name", "season", "year"], as_index=False)["log"].mean()
                .sort_values(["region_name", "season", "year"]))
    annual["run"] = (annual.groupby(["region_name", "season"])["log"]
                     .transform(lambda s: s.rolling(5, min_periods=1).mean()))
    first = df.drop_duplicates(["region_name", "season", "year"], keep="first")
    return df, annual, first, lbl


def _close(a, b):
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or (isinstance(b, float) and math.isnan(b))
    return b is not None and abs(a - b) <= 1e-9 * max(1.0, abs(a))


@pytest.mark.parametrize("fish", [True, False])
def test_analysis_matches_literal(spark, tows, fish):
    rows = random_tows()
    spec = maintained_fish() if fish else maintained_volume()
    s = analyse(tows(rows), spec)
    n = spec.names
    df, annual, first, lbl = literal(rows, fish)

    sd_want = {(r.region_name, r.season): r.sd for r in df.drop_duplicates(["region_name", "season"]).itertuples()}
    sd_got = {(r[n.region], r.season): r[n.sd] for r in s.report().collect()}
    assert sd_got.keys() == sd_want.keys()
    for k in sd_want:
        assert _close(sd_want[k], sd_got[k]), k

    run_want = {(r.region_name, r.season, r.year): (r.log, r.run) for r in annual.itertuples()}
    run_got = {(r[n.region], r.season, r.year): (r[n.mean], r[n.run]) for r in s.series.collect()}
    assert run_got.keys() == run_want.keys()
    for k, (m, rm) in run_want.items():
        assert _close(m, run_got[k][0]) and _close(rm, run_got[k][1]), k

    tows_got = s.tows()
    assert tows_got.count() == len(df)
    final = {(r[n.region], r.season, r.year): r["_row"] for r in s.first_rows().collect()}
    want_first = {(rn, se, y): row for rn, se, y, row in
                  zip(first["region_name"], first["season"], first["year"], first["_row"])}
    assert final == want_first


def test_report_invariant_under_partitioning(spark, tows):
    rows = random_tows(seed=11)
    base = tows(rows)
    a = {tuple(r[:2]): r[2] for r in analyse(base, maintained_volume()).report().collect()}
    shuffled = base.repartition(5, F.rand(seed=1))
    b = {tuple(r[:2]): r[2] for r in analyse(shuffled, maintained_volume()).report().collect()}
    assert a.keys() == b.keys()
    assert all(_close(a[k], b[k]) for k in a)


def test_fish_sd_invariant_under_scaling(spark, tows):
    """log(10x + 10m/2) = log(x + m/2) + 1: the SD does not move."""
    rows = random_tows(seed=5)
    scaled = [dict(r, **{c: (r[c] * 10 if r[c] is not None else None) for c in C.FORAGE_FISH})
              for r in rows]
    a = {tuple(r[:2]): r[2] for r in analyse(tows(rows), maintained_fish()).report().collect()}
    b = {tuple(r[:2]): r[2] for r in analyse(tows(scaled), maintained_fish()).report().collect()}
    assert all(_close(a[k], b[k]) or abs(a[k] - b[k]) < 1e-9 for k in a)


def test_constant_series_running_mean(spark, tows):
    rows = [dict(region=3, month=7, year=y, volume_1m2=4.0) for y in range(1990, 2000) for _ in range(2)]
    s = analyse(tows(rows), maintained_volume())
    assert {round(r.runMean_ZP, 12) for r in s.series.collect()} == {round(math.log10(6.0), 12)}  # 4 + min/2


def test_dedupe_is_idempotent(spark, tows):
    from driftline.plans.survey import prepared
    rows = random_tows(seed=9)
    once = prepared(tows(rows), maintained_fish())
    twice = prepared(once.drop("fishsum"), maintained_fish())
    key = lambda r: r["_row"]
    assert sorted(map(key, once.collect())) == sorted(map(key, twice.collect()))


def test_periods_never_overlap(spark, tows):
    rows = [dict(r, date=f"{y}-04-10", year=y, month=4) for y, r in
            zip(range(1975, 2005), random_tows(n=30, seed=4))]
    s = analyse(tows(rows), maintained_volume())
    early = {r["_row"] for r in s.period(*C.EARLY_PERIOD).logged.collect()}
    recent = {r["_row"] for r in s.period(C.RECENT_START).logged.collect()}
    assert early and recent and not (early & recent)
    # the offset minimum comes from the whole record, also inside a period
    assert {r.min_nonzero for r in s.period(*C.EARLY_PERIOD).logged.collect()} <= \
        {r.min_nonzero for r in s.logged.collect()}


def test_draft_entries_equal_row_path(spark, tows, monkeypatch):
    """Group-sum variant: weighted (sample, month, year) entries give the row-level results."""
    from driftline.plans import survey
    from driftline.plans.survey import draft_fish, year_weighted_by_code
    rows = random_tows(n=300, seed=21)
    spec = draft_fish()

    def results():
        s = analyse(tows(rows), spec)
        summ = {tuple(r[:3]): tuple(r[3:]) for r in s.summary().collect()}
        by_code = {tuple(r[:2]): r[2] for r in year_weighted_by_code(s).collect()}
        return s.record.grouped, summ, by_code

    used, summ_e, code_e = results()
    monkeypatch.setattr(survey, "_entries_apply", lambda spec: False)
    unused, summ_r, code_r = results()
    assert used and not unused
    assert summ_e.keys() == summ_r.keys() and code_e.keys() == code_r.keys()
    for k in summ_r:
        assert all(_close(a, b) for a, b in zip(summ_e[k], summ_r[k])), k
    assert all(_close(code_e[k], code_r[k]) for k in code_r)


def test_survey_csv_through_the_analysis(spark, tmp_path):
    """The user path: survey CSV (NA = missing) -> file order -> maintained analyses."""
    from driftline.sources.csv import read_csv
    rows = random_tows(n=250, seed=17)
    cols = ["cruise_name", "station", "zoo_gear", "ich_gear", "region", "date", "month", "year",
            *C.FORAGE_FISH, "volume_1m2"]

    def cell(v):
        return "NA" if v is None else (f'"{v}"' if isinstance(v, str) else str(v))
    text = ",".join(cols) + "\n" + "\n".join(",".join(cell(r[c]) for c in cols) for r in rows) + "\n"
    path = tmp_path / "survey.csv"
    path.write_text(text)
    schema = ("cruise_name STRING, station INT, zoo_gear STRING, ich_gear STRING, region INT, "
              "date STRING, month INT, year INT, cluhar_10m2 DOUBLE, scosco_10m2 DOUBLE, "
              "pepspp_10m2 DOUBLE, ammspp_10m2 DOUBLE, volume_1m2 DOUBLE")
    tows = read_csv(spark, str(path), schema, order_col="_row")
    for fish in (True, False):
        spec = maintained_fish() if fish else maintained_volume()
        n = spec.names
        df, annual, first, lbl = literal(rows, fish)
        want = {(a, b): v for a, b, v in zip(df["region_name"], df["season"], df["sd"])}
        got = {(r[n.region], r.season): r[n.sd] for r in analyse(tows, spec).report().collect()}
        assert got.keys() == want.keys()
        assert all(_close(want[k], got[k]) for k in want)


def test_keep_false_gives_the_same_report(spark, tows):
    rows = random_tows(seed=13)
    for spec in (maintained_fish(), maintained_volume()):
        a = {tuple(r[:2]): r[2] for r in analyse(tows(rows), spec).report().collect()}
        b = {tuple(r[:2]): r[2] for r in analyse(tows(rows), spec, keep=False).report().collect()}
        assert a.keys() == b.keys() and all(_close(a[k], b[k]) for k in a)


def test_final_tables_have_the_reference_columns(spark, tows):
    """Names and order of the running-mean tables on a survey-shaped frame."""
    df = tows(random_tows(n=120, seed=3))
    for c in C.TOW_METADATA:
        if c not in df.columns and c not in ("season", "region_name"):
            df = df.withColumn(c, F.lit(1.0))
    df = df.withColumn("another_10m2", F.lit(2.0))
    tail = lambda x: ["min_nonzero", f"log10_{x}", f"log_mean_{x}", f"sd_{x}", f"runMean_{x}"]
    fish, volume = analyse(df, maintained_fish()), analyse(df, maintained_volume())
    want_fish = [*C.TOW_METADATA, *C.FORAGE_FISH, "fishsum", *tail("FF")]
    want_volume = [*C.TOW_METADATA, "volume_1m2", *tail("ZP")]
    assert (len(want_fish), len(want_volume)) == (33, 29)
    assert fish.final().columns == want_fish and volume.final().columns == want_volume
    assert fish.period(1998).final().columns == want_fish
    assert fish.tows().columns == want_fish[:-1] and volume.tows().columns == want_volume[:-1]


def test_close_deletes_what_was_stored(spark, tows):
    import os
    with analyse(tows(random_tows(n=60, seed=1)), maintained_fish()) as s:
        assert s.final().count() > 0
        paths = [p.removeprefix("file:") for p in s.record._paths]
        assert paths and all(os.path.isdir(p) for p in paths)
    assert not any(os.path.exists(p) for p in paths)


def test_smoothed_and_year_weighted_sd(spark, tows):
    rows = random_tows(n=300, seed=8)
    s = analyse(tows(rows), maintained_volume(sd_source="running_mean"))
    run = {(r.region_name, r.season, r.year): r.runMean_ZP for r in s.series.collect()}
    per = {}
    for r in s.logged.collect():
        per.setdefault((r.region_name, r.season), []).append(run[r.region_name, r.season, r.year])
    for r in s.report().collect():
        v = per[r.region_name, r.season]
        m = sum(v) / len(v)
        want = math.sqrt(sum((x - m) ** 2 for x in v) / (len(v) - 1)) if len(v) > 1 else None
        assert _close(want, r.sd_ZP)
