"""Property tests (hypothesis) for the series windows and the weighted SD."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from driftline.operators.series import running_mean, with_weighted_sd

values = st.lists(st.one_of(st.none(), st.floats(-5, 5, allow_nan=False)), min_size=1, max_size=12)


def _mean(xs):
    xs = [x for x in xs if x is not None]
    return sum(xs) / len(xs) if xs else None


def _close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, abs_tol=1e-9))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=values, k=st.integers(1, 6), gap=st.integers(1, 3))
def test_running_mean_matches_row_window(spark, vals, k, gap):
    years = [1990 + i * gap for i in range(len(vals))]  # gaps must not shorten the frame
    df = spark.createDataFrame([("g", y, v) for y, v in zip(years, vals)], "k STRING, year INT, x DOUBLE")
    out = running_mean(running_mean(df, ["k"], "year", "x", "part", k=k), ["k"], "year", "x", "full",
                       k=k, complete=True)
    got = {r.year: (r.part, r.full) for r in out.collect()}
    for i, y in enumerate(years):
        frame = vals[max(0, i - k + 1): i + 1]
        want_full = _mean(frame) if len(frame) == k and all(v is not None for v in frame) else None
        assert _close(got[y][0], _mean(frame)) and _close(got[y][1], want_full)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.floats(-3, 3, allow_nan=False)),
                               st.integers(1, 4)), min_size=1, max_size=10))
def test_weighted_sd_matches_expanded_rows(spark, rows):
    annual = spark.createDataFrame([("g", i, m, n) for i, (m, n) in enumerate(rows)],
                                   "k STRING, year INT, m DOUBLE, n BIGINT")
    expanded = [m for m, n in rows if m is not None for _ in range(n)]
    if len(expanded) < 2:
        want = None
    else:
        mu = sum(expanded) / len(expanded)
        want = math.sqrt(sum((x - mu) ** 2 for x in expanded) / (len(expanded) - 1))
    got = with_weighted_sd(annual, ["k"], "m", "n", "sd").first().sd
    assert (want is None and got is None) or got == pytest.approx(want, abs=1e-9)
