import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import uniform_threshold
from driftline.llm.uniform_threshold import top_k

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, score INT, rank INT, query_id INT"


def brute(rows, k, each):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable[i, tuple(v)] = [math.floor(float(np.float32(x)) * 64) for x in v]
    out = []
    for (q, _), a in usable.items():
        if q % each:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), c) for (c, _), b in usable.items() if c != q)
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("k,parts,once", [(20, 2, 2048), (3, 3, 4), (1, 1, 7), (500, 2, 2048)])
def test_matches_brute_force(spark, monkeypatch, k, parts, once):
    monkeypatch.setattr(uniform_threshold, "QUERIES_AT_ONCE", once)
    monkeypatch.setattr(uniform_threshold, "ROWS_AT_ONCE", 16)
    rng = random.Random(k)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(9)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(40)] + [(300, [0.0] * 9), (305, [0.5] * 4), (310, [])]
    rows += [(400, None), (405, [0.1, None]), (410, [float("nan")]), (415, [float("inf")] * 9), (None, [0.1] * 9)]
    rows += [rows[5]]
    df = spark.createDataFrame([(i, v, 1, 1, 1, 1) for i, v in rows], SCHEMA).repartition(3)
    got = top_k(df, F.col("vec_id") % 5 == 0, k=k, parts=parts)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, k, 5)


def test_large_components_stay_exact(spark):
    rows = [(0, [3000.0, 1.0]), (1, [2999.0, 7.0]), (2, [-3000.0, 2.0]), (3, [3000.5, -1.0])]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>")
    got = top_k(df, F.col("vec_id") == 0, k=2)
    assert [(r.vec_id, r.score) for r in got.orderBy("rank").collect()] == [
        (3, 192000 * 192032 - 64 * 64), (1, 192000 * 191936 + 64 * 448)]


def test_scores_beyond_floats_and_vectors_beyond_longs(spark):
    big = 2.0**24
    rows = [(0, [big, 3.0]), (1, [big, 2.5]), (2, [big + 1 / 64, -7.0]), (3, [-big, 1.0]), (4, [1e300, 0.0]), (5, [0.0, -1e300]),
            (6, [1.0, 1.0]), (7, [2.0**26, 0.0])]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>")
    ints = {i: [math.floor(64 * x) for x in v] for i, v in rows if i not in (4, 5, 7)}
    want = sorted((-sum(a * b for a, b in zip(ints[0], v, strict=True)), i) for i, v in ints.items() if i)
    assert 2**53 < -want[0][0] < 2**63
    got = top_k(df, F.col("vec_id") % 4 == 0, k=10).filter("query_id = 0").orderBy("rank").collect()
    assert [(-r.score, r.vec_id) for r in got] == want


def test_lists_merge_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(uniform_threshold, "FAN_IN", 2)
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>")
    assert sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 9 == 0, k=4).collect()) == brute(rows, 4, 9)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert top_k(none, F.col("vec_id") % 5 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0], 1, 1, 1, 1)], SCHEMA)
    assert top_k(one, F.col("vec_id") % 5 == 0).collect() == []
