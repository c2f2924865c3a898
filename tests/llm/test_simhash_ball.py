import random

import numpy as np
import pytest
import xxhash

from driftline.llm import simhash_ball
from driftline.llm.components import connected_components
from driftline.llm.simhash_ball import Variants, fingerprint, forest, keep_one, simhash_groups


def slow_fingerprint(text, k=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c not in "\t\n\x0b\x0c\r" else " "
                                for c in text or "").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(values, linked):
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v
    for i, a in enumerate(values):
        for b in values[:i]:
            if linked(a, b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {v: top(v) for v in values}


def brute(rows):
    fps = {t: slow_fingerprint(t) for _, t in rows}
    root = roots(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    best = {}
    for doc_id, text in rows:
        r = root[fps[text]]
        if doc_id is not None:
            best[r] = min(best.get(r, doc_id), doc_id)
    return sorted([(d, fps[t], best.get(root[fps[t]])) for d, t in rows], key=str)


def test_fingerprint(monkeypatch, corpus):
    monkeypatch.setattr(simhash_ball, "BLOCK", 7)
    for t in corpus:
        assert fingerprint(t) == slow_fingerprint(t)
    assert fingerprint("A b C d") == slow_fingerprint("a b C d")


def test_groups_match_brute_force(docs, corpus):
    rows = list(enumerate(corpus)) + [(3, corpus[3]), (None, corpus[30]), (None, "quite alone here null id")]
    got = simhash_groups(docs(rows)).collect()
    assert sorted([(r.id, r.fp % (1 << 64), r.component_id) for r in got], key=str) == brute(rows)


def test_one_of_each_group_stays(docs, corpus):
    rows = list(enumerate(corpus)) + [(0, corpus[0]), (0, corpus[0]), (None, corpus[30]), (None, "quite alone here null id")]
    got = keep_one(docs(rows))
    groups = {c for d, _, c in brute(rows) if c is not None}
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == sorted(groups)
    assert [r.text for r in got.collect() if r.doc_id is None] == ["quite alone here null id"]
    assert got.columns == docs([]).columns


def test_every_close_pair_meets():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = set(base)
    for b in base:
        for _ in range(4):
            for n in (1, 2, 3, 4, 5, 6):
                v = b
                for bit in rng.sample(range(64), n):
                    v ^= 1 << bit
                values.add(v)
    x = np.array(sorted(values), np.uint64)
    ball = Variants(4, 32)
    edges = set()
    for turn in range(ball.passes):
        buckets = {}
        for part in (x[::2], x[1::2]):
            for bucket, mine in ball.deal(part, turn):
                buckets.setdefault(bucket, []).append(mine)
        for bucket, parts in buckets.items():
            a, b = ball.links(np.concatenate(parts), bucket, turn)
            edges |= set(zip(a.tolist(), b.tolist(), strict=True))
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    near = roots(x.tolist(), lambda a, b: (a ^ b).bit_count() <= 4)
    star = roots(x.tolist(), lambda a, b: (a, b) in edges or (b, a) in edges)
    assert near == star
    with pytest.raises(ValueError):
        Variants(3, 32)


def test_forest_connects_the_same():
    rng = random.Random(8)
    for n in (0, 1, 40, 300):
        pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(n)]
        a, b = (np.array([p[i] for p in pairs], np.uint64) for i in (0, 1))
        x, y = forest(a, b)
        kept = set(zip(x.tolist(), y.tolist(), strict=True))
        nodes, linked = range(61), set(pairs)
        one = roots(nodes, lambda p, q: (p, q) in linked or (q, p) in linked)
        assert one == roots(nodes, lambda p, q: (p, q) in kept or (q, p) in kept)
        assert len(kept) == sum(k != v for k, v in one.items())


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(-60, 60), rng.randint(-60, 60)) for _ in range(70)] + [(i, i + 1) for i in range(1000, 1040)]
    pairs += [(5, 5), (7, 9), (9, 7)]
    nodes = sorted({v for p in pairs for v in p})
    linked = set(pairs) | {(b, a) for a, b in pairs}
    want = {k: v for k, v in roots(nodes, lambda a, b: (a, b) in linked).items() if k != v}
    got = connected_components(spark.createDataFrame(pairs, "a LONG, b LONG")).collect()
    assert {r.node: r.root for r in got} == want
    assert connected_components(spark.createDataFrame([], "a LONG, b LONG")).collect() == []


def test_empty_table(docs):
    assert simhash_groups(docs([])).collect() == []
    assert keep_one(docs([])).collect() == []
