import random
from collections import Counter

import pytest

from driftline.llm import repeats
from driftline.llm.repeats import Repeats, groups, intervals


def brute(rows, length):
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(r[i:i + length] for _, r in raws for i in range(len(r) - length + 1))
    out = []
    for d, r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(r), sum(gone), runs, bytes(b for b, g in zip(r, gone, strict=True) if not g)))
    return sorted(out, key=str)


def many(seed, n=60):
    rng = random.Random(seed)
    words = ["alpha", "béta", "gamma", "delta ", "e", "zeta\n", "eta", "theta!"]
    say = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", str(rng.randint(0, 99))]) for _ in range(n))
    base = [say(60) for _ in range(4)]
    out = []
    for i in range(n):
        b = rng.choice(base)
        a, z = sorted((rng.randint(0, len(b)), rng.randint(0, len(b))))
        out.append(say(rng.randint(0, 15)) + b[a:z] + say(rng.randint(0, 15)))
    return out


def digest(r):
    return [(x.id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in r.removed().collect()]


@pytest.mark.parametrize("length,bucket", [(200, 128), (40, 128), (40, 3)])
def test_matches_brute_force(docs, corpus, monkeypatch, length, bucket):
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    rows = list(enumerate(corpus + many(length))) + [(3, corpus[3]), (None, corpus[5]), (3, "x" * 300)]
    got = sorted(digest(Repeats(docs(rows), length)), key=str)
    want = brute(rows, length)
    assert got == want
    assert sum(w[2] for w in want) > 5000


def test_occurrences_hold_equal_bytes(docs):
    rows = list(enumerate(many(2, 40)))
    found = Repeats(docs(rows), 60).occurrences().collect()
    by = {}
    for r in found:
        by.setdefault((r.bucket, r.group), set()).add((r.id, r.start, r.stop))
    assert by
    for places in by.values():
        assert len(places) > 1
        bodies = {dict(rows)[d].encode()[a:b] for d, a, b in places}
        assert len(bodies) == 1 and len(bodies.pop()) >= 60


def expanded(r):
    """Every group as the set of its occurrences."""
    by = {}
    for x in r.occurrences().collect():
        by.setdefault((x.bucket, x.group), set()).add((x.id, x.th, x.start, x.stop))
    return sorted(sorted(map(str, g)) for g in by.values())


def test_hot_buckets_have_the_same_groups(docs, monkeypatch):
    rows = list(enumerate(many(11, 50))) + [(100, many(11, 50)[0])]
    cold = expanded(Repeats(docs(rows), 60))
    monkeypatch.setattr(repeats, "BUCKET", 2)
    assert expanded(Repeats(docs(rows), 60)) == cold
    assert len(cold) > 20


def test_one_span_per_stretch(docs):
    found = Repeats(docs(list(enumerate(many(4, 60)))), 50)
    assert found.spans.count() == found.spans.select("ak", "sh").distinct().count() > 50


def test_segments_of_long_texts(docs, monkeypatch):
    rows = list(enumerate(many(3, 30)))
    rows.append((99, " ".join(t for _, t in rows[:20])))
    monkeypatch.setattr(repeats, "SEGMENT", 300)
    assert sorted(digest(Repeats(docs(rows), 60)), key=str) == brute(rows, 60)


def test_long_text(docs):
    long = "".join(random.Random(1).choices("abcdefgh ", k=2_500_000))
    got = {r[0]: r[1:4] for r in digest(Repeats(docs([(1, long), (2, "HEAD#" + long[1_048_000:1_049_500] + "#TAIL")]), 200))}
    assert got == {1: (2_500_000, 1500, 1), 2: (1510, 1500, 1)}


def test_groups_are_maximal():
    rng = random.Random(6)
    for _ in range(300):
        members = []
        for _ in range(rng.randint(1, 9)):
            left, right = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in "lr")
            members.append(((left + "X" + right).encode(), len(left), 1))
        members = list({(s, p): (s, p, n) for s, p, n in members}.values())
        got = groups(members, 4)
        want = set()
        for i, (a, pa, _) in enumerate(members):
            for b, pb, _ in members[:i]:
                left, right = repeats._shared(a[:pa][::-1], b[:pb][::-1]), repeats._shared(a[pa:], b[pb:])
                if left + right >= 4:
                    body = a[pa - left:pa + right]
                    own = tuple(m for m, (s, p, _) in enumerate(members) if p >= left and s[p - left:p + right] == body)
                    want.add((left, right, own))
        assert {(x, y, tuple(sorted(o))) for x, y, o in got} == want


def test_intervals():
    assert sorted(intervals([2, 5, 5, 1])) == [(1, 0, 4), (2, 0, 3), (5, 1, 3)]
    assert intervals([]) == [] and intervals([0]) == [(0, 0, 1)]


def test_edge_cases(docs):
    assert digest(Repeats(docs([]), 200)) == []
    assert digest(Repeats(docs([(1, None)]), 200)) == [(1, 0, 0, 0, b"")]
    with pytest.raises(ValueError):
        Repeats(docs([]), 10)
