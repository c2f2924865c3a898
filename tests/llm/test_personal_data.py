import hashlib
import random
import re

import numpy as np

from driftline.llm.catalog import op11_personal_data
from driftline.llm.personal_data import (
    KINDS, MAX_PATTERNS, Model, base_spans, candidates, estimate, features, find_personal_data, fit, luhn, patterns, train)

STRICT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
VALID = "4111 1111 1111 1111"


def slow_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(STRICT[kind], text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m.group().split(".")),
                  "card": 13 <= len(digits) <= 19 and slow_luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def told(spans):
    return [f"{s.kind}:{s.start}:{s.end}" for s in spans]


def noise(rng, n):
    bits = ["a", "Z", "é", "@", "@", ".", ".", "-", "_", "%", "+", "+1", " ", " ", "(", ")", "0", "1", "9", "12", "255", "256", "1.2.3.4",
            VALID, "4012888888881881", "30569309025904", "5105-1051-0510-5100", "a@b.c", "+1 (743) 555-3824", "\n", "日", "٣"]
    return "".join(rng.choice(bits) for _ in range(n))


def test_base_spans_match_the_patterns():
    rng = random.Random(2)
    for _ in range(6000):
        text = noise(rng, rng.randint(0, 14))
        assert told(base_spans(text)) == brute(text), text
    for text in ("1.2.3.4.5.6.7.8.9", "a@b@c.d", "a@b.c_d@e.f", "+1+12345678901", "+1 2", "0" * 5000 + ".1.1.1", "1.1.1.1" + "0" * 5000):
        assert told(base_spans(text)) == brute(text), text


def test_luhn():
    rng = random.Random(3)
    for _ in range(500):
        d = "".join(rng.choice("0123456789") for _ in range(rng.randint(13, 19)))
        assert luhn(d) == slow_luhn(d)


def test_long_texts_take_linear_time():
    for unit in ("x", "9", "9.", "+1", "a@", "1 ", "(", "a.", "[at]", "0:"):
        text = unit * (3_000_000 // len(unit))
        assert isinstance(candidates(text), list)


def labelled(rng, n):
    """Texts with loose personal data and loose decoys, and the spans that are true."""
    rows = []
    for i in range(n):
        user, host = f"user{i}", rng.choice(["mail", "post", "inbox"])
        good = [(f"Please write an email to {user} [at] {host} [dot] com today", f"{user} [at] {host} [dot] com"),
                (f"call my phone (743) 555-{rng.randint(1000, 9999)} now", None),
                ("the host 10[.]20[.]30[.]40 logged in", "10[.]20[.]30[.]40"),
                (f"my email is {user}@{host}.org and phone +1 (743) 555-3824.", "")]
        bad = [("serial number 100-055-4421 of version 2[.]0[.]1[.]900", None), ("order x123-055-44210z", None), ("nothing here", None)]
        text, span = rng.choice(good + good + bad)
        rows.append((i, text, span))
    return rows


def test_loose_spans_are_added_and_decoys_are_not(spark, docs):
    rows = labelled(random.Random(5), 300)
    got = {r.id: r for r in find_personal_data(docs([r[:2] for r in rows])).collect()}
    for i, text, span in rows:
        spans = got[i].spans.split(",") if got[i].spans else []
        assert set(brute(text)) <= set(spans)
        if span:
            at = text.index(span)
            assert any(s.endswith(f":{at}:{at + len(span)}") for s in spans), text
        elif "call my phone" in text:
            assert any(s.startswith("phone:") for s in spans), text
        elif text.startswith(("serial", "order", "nothing")):
            assert not spans, (text, spans)


def test_reliabilities_are_recovered():
    """Votes drawn with known error rates: the estimates come close, and so do the labels."""
    rng = np.random.default_rng(1)
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.9, 0.6])
    counts, truth = {}, {}
    for _ in range(20_000):
        y = int(rng.random() < 0.4)
        vote = tuple(int(v) for v in np.where(rng.random(6) < right, 2 * y - 1, 1 - 2 * y))
        p = ("email", -1, 0, vote)
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, [0, 0])[y] += 1
    found, reliabilities = estimate(counts)
    assert np.abs(reliabilities["email"][1, :, 2] - right).max() < 0.03
    assert np.abs(reliabilities["email"][0, :, 0] - right).max() < 0.03
    w = fit(counts, found)
    agree = sum(truth[p][int(features(p) @ w >= 0)] for p in counts) / sum(counts.values())
    best = sum(max(t) for t in truth.values()) / sum(counts.values())
    assert agree > best - 0.01
    assert estimate({}) == ({}, {}) and not fit({}, {}).any()


def test_known_spans_stay_known():
    strict, failed = ("card", 1, 3, (1, 1, 1, 0, 1, 0)), ("card", 0, 3, (1, -1, 1, 0, 1, 0))
    found, _ = estimate({strict: 5, failed: 500})
    assert found == {strict: 1.0, failed: 0.0}


def test_query(spark, docs, corpus, tmp_path):
    rng = random.Random(7)
    rows = list(enumerate(corpus + [noise(rng, 60) for _ in range(80)])) + [(3, corpus[3]), (None, "a@b.c"), (None, "a@b.c")]
    rows += [(1000 + r[0], r[1]) for r in labelled(rng, 40)]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = op11_personal_data(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = sorted(((i, *(sum(s.startswith(k + ":") for s in brute(t)) for k in KINDS),
                    hashlib.sha256(",".join(brute(t)).encode()).hexdigest()) for i, t in rows), key=str)
    got = out.collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    for r in got:
        spans = [(KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert spans == sorted(spans)


def test_edge_cases(spark, docs):
    assert find_personal_data(docs([])).collect() == []
    got = find_personal_data(docs([(1, None), (2, ""), (None, "x")])).collect()
    assert all(tuple(r)[1:] == (0, 0, 0, 0, "", "") for r in got) and len(got) == 3
    model = train(docs([(1, "a@b.com " + VALID)]))
    assert isinstance(model, Model) and set(model.reliabilities) == {"email", "card"}
    assert len({p for _, p in patterns("a@b.com " + VALID)}) <= MAX_PATTERNS
    assert told(model.spans(VALID + " +1 4111 1111 1111 1111")[0]) == brute(VALID + " +1 4111 1111 1111 1111")
