import hashlib
import random

import pytest
from pyspark.sql import functions as F

from driftline.llm import line_chunks
from driftline.llm.line_chunks import BASES, dedup_lines


def line_hash(line):
    return int(hashlib.md5(line.encode()).hexdigest()[:7], 16)


def cut_up(text):
    """(start, n) of the chunks of all polynomials, 1-based."""
    lines = text.split("\n")
    hashes, out = [line_hash(x) for x in lines], set()
    for base in BASES:
        starts = [i for i in range(1, len(lines) + 1)
                  if i == 1 or (hashes[i - 1] * base + (hashes[i] if i < len(lines) else 0)) % 2147483647 % 8 != 0]
        for i in starts:
            if i == len(lines):
                continue
            stop = min((j for j in starts if j >= i + 2), default=len(lines) + 1)
            out.add((i, stop - i))
    return out


def brute(rows):
    """rows: distinct (doc_id, text) with unique ids."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    first, out = {}, {}
    for doc_id, text in order:
        lines = (text or "").split("\n")
        for start, n in sorted(cut_up(text)) if text is not None else ():
            first.setdefault("\n".join(lines[start - 1:start - 1 + n]), (doc_id, start))
    for doc_id, text in order:
        if text is None:
            out[doc_id] = (None, 0, 0, 0)
            continue
        lines = text.split("\n")
        gone = [(s, n) for s, n in cut_up(text) if first["\n".join(lines[s - 1:s - 1 + n])] != (doc_id, s)]
        covered = {i for s, n in gone for i in range(s, s + n)}
        kept = [x for i, x in enumerate(lines, 1) if i not in covered]
        out[doc_id] = ("\n".join(kept), len(lines), len(covered), len(gone))
    return out


def repeated_lines(rows):
    """Lines of every document that lie in an adjacent line pair which an earlier place holds."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        lines = text.split("\n")
        for i, pair in enumerate(zip(lines, lines[1:], strict=False)):
            if pair in seen:
                out.setdefault(doc_id, set()).update((i + 1, i + 2))
            seen.add(pair)
    return out


def test_matches_brute_force(docs, corpus):
    rows = [(i, t) for i, t in enumerate(corpus)] + [(None, corpus[42]), (500, "\n".join(["same"] * 40))]
    got = dedup_lines(docs(rows))
    found = {r.row.doc_id: (r.text, r.n_lines, r.n_removed, r.n_chunks) for r in got.collect()}
    want = brute(rows)
    assert found == want
    assert sum(w[3] for w in want.values()) > 10


def test_equal_hashes_of_unequal_chunks(docs, corpus, monkeypatch):
    """With a hash of two values every candidate clashes; the texts decide."""
    monkeypatch.setattr(line_chunks.F, "xxhash64", lambda *c, f=F.xxhash64: F.pmod(f(*c), F.lit(2)) if len(c) == 1 and not isinstance(c[0], str) else f(*c))
    rows = [(i, t) for i, t in enumerate(corpus)]
    found = {r.row.doc_id: (r.text, r.n_lines, r.n_removed, r.n_chunks) for r in dedup_lines(docs(rows)).collect()}
    assert found == brute(rows)


def test_passages_move_with_their_lines(docs):
    passage = "\n".join("line %d of a shared passage" % i for i in range(40))
    rows = [(1, "first\n" + passage), (2, "other\nhead\n" + passage + "\nown tail")]
    got = {r.row.doc_id: r for r in dedup_lines(docs(rows)).collect()}
    assert got[1].text == rows[0][1]
    assert got[2].n_removed >= 39 and got[2].text.startswith("other\nhead") and got[2].text.endswith("own tail")


@pytest.mark.parametrize("length", [2, 3, 5, 20])
def test_recall_of_short_passages(length):
    """Lines of passages in foreign context: nine tenths go at the least, whatever their length."""
    rng = random.Random(length)
    passages = ["\n".join(f"p{length} {k} {i}" for i in range(length)) for k in range(300)]
    say = lambda: "\n".join(f"own {rng.random()}" for _ in range(rng.randint(1, 4)))
    rows = [(2 * k + h, f"{say()}\n{p}\n{say()}") for k, p in enumerate(passages) for h in (0, 1)]
    want, out = repeated_lines(rows), brute(rows)
    assert sum(out[d][2] for d in want) >= 0.9 * sum(map(len, want.values()))
    assert all(out[d][2] <= len(want.get(d, ())) for d, _ in rows)


def test_copies_go_whole_and_every_line_stays_somewhere():
    rng = random.Random(8)
    lines = [f"line {i}" for i in range(12)]
    rows = [(d, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9)))) for d in range(400)]
    rows += [(1000 + d, t) for d, t in rows]
    out = brute(rows)
    assert all(out[d][2] == out[d][1] for d, t in rows if d >= 1000 and "\n" in t)
    assert {x for d, t in rows for x in t.split("\n")} == {x for w in out.values() for x in w[0].split("\n") if x}


def test_long_texts(docs):
    many = "\n".join(f"line {i}" for i in range(60_000))
    rows = [(1, many), (2, "own\n" + many), (3, "x" * 5_000_000), (4, "x" * 5_000_000 + "\nend"), (5, "x" * 5_000_000 + "\nend")]
    got = {r.row.doc_id: (r.n_lines, r.n_removed, len(r.text)) for r in dedup_lines(docs(rows)).collect()}
    assert got[1] == (60_000, 0, len(many)) and got[2][1] >= 59_999
    assert got[3] == (1, 0, 5_000_000) and got[4][1] == 0 and got[5] == (2, 2, 0)


def test_edge_cases(docs):
    assert dedup_lines(docs([])).collect() == []
    rows = [(1, "a\nb\nc\nd\ne\nf"), (1, "a\nb\nc\nd\ne\nf"), (None, None), (None, None)]
    got = dedup_lines(docs(rows)).collect()
    assert len(got) == 4 and all(r.n_removed == 0 for r in got)
    assert set(got[0].row.asDict()) >= {"doc_id", "text", "th", "id", "row", "fp"}
