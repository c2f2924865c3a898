import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from driftline.llm import spelling
from driftline.llm.catalog import op13_spelling_variants
from driftline.llm.spelling import LOWER, UPPER, letter_counts, near_words, one_edit, spelling_variants, word_runs

NAMES = ["word", "form", "root", "n", "n_near", "form_n"]


def brute_near(counts):
    """Near words of each word, by the texts that one deletion leaves (position kept for replacements)."""
    near, holes = defaultdict(set), defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            holes[w[:i], w[i + 1:]].add(w)
            short = w[:i] + w[i + 1:]
            if short in counts:
                near[short].add(w)
                near[w].add(short)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute(counts, ratio=10):
    near, form = brute_near(counts), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n, len(near[w]), None if form[w] is None else counts[form[w]]) for w, n in counts.items())


def drawn(rows):
    """The query's words: runs of letters, one in 31 short of a letter."""
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, LOWER))
            draw = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if draw % 31 == 0:
                at = draw % len(run)
                run = run[:at] + run[at + 1:]
            found[run] += len(run) >= 7
    return {w: n for w, n in found.items() if n >= 2}


def answers(df):
    return sorted(tuple(r[c] for c in NAMES) for r in df.collect())


def lexicon(seed, n=40, ends="abç"):
    """Words a few edits apart, with counts over several powers of ten."""
    rng = random.Random(seed)
    out = {}
    for _ in range(n):
        w = "".join(rng.choice(ends) for _ in range(rng.randint(7, 11)))
        for k in (4000, 300, 25, 2):
            out[w] = rng.choice([k, k, k + 1, 10 * k])
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + rng.choice(ends) + w[at:], w[:at] + rng.choice(ends) + w[at + 1:],
                            (w[:at] + w[at + 1:]) if len(w) > 7 else w + "a"])
    return out


@pytest.mark.parametrize("piece", [2048, 5, 1])
def test_matches_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(spelling, "PIECE", piece)
    counts = lexicon(3) | lexicon(4, 20, "xyzÀ") | {"x" * 700: 5, "x" * 701: 90, "y" + "x" * 700: 900, "ééééééé": 3, "日本語日本語日本": 30, "日本語日本語日本語": 3}
    words = spark.createDataFrame([(w, n, "a", 1) for w, n in counts.items()], "word STRING, n LONG, form STRING, key INT").repartition(4)
    got = answers(spelling_variants(words.select("word", "n")))
    want = brute(counts)
    assert got == want
    assert sum(w[1] is not None for w in want) > 30
    assert max(sum(1 for _ in iter_forms(w, want)) for w in counts) >= 3


def iter_forms(w, want):
    form = {x[0]: x[1] for x in want}
    while form[w] is not None:
        w = form[w]
        yield w


def test_query(spark, docs, corpus, tmp_path):
    rng = random.Random(9)
    base = ["mountain", "riverside", "Éclairage", "wonderful", "ÀÀÀÀÀÀÀ", "naïvetés"]
    texts = [" ".join(rng.choice(base) + rng.choice(["", "", ",", "s", "7"]) for _ in range(80)) for _ in range(60)]
    rows = list(enumerate(corpus + texts)) + [(3, corpus[3]), (None, corpus[4]), (None, texts[0])]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = op13_spelling_variants(spark, str(tmp_path))
    assert out.columns == NAMES
    want = brute(drawn(rows))
    assert answers(out) == want
    assert any(w[1] for w in want)


def test_distances():
    words = ["abcdefg", "ÿÀabcdz", "日本語", "zzzz"]
    x = letter_counts(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            apart = sum((a.count(c) - b.count(c)) ** 2 for c in set(a + b))
            got = float(np.sum((x[i] - x[j]) ** 2))
            assert got <= apart if "日" in a + b else got == apart


def test_one_edit():
    rng = random.Random(1)
    for _ in range(4000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in "ab")
        want = a != b and (any(a[:i] + a[i + 1:] == b for i in range(len(a))) or any(b[:i] + b[i + 1:] == a for i in range(len(b)))
                           or (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1))
        assert one_edit(a, b) == want


def test_long_text_and_edge_cases(spark, docs):
    rows = [(1, "x" * 5_000_000), (2, None), (3, ""), (None, "short words only")]
    assert [(r.id, len(r.run)) for r in word_runs(docs(rows)).collect()] == [("1", 5_000_000)]
    nothing = spark.createDataFrame([], "word STRING, n LONG")
    assert spelling_variants(nothing).collect() == []
    with pytest.raises(ValueError):
        near_words(nothing, least=1)
