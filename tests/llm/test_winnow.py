import hashlib
import random
import re

import pytest

from driftline.llm import winnow
from driftline.llm.winnow import contamination, drop_contaminated

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        ws, hit, ids = words(text), set(), set()
        for item_id, item in items:
            iw = words(item)
            n = min(10, len(iw))
            windows = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for i in range(len(ws) - n + 1):
                if tuple(ws[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    ids.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(ws), len(hit), sorted(ids)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(5)
    vocab = ["the", "The", "of", "é", "42", "a", "and"] + ["w%d" % i for i in range(40)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randint(10, 40))) for i in range(12)] + [(50, "the the the the the the the the the the the")]
    items += [(60, "w1 w2 of"), (61, ""), (62, None), (None, say(15)), (10, items[3][1]), (70, "Zz!yy")]
    docs = [(i, say(rng.randint(0, 150))) for i in range(30)]
    for i, (_, text) in enumerate(items):
        ws = (text or "").split(" ")
        a, b = sorted((rng.randint(0, len(ws)), rng.randint(0, len(ws))))
        docs.append((100 + i, say(20) + "; " + ",\n".join(ws) + "! " + say(20)))
        docs.append((200 + i, say(5) + " " + " ".join(ws[a:b]) + " " + say(5)))
    docs += [(300, "The, the THE the the the the the the the. the the the the"), (301, None), (302, ""), (303, "...")]
    docs += [(304, "zz yy"), (None, items[0][1]), (300, "The, the THE the the the the the the the. the the the the")]
    return docs, items


@pytest.mark.parametrize("block", [32 << 20, 120])
def test_matches_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(winnow, "BLOCK_BYTES", block)
    rows, items = cases()
    df, bench = docs(rows), spark.createDataFrame(items, "item_id LONG, text STRING")
    got = contamination(df, bench).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in got], key=str) == brute(rows, items)
    clean = {r.doc_id for r in drop_contaminated(df, bench).collect()}
    assert clean == {d for d, _, hit, _ in brute(rows, items) if not hit}


def test_edge_cases(spark, docs):
    none = spark.createDataFrame([], "item_id LONG, text STRING")
    assert contamination(docs([]), none).collect() == []
    got = contamination(docs([(1, "a b"), (2, None)]), none).collect()
    assert sorted((r.n_words, r.n_hit) for r in got) == [(0, 0), (2, 0)]
    assert drop_contaminated(docs([(1, "a b")]), none).columns == docs([]).columns


def test_registered_digest(spark):
    from driftline.llm.catalog import op5_decontamination
    got = op5_decontamination(spark, "/root/testdata/sf0.001").collect()
    assert {r.items_sha256 for r in got if not r.n_items} <= {hashlib.sha256(b"").hexdigest()}
