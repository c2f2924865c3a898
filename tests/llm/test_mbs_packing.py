import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftline.llm import mbs_packing
from driftline.llm.mbs_packing import Encoder, pack, plan

VOCABULARY = "byte_bpe_50k.json"


def ids_of(text, tokenizer=[]):  # noqa: B006
    if not tokenizer:
        tokenizer.append(Tokenizer.from_file(public_tokenizers.path(VOCABULARY)))
    return tokenizer[0].encode(text or "", add_special_tokens=False).ids


def test_ids_equal_those_of_tokenizers(monkeypatch, corpus):
    rng = random.Random(9)
    marks = [" ", " ", " ", "\n", "\t", "a", "B", "é", "ß", "1", "22", "'s", "'", "!", " ", "́", "漢", "🙂", " ", "ing"]
    texts = corpus + ["".join(rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["\n".join(t or "" for t in corpus[:9]), "<|endoftext|>", "a <|endoftext|> b"]
    for cached in (400_000, 40):
        monkeypatch.setattr(mbs_packing, "CACHED_WORDS", cached)
        encoder = Encoder(VOCABULARY)
        for at in range(0, len(texts), 50):
            got = encoder.encode(texts[at:at + 50])
            assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(t) for t in texts[at:at + 50]]


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_length_once_and_packs_tight(seed):
    rng = random.Random(seed)
    lengths = [min(512, int(rng.expovariate(1 / 90)) + 1) for _ in range(rng.choice([1, 40, 3000]))]
    bins = plan(Counter(lengths), 512)
    used = Counter()
    for repeats, pattern in bins:
        assert sum(n * t for n, t in pattern) <= 512
        for n, t in pattern:
            used[n] += repeats * t
    assert used == Counter(lengths) and len(bins) <= 512
    assert sum(r for r, _ in bins) <= -(-sum(lengths) // 512) * 1.02 + 1


def test_fullest_combination_by_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 4))}
        room = rng.randint(0, 70)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * t for s in sums for t in range(c + 1)}
        got = mbs_packing._fullest(counts, room)
        assert sum(n * t for n, t in got) == max(s for s in sums if s <= room)
        assert all(t <= counts[n] for n, t in got)


def check(rows, got, capacity):
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.ids_crc32 if r.piece == 0 else None].append(r)
    want = []
    for doc_id, text in rows:
        ids = ids_of(text) + [0]
        first = len(ids) if len(ids) <= capacity else (len(ids) - 1) % capacity + 1
        for i, s in enumerate([0, *range(first, len(ids), capacity)]):
            e = first if i == 0 else s + capacity
            want.append((doc_id, i, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())))
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(w[3] for w in want) // capacity)


def test_pack(docs, corpus):
    rows = list(enumerate(corpus)) + [(3, corpus[3]), (None, "null id"), (None, None)]
    for capacity in (64, 2048):
        n, least = check(rows, pack(docs(rows), VOCABULARY, capacity).collect(), capacity)
        assert n <= least * 1.05 + 1
    assert pack(docs([]), VOCABULARY).collect() == []


def test_registered_query(spark):
    from driftline.llm.catalog import op8_packing
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    n, least = check(rows, op8_packing(spark, "/root/testdata/sf0.001").collect(), 2048)
    assert n <= least + 2
