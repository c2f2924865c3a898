"""Texts of five million bytes through the operators whose own tests have none."""

import zlib

from driftline.llm.interleave import interleave
from driftline.llm.mbs_packing import pack
from driftline.llm.simhash_ball import fingerprint, simhash_groups
from driftline.llm.winnow import contamination
from test_simhash_ball import slow_fingerprint

ITEM = "one two three four five six seven eight nine ten eleven twelve"
LONG = "lorem ipsum dolor " * 280_000 + ITEM + " sit amet" * 10


def test_sharding(docs):
    rows = [(1, LONG), (2, "short"), (3, None)]
    got = {r.doc_id: r for r in interleave(docs(rows), shards=2).collect()}
    assert got[1]["size"] == len(LONG) + 8 and got[1].text_crc32 == zlib.crc32(LONG.encode())


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(7, ITEM), (8, "not in there at all, not one word of it, no, not any")], "item_id LONG, text STRING")
    got = {r.doc_id: r for r in contamination(docs([(1, LONG), (2, "x" * 5_000_000)]), items).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1]["items"]) == (840_032, 12, ["7"])
    assert (got[2].n_words, got[2].n_hit, got[2]["items"]) == (1, 0, [])


def test_simhash(docs):
    one_word = "y" * 5_000_000
    assert fingerprint(one_word) == slow_fingerprint(one_word)
    got = {r.id: r for r in simhash_groups(docs([(1, LONG), (2, LONG + "!"), (3, one_word)])).collect()}
    assert got[1].component_id == got[2].component_id == 1 and got[3].component_id == 3


def test_packing(docs):
    text = "word " * 400_000
    pieces = sorted((r.piece, r.start, r.length) for r in pack(docs([(1, text)]), vocabulary="byte_bpe_50k.json", capacity=2048).collect())
    assert [p[0] for p in pieces] == list(range(len(pieces))) and all(n == 2048 for _, _, n in pieces[1:])
    assert sum(n for _, _, n in pieces) >= 400_000 and pieces[-1][1] + 2048 == sum(n for _, _, n in pieces)
