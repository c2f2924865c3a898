"""Best-fit packing of token sequences by minimum bin slack.

Every text becomes token ids plus an end id; only longer ones are cut, into
full pieces behind a first piece that may be shorter. A piece's place depends
on its length alone, so the plan is made for the histogram of lengths (at most
``capacity`` numbers, whatever the size of the corpus): for each bin the
longest remaining length is taken, a bitset subset-sum over the available
lengths finds the fullest combination that fits beside it, and the combination
is removed as often as the remaining counts allow. Each step uses up at least
one length, so a plan has at most ``capacity`` patterns. The pieces then take
the plan's places by their rank within their length.

Scale: tokenizing is a map over the rows. The ranks come from one
range-partitioned sort of narrow rows (`number_rows`), so a length that a third
of all pieces has is spread over the tasks. The driver sees the histogram
only; the plan is broadcast, with a bound proven by its construction
(capacity patterns of at most ``sqrt(2 * capacity)`` different lengths each).

Token ids equal those of ``tokenizers`` on the same vocabulary. Words are
encoded once per batch of rows through the rank file of that vocabulary, and
kept in a bounded cache; a text with white space beside a blank is encoded
whole, one that spells a special token goes to ``tokenizers`` itself.

Defined results: a null text counts as empty (its one piece is the end id);
texts of any length are encoded whole and cut into pieces;
repeated rows are documents of their own; rows with a null id take part; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.ordering import number_rows
from driftline.plans.materialize import broadcast_bounded
from driftline.llm.common import stored

CACHED_WORDS = 400_000
_ENCODERS: dict = {}  # one encoder per worker process and vocabulary


class Encoder:
    """Ids of a byte-level BPE vocabulary (``.json``, with its rank file beside it)."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
        self.slow = Tokenizer.from_file(path)
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.opens_word = np.zeros(max(ranks.values()) + 1, bool)
        self.opens_word[[i for t, i in ranks.items() if t.startswith(b" ")]] = True
        self.uneven = re.compile(r" (?:\s|\Z)|\s ")
        self.words: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Encode new words in one call: a token that starts with a blank opens the next word."""
        if len(self.words) + len(words) > CACHED_WORDS:
            self.words.clear()
        new = list(words)
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(new)), "<u4")
        cuts = 4 * np.append(np.flatnonzero(self.opens_word[ids]), len(ids))
        raw = ids.tobytes()
        self.words.update((w, raw[a:b]) for w, (a, b) in zip(new, pairwise(cuts.tolist()), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        texts = [t or "" for t in texts]
        odd = [bool(self.uneven.search(t)) or any(s in t for s in self.special) for t in texts]
        parts = [None if o else t.split(" ") for t, o in zip(texts, odd, strict=True)]
        new = {w for p in parts if p for w in p[1:]}
        kept = len(new)
        new -= self.words.keys()
        if len(self.words) + len(new) > CACHED_WORDS and kept > len(new):
            self.words.clear()
            new = {w for p in parts if p for w in p[1:]}
        if new:
            self._learn(new)
        get = self.words.__getitem__
        return [self._whole(t) if p is None else self._whole(p[0]) + b"".join(map(get, p[1:]))
                for t, p in zip(texts, parts, strict=True)]


def _encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0,
           id_col: str = "doc_id", text_col: str = "text", rows_at_once: int = 500) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), one row per piece."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                b = whole.slice(at, rows_at_once)
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encoder.encode(b.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    first = (n - 1) % capacity + 1
                    for j, s in enumerate([0, *range(first, n, capacity)]):
                        e = first if j == 0 else s + capacity
                        row.append(i), piece.append(j), start.append(s), length.append(e - s)
                        crc.append(zlib.crc32(ids[4 * s:4 * e]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])
    return src.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def _fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of a combination of available lengths that fills most of ``room``."""
    fits = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, batch = min(counts[length], room // length), 1
        while left:  # multiplicity as powers of two
            take = min(batch, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & fits
            left, batch = left - take, batch * 2
        if reach >> room & 1:
            break
    goal, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> goal & 1:
            goal -= length * take
            used[length] = used.get(length, 0) + take
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = 2048) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, times)]) patterns that use up the histogram."""
    counts, out = {n: c for n, c in histogram.items() if c > 0}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        rest = _fullest({n: c for n, c in counts.items() if c}, capacity - longest)
        counts[longest] += 1
        pattern = dict(rest)
        pattern[longest] = pattern.get(longest, 0) + 1
        repeats = min(counts[n] // t for n, t in pattern.items())
        for n, t in pattern.items():
            counts[n] -= repeats * t
            if not counts[n]:
                del counts[n]
        out.append((repeats, sorted(pattern.items(), reverse=True)))
    return out


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = 2048, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    taken, sequences, places = {}, 0, []
    for repeats, pattern in plan(histogram, capacity):
        offset = 0
        for length, times in pattern:
            lo = taken.get(length, 0)
            taken[length] = lo + repeats * times
            places.append((length, lo, taken[length], times, sequences, offset))
            offset += length * times
        sequences += repeats
    table = spark.createDataFrame(places, "p_length long, lo long, hi long, times long, first_sequence long, first_offset long")
    firsts, n = [], 0
    for length in sorted(histogram):
        firsts.append((length, n))
        n += histogram[length]
    ranked = number_rows(cut, [F.col(c) for c in ("length", "doc_id", "piece", "ids_crc32")], "n")
    bases = spark.createDataFrame(firsts, "b_length long, base long")
    ranked = (ranked.join(broadcast_bounded(bases, capacity), F.col("length") == F.col("b_length"))
                    .withColumn("rank", F.col("n") - F.col("base") - 1))
    placed = ranked.join(broadcast_bounded(table, capacity * int((2 * capacity) ** 0.5 + 1)),
                         (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    at = F.col("rank") - F.col("lo")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32",
                         (F.col("first_sequence") + F.expr("(rank - lo) div times")).alias("sequence_id"),
                         (F.col("first_offset") + (at % F.col("times")) * F.col("length")).alias("offset"))
