"""Benchmark decontamination by winnowing.

Words are hashed, every run of ``k`` words gets a hash, and of each ``w``
consecutive runs the smallest one is kept as a fingerprint (k + w - 1 = the
window of ``span`` words). Two equal windows keep the same run at the same
place, so every shared span of ``span`` words or more shares a fingerprint.
The benchmark's fingerprints are joined with each document's; a hit is extended
over all windows whose kept run it can be, and a window counts only if its
words equal a benchmark window's, byte by byte. Items shorter than ``span``
words are one window each and are found by the hash of as many words.

Scale: the documents are scanned once for each block of benchmark items and
never shuffled as text. A block's index is built on the driver and has a
bound: items are added to a block until it holds ``BLOCK_BYTES`` of text (the
benchmark is a stated query set against all rows, in blocks; a benchmark of a
few MB is one block). Hits of several blocks meet in one aggregate by document.

Defined results: null texts have no words; texts of any length are read whole (their
arrays take some 50 bytes a byte of one text at a time); repeated rows are documents of their
own with equal results; an item with a null id hits but has the id ''; items
without words, null items and an empty benchmark hit nothing; equal items all
count; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 32 << 20  # benchmark text of one block's index

_WORD = np.zeros(256, bool)  # digits, letters and every byte beyond ASCII
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of one text: bytes, places and 64-bit hashes."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8", "surrogatepass").lower()
        b = np.frombuffer(self.raw, np.uint8)
        inside = _WORD[b]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False)) if len(b) else np.zeros(0, np.int64)
        self.starts, self.stops = edge[::2], edge[1::2]
        self.n = len(self.starts)
        if not self.n:
            self.hashes = np.zeros(0, np.uint64)
            return
        # polynomial in an odd multiplier, place-free after division by its power
        place = np.arange(len(b)) - np.repeat(np.append(0, self.starts), np.diff(np.concatenate(([0], self.starts, [len(b)]))))
        sums = np.append(np.uint64(0), np.cumsum(_powers(int(place.max()) + 1)[place] * (b + np.uint64(1))))
        self.hashes = _mix(sums[self.stops] - sums[self.starts] + (self.stops - self.starts).astype(np.uint64))

    def runs(self, n: int) -> np.ndarray:
        """Hash of every run of n words."""
        if self.n < n:
            return np.zeros(0, np.uint64)
        out = np.zeros(self.n - n + 1, np.uint64)
        for j in range(n):
            out = out * _MULT + self.hashes[j:self.n - n + 1 + j]
        return _mix(out)

    def window(self, at: int, n: int) -> bytes:
        return b" ".join([self.raw[s:e] for s, e in zip(self.starts[at:at + n].tolist(), self.stops[at:at + n].tolist(), strict=True)])


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * n, _MULT, np.uint64))))
    return _POWERS


def winnow(runs: np.ndarray, w: int) -> np.ndarray:
    """Places kept: the smallest (first of equals) of each w consecutive runs."""
    if len(runs) < w:
        return np.zeros(0, np.int64)
    base = np.arange(len(runs) - w + 1)
    best = base
    for j in range(1, w):
        other = base + j
        best = np.where(runs[other] < runs[best], other, best)
    return np.unique(best)


class Index:
    """Fingerprints and windows of one block of benchmark items."""

    def __init__(self, items: list[tuple], span: int, k: int):
        self.span, self.k, self.w = span, k, span - k + 1
        prints, self.windows = [], {}  # windows: words of a window -> ids of its items
        lengths: dict[int, list[int]] = {}
        for item_id, text in items:
            words = Words(text)
            n = min(span, words.n)
            if not n:
                continue
            if n == span:
                prints.append(words.runs(k)[winnow(words.runs(k), self.w)])
            runs = words.runs(n)
            lengths.setdefault(n, []).extend(runs.tolist())
            for at in range(len(runs)):
                self.windows.setdefault(words.window(at, n), set()).add("" if item_id is None else str(item_id))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.lengths = {n: np.unique(np.array(h, np.uint64)) for n, h in lengths.items()}

    @staticmethod
    def _among(sought: np.ndarray, known: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(sought), bool)
        at = np.searchsorted(known, sought)
        at[at == len(known)] = 0
        return known[at] == sought

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[str]]:
        """(words, places of hit words, ids of items with an occurring window)."""
        words, ids = Words(text), set()
        hit = np.zeros(words.n, bool)
        for n, known in self.lengths.items():
            if words.n < n:
                continue
            if n == self.span:
                runs = words.runs(self.k)
                kept = winnow(runs, self.w)
                kept = kept[self._among(runs[kept], self.prints)]
                if not len(kept):
                    continue
                at = np.unique((kept[:, None] - np.arange(self.w)[None, :]).ravel())
                at = at[(at >= 0) & (at <= words.n - n)]
                at = at[self._among(words.runs(n)[at], known)]
            else:
                at = np.flatnonzero(self._among(words.runs(n), known))
            for i in at.tolist():
                found = self.windows.get(words.window(i, n))
                if found:
                    hit[i:i + n] = True
                    ids |= found
        return words.n, np.flatnonzero(hit), ids


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Lists of (id, text) of bounded size, streamed from the item table."""
    block, size = [], 0
    for r in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        block.append((r["i"], r["t"]))
        size += len(r["t"] or "")
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _sha(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _scan(docs: DataFrame, index: Index, id_col: str, text_col: str, with_places: bool) -> DataFrame:
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            found = [known.scan(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([f[0] for f in found], pa.int64()),
                 pa.array([len(f[1]) for f in found], pa.int64()),
                 pa.array([f[1].tolist() if with_places else [] for f in found], pa.list_(pa.int64())),
                 pa.array([sorted(f[2]) for f in found], pa.list_(pa.string()))],
                ["doc_id", "th", "n_words", "n_hit", "places", "items"])
    return src.mapInArrow(run, f"doc_id {id_type}, th long, n_words long, n_hit long, places array<long>, items array<string>")


def contamination(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 5, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, th, n_words, n_hit, items), one row per input row; ``th`` is a hash of the text."""
    blocks = _blocks(items, item_id, item_text)
    first, second = next(blocks, []), next(blocks, None)
    out = _scan(docs, Index(first, span, k), id_col, text_col, second is not None)
    if second is None:
        return out.drop("places")
    while second is not None:
        out = out.unionByName(_scan(docs, Index(second, span, k), id_col, text_col, True))
        second = next(blocks, None)
    # equal rows of one table give equal results: copies counts them
    many = out.withColumn("hits", F.size("items") > 0)
    merged = many.groupBy("doc_id", "th").agg(
        F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    copies = docs.groupBy(F.col(id_col).alias("c_id"), F.xxhash64(text_col).alias("c_th")).agg(F.count(F.lit(1)).cast("int").alias("c"))
    merged = merged.join(copies, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("th") == F.col("c_th")))
    return merged.select("doc_id", "th", "n_words", F.size("places").cast("long").alias("n_hit"), "items",
                         F.explode(F.array_repeat(F.lit(0), F.col("c")))).drop("col")


def drop_contaminated(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 5, id_col: str = "doc_id",
                      text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs."""
    found = contamination(docs, items, span, k, id_col, text_col, item_id, item_text)
    bad = found.filter("n_hit > 0").select(F.col("doc_id").alias("b_id"), F.col("th").alias("b_th")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))
    clean = packed.join(bad, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("th") == F.col("b_th")), "left_anti")
    return clean.select("row.*")
