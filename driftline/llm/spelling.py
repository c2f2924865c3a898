"""Spelling variants by blocked Gram matrices of letter counts.

Two words are near if one inserted, deleted or replaced code point turns one
into the other. That changes at most two letter counts by one each, so the
squared distance of their letter-count vectors is at most two, and their
lengths differ by at most one. ``|x - y|^2 = |x|^2 + |y|^2 - 2 x.y``: one matrix
product gives all distances of a block; the pairs at most two apart are then
verified by their edits.

Blocks. A block holds words of one length and the next. One edit leaves the
first or the last half of the shorter word as it was, so the words of a block
also share that half: a word enters at most four blocks (as the shorter and as
the longer partner, by its first and by its last half), and no near pair is
lost. A pair that shares both halves counts in the block of the first half.

Scale. Words are counted by one partial aggregate, so a word that fills a third
of all texts is one row per task. Only blocks with a possible pair go on. A
block is cut into pieces of about ``PIECE`` words (or ``PIECE_BYTES`` bytes) by
a hash of the word, and every pair of pieces is a unit of its own: a task holds
two pieces, however large a block is. A unit returns one row for each of its
words (number of near words, the best of them), not the pairs. Forms are
followed to their roots by pointer doubling; counts grow tenfold at each step,
so a few joins suffice. Every table that a later step reads twice is stored in
the shared checkpoint folder.

Defined results: null and empty texts have no words; a null id counts as empty
text where a rule uses it; texts and words may be of any length (a unit's size
is bounded by bytes too, down to two words); ties go to the smaller word in
code-point order; rows that repeat a whole row are documents of their own; an
empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import forget, freed_shuffles, stored, task_count

PIECE = 2048          # words of a piece, about
PIECE_BYTES = 8 << 20  # bytes of a piece, about
DIMS = 96             # letters a-z, U+00C0 to U+00FF, and six more for all others

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7) -> DataFrame:
    """(id, run): every maximal run of letters of at least ``least`` code points, A-Z in lower case."""
    low = F.translate(F.col(text_col), UPPER, LOWER)
    runs = F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0)))
    return (docs.select(F.col(id_col).cast("string").alias("id"), runs.alias("run"))
                .filter(F.length("run") >= least))


def count_words(words: DataFrame, word: Column, least: int = 7, times: int = 2) -> DataFrame:
    """(word, n) of the words of at least ``least`` code points that occur ``times`` times or more."""
    return (words.select(word.alias("word")).filter(F.length("word") >= least)
                 .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= times))


def letter_counts(words: list[str]) -> np.ndarray:
    """One row of letter counts a word (float64: products stay exact)."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    dim = np.where((codes >= 97) & (codes <= 122), codes - 97,
                   np.where((codes >= 0xC0) & (codes <= 0xFF), codes - 0xC0 + 26, 90 + codes % 6))
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(row * DIMS + dim, minlength=len(words) * DIMS).reshape(-1, DIMS).astype(np.float64)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one insertion, deletion or replacement turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    n = len(a)
    lo, hi = 0, n  # the common prefix, by halving (long words)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return a[lo + (len(b) == n):] == b[lo + 1:]


class Unit:
    """Two pieces of a block (or one with itself) and the near pairs between them."""

    def __init__(self, u: int, v: int, words: list[str], n: np.ndarray, short: np.ndarray, piece: np.ndarray):
        self.words, self.n, self.short = words, n, short
        self.alone = u == v
        self.left, self.right = np.flatnonzero(piece == u), np.flatnonzero(piece == v)

    def pairs(self, by_suffix: bool, half: int) -> Iterator[tuple[int, int]]:
        left, right = self.left, self.right
        x = letter_counts(self.words)
        square = np.einsum("ij,ij->i", x, x)
        near = square[left][:, None] + square[right][None, :] - 2 * (x[left] @ x[right].T) <= 2
        near &= self.short[left][:, None] | self.short[right][None, :]
        for i, j in zip(*np.nonzero(near), strict=True):
            i, j = int(left[i]), int(right[j])
            if self.alone and i >= j:
                continue
            a, b = self.words[i], self.words[j]
            # one that shares both halves counts in the block of the first; the rest guards against equal hashes
            first = a[:half] == b[:half]
            if first == by_suffix or (by_suffix and a[-half:] != b[-half:]):
                continue
            if one_edit(a, b):
                yield i, j

    def solve(self, by_suffix: bool, half: int) -> list[tuple[str, int, int, str]]:
        """(word, near words here, count of the best, the best) of each word with a near one."""
        if not len(self.left) or not len(self.right) or len(self.words) < 2:
            return []
        found: dict[int, list] = {}
        for i, j in self.pairs(by_suffix, half):
            for a, b in ((i, j), (j, i)):
                rank = (-int(self.n[b]), self.words[b])
                had = found.get(a)
                if had is None:
                    found[a] = [1, rank]
                else:
                    had[0] += 1
                    had[1] = min(had[1], rank)
        return [(self.words[i], k, -rank[0], rank[1]) for i, (k, rank) in found.items()]


def _block_rows(words: DataFrame, least: int) -> DataFrame:
    """(key, shorter, by_suffix, short, word, n): the blocks that a word enters; ``shorter`` is a block's smaller length."""
    length = F.length("word")

    def entry(shorter: Column, short: bool, by_suffix: bool) -> Column:
        half = F.floor(shorter / 2).cast("int")
        part = F.col("word").substr(length - half + 1, half) if by_suffix else F.col("word").substr(F.lit(1), half)
        return F.struct(F.xxhash64(shorter, F.lit(by_suffix), part).alias("key"), shorter.alias("shorter"),
                        F.lit(by_suffix).alias("by_suffix"), F.lit(short).alias("short"))
    own = [entry(length, True, s) for s in (False, True)]
    longer = [entry(length - 1, False, s) for s in (False, True)]
    entries = F.when(length > least, F.array(*own, *longer)).otherwise(F.array(*own))
    return words.select("word", "n", F.inline(entries))


def near_words(words: DataFrame, least: int = 7) -> DataFrame:
    """(word, n_near, best_n, best): number of near words and the one of largest count."""
    if least < 2:
        raise ValueError("words need at least two code points")
    rows = _block_rows(words, least)
    size = F.octet_length("word").cast("long")
    blocks = (rows.groupBy("key").agg(F.count_if("short").alias("s"), F.count(F.lit(1)).alias("m"), F.sum(size).alias("bytes"))
                  .filter("s >= 1 AND m >= 2")
                  .select("key", F.greatest(F.ceil(F.col("m") / PIECE), F.ceil(F.col("bytes") / PIECE_BYTES))
                                  .cast("int").alias("pieces")))
    blocks = blocks.withColumn("pieces", F.greatest("pieces", F.lit(1)))
    piece = F.pmod(F.xxhash64("word", F.lit(1)), F.col("pieces")).cast("int")
    dealt = (rows.join(blocks, "key").withColumn("piece", piece)
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
                 .select("key", F.least("piece", "other").alias("u"), F.greatest("piece", "other").alias("v"),
                         "shorter", "by_suffix", "short", "piece", "word", "n"))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                          ["word", "near", "best_n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def solve() -> list[tuple]:
            short, piece, words, n = zip(*held, strict=True)
            return Unit(now[1], now[2], list(words), np.array(n), np.array(short), np.array(piece)).solve(now[4], now[3] // 2)
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for key, u, v, shorter, by_suffix, *row in zip(*cols, strict=True):
                unit = (key, u, v, shorter, by_suffix)
                if unit != now:
                    if now is not None:
                        out += solve()
                    now, held = unit, []
                    if len(out) > 10_000:
                        yield batch(out)
                        out = []
                held.append(row)
        yield batch(out + (solve() if held else []))

    unit = ["key", "u", "v"]
    order = [*unit, "shorter", "by_suffix"]  # two blocks whose keys collide stay apart
    found = (dealt.repartition(task_count(words.sparkSession), *unit).sortWithinPartitions(*order)
                  .mapInArrow(run, "word string, near long, best_n long, best string"))
    best = F.min(F.struct((-F.col("best_n")).alias("neg"), F.col("best").alias("word")))
    return (found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("top"))
                 .select("word", "n_near", (-F.col("top.neg")).alias("best_n"), F.col("top.word").alias("best")))


def spelling_variants(words: DataFrame, least: int = 7, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n).

    A word's form is its near word of largest count, if that is at least
    ``ratio`` times the word's; the root is where the forms lead."""
    spark = words.sparkSession
    with freed_shuffles(spark):
        words = stored(words, "words")
        near = near_words(words, least)
        formed = F.col("best_n") >= F.col("n") * ratio
        known = stored(words.join(near.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
                            .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                    F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")),
                       "known")
        forget(words)
        links = stored(known.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "links")
        while True:  # each round doubles the steps followed
            ahead = links.select(F.col("word").alias("at"), F.col("root").alias("further"))
            step = links.join(ahead, F.col("root") == F.col("at"), "left")
            if not step.filter("further IS NOT NULL").limit(1).count():
                break
            last, links = links, stored(step.select("word", F.coalesce("further", "root").alias("root")), "links")
            forget(last)
    rooted = known.join(links.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
