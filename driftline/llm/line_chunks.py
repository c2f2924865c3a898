"""Line dedup by content-defined line chunks (DataFrame functions only).

A text is a list of lines. Polynomial hashes roll over the hashes of ``WINDOW``
consecutive lines; where such a hash is not divisible by ``SPARSE`` a chunk
starts with the window's first line, as at the start of the text. A chunk ends
before the first start that leaves it ``WINDOW`` lines or more, so every chunk
has several lines and neighbours share a line at most. (Starts too near to the
text's end for a chunk of their own still end the one before.) The boundaries depend on
the lines alone: a passage pasted elsewhere, at any line offset, is cut at the
same places inside it. Each of ``BASES`` is a polynomial with boundaries of its
own; the chunks of all of them are compared, since a short passage inside
another text is only found where some polynomial starts a chunk at its first
line and another start closes it at its end.

Multi-line chunks whose text occurs more than once in the whole corpus are
removed except for the first occurrence in (doc_id, line) order: a line goes if
a removed chunk holds it. (Each removed line stands at an earlier place too,
and by induction one such place stays.) A 64-bit hash finds the candidates, by
one partial aggregate over narrow rows and a join that only moves hashes; the
candidates' bytes are then compared: the least and the greatest text of a hash
must be equal, and where they differ (equal hashes of unequal chunks) chunks are
grouped by their text.

Skew: a chunk held by a third of all documents is pre-aggregated before the
shuffle in both aggregates; the joins back to its occurrences are narrow joins
of stored tables, whose hot partitions AQE splits. No group is ever collected;
a document's candidates and removed chunks are collected per document, bounded
by its lines. Shuffle files are dropped as each table is stored.

Defined results: a null text stays null and has no lines; an empty text is one
empty line; a text of one line has no chunk, so it stays; blank lines are lines
like any other; texts of any length and any number of lines; rows that repeat a
whole row (same id, same text) count as one document and get the same result;
rows with a null id take part, ordered first; an empty table gives no rows;
other columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import forget, freed_shuffles, let, stored

WINDOW = 2                                   # lines that a hash rolls over, and the least of a chunk
SPARSE = 8                                   # one window in SPARSE is no boundary
MODULUS = 2_147_483_647
PACK = 1 << 31                               # a chunk as one long: start * PACK + lines
BASES = (536_870_909, 715_827_883, 954_437_177)  # bases of the polynomials, below 2 ** 30


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_hash(line: Column) -> Column:
    """28 bits of a line's MD5, so that a product with a base stays a long."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def _rolled(hashes: Column, start: Column, base: int) -> Column:
    """Polynomial hash of the window whose first line is ``start`` (1-based)."""
    out = F.get(hashes, start - 1)
    for i in range(1, WINDOW):  # at the text's end with nothing in place of lines
        out = (out * base + F.coalesce(F.get(hashes, start - 1 + i), F.lit(0))) % MODULUS
    return out


def _family(hashes: Column, base: int) -> Column:
    """Chunks of one polynomial."""
    size = F.size(hashes)

    def cut(starts: Column) -> Column:
        def chunk(start: Column, k: Column) -> Column:
            later = [F.get(starts, k + i) for i in range(1, WINDOW + 1)]
            stop = F.coalesce(*[F.when(x >= start + WINDOW, x) for x in later], size + 1)
            return F.when(start <= size - (WINDOW - 1), start.cast("long") * PACK + (stop - start))
        return F.array_compact(F.transform(starts, chunk))
    return let(F.filter(F.sequence(F.lit(1), size), lambda i: (i == 1) | (_rolled(hashes, i, base) % SPARSE != 0)), cut)


def chunks(lines: Column, bases: Sequence[int] = BASES) -> Column:
    """Array of (start, n): 1-based first line and number of lines of the chunks of all polynomials."""
    # packed into longs, of which distinct ones are found by hashing
    packed = let(F.transform(lines, _line_hash),
                 lambda hs: F.array_distinct(F.flatten(F.array(*[_family(hs, b) for b in bases]))))
    return F.transform(packed, lambda c: F.struct(F.floor(c / PACK).cast("int").alias("start"), (c % PACK).cast("int").alias("n")))


def _chunk_text(lines: Column, c: Column) -> Column:
    """The lines of a chunk, one by one: a slice would copy the whole text's lines for each."""
    return F.array_join(F.transform(F.sequence(c["start"], c["start"] + c["n"] - 1), lambda i: F.get(lines, i - 1)), "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bases: Sequence[int] = BASES) -> DataFrame:
    """(row, text, n_lines, n_removed, n_chunks): ``row`` is the input row as a
    struct, ``text`` what is left, ``n_removed`` lines in ``n_chunks`` removed chunks."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))
    body = F.col("row").getField(text_col)  # the text travels once, inside its row
    same_doc = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th"))
    spot = F.struct("id", "th", "start")

    def beside(table: DataFrame, name: str, how: str) -> DataFrame:
        """The documents with their row of ``table``, which grows with them: a merge join at every size."""
        return keyed.join(table.select(F.col("id").alias("r_id"), F.col("th").alias("r_th"), name).hint("merge"), same_doc, how)

    def texts(candidates: DataFrame) -> DataFrame:
        """(id, th, start, n, ch, chunk): the candidates' texts."""
        per_doc = candidates.groupBy("id", "th").agg(F.collect_set(F.struct("start", "n", "ch")).alias("cand"))
        spans = let(_lines(body), lambda ls: F.transform(F.col("cand"), lambda c: F.struct(
            c["start"].alias("start"), c["n"].alias("n"), c["ch"].alias("ch"), _chunk_text(ls, c).alias("chunk"))))
        return beside(per_doc, "cand", "inner").select("id", "th", F.inline(spans))

    with freed_shuffles(docs.sparkSession):
        # 1. narrow rows: the hash of every chunk; those that occur again
        spans = let(_lines(body), lambda ls: F.transform(
            chunks(ls, bases), lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"),
                                                  F.xxhash64(_chunk_text(ls, c)).alias("ch"))))
        rows = stored(keyed.filter(body.isNotNull()).select("id", "th", F.inline(spans)), "chunks")
        again = rows.groupBy("ch").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("ch")
        candidates = stored(rows.join(again, "ch"), "candidates")
        forget(rows)

        # 2. their bytes compared
        heads = stored(texts(candidates).groupBy("ch").agg(
            F.min(spot).alias("first"), F.max(spot).alias("last"), (F.min("chunk") == F.max("chunk")).alias("equal")), "heads")
        repeats = heads.filter("equal").filter(~F.col("first").eqNullSafe(F.col("last"))).select("ch", "first")
        removed = candidates.join(repeats, "ch").filter(~spot.eqNullSafe(F.col("first"))).select("id", "th", "start", "n")
        mixed, found = heads.filter("NOT equal").select("ch"), None
        if not mixed.isEmpty():
            found = stored(texts(candidates.join(mixed, "ch")), "mixed")
            first = found.groupBy("ch", "chunk").agg(F.min(spot).alias("first"))
            removed = removed.unionByName(found.join(first, ["ch", "chunk"]).filter(~spot.eqNullSafe(F.col("first")))
                                               .select("id", "th", "start", "n"))
        per_doc = stored(removed.groupBy("id", "th").agg(F.collect_set(F.struct("start", "n")).alias("gone")), "removed")
        forget(candidates, heads, found)

    # 3. what is left
    def left(ls: Column) -> Column:
        covered = F.flatten(F.transform("gone", lambda c: F.sequence(c["start"], c["start"] + c["n"] - 1)))
        kept = F.array_except(F.sequence(F.lit(1), F.size(ls)), covered)
        return let(kept, lambda at: F.struct(
            F.array_join(F.transform(at, lambda i: F.get(ls, i - 1)), "\n").alias("text"),
            (F.size(ls) - F.size(at)).alias("n_removed")))
    out = beside(per_doc, "gone", "left").withColumn("left", F.when(F.col("gone").isNotNull(), let(_lines(body), left)))
    n_lines = F.when(body.isNull(), 0).otherwise(F.size(_lines(body)))
    return out.select("row", F.coalesce(F.col("left.text"), body).alias("text"), n_lines.cast("long").alias("n_lines"),
                      F.coalesce(F.col("left.n_removed"), F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_chunks"))
