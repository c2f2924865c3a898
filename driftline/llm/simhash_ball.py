"""SimHash near-dedup by meet-in-the-middle ball hashing.

A text's fingerprint is the bitwise majority over the XXH64 hashes of its word
shingles. Two fingerprints at most ``radius`` bits apart share at least one
variant within ``radius / 2`` flipped bits of each (flip half of the differing
bits on either side). So every distinct fingerprint emits all variants in that
half ball (2,081 of them for radius 4), variants meet by a shuffle, and the
fingerprints that meet at one variant are linked to the smallest of them. Each
link is verified by its bit distance. Any two that meet are within ``radius``
by the triangle inequality, so the star holds the same components as all pairs
would, without emitting all pairs of a group. Before a task passes its links
on, it drops those that connect what is connected already.

What the first slices of the variant space have linked, the later ones know: the
links are folded into roots, a fingerprint travels with its root, and a link is
passed on only between different roots. So a cluster is linked by the tasks of
the first slices, not by every task of every slice.

Scale. Only distinct fingerprints emit (a copy group of any size is one), and a
variant can be met by at most as many fingerprints as a half ball holds, so no
key is hot. Variants are dealt out by a fixed linear hash of their bits. A
fingerprint is shipped once for each bucket that one of its variants falls
into, packed with others into binary blobs; the bucket's task derives the
variants again from the bucket number, since the hash of a variant is the hash
of the fingerprint xor the hash of the flipped bits. The variant space is
worked off in ``PASSES`` slices, and the shuffle files of a slice are dropped
when its links are stored: what lies on disk at once is one slice. The number
of buckets grows with the number of fingerprints, so a bucket stays bounded.

Defined results: texts of any length are hashed whole, in blocks of shingles; null
and empty texts and texts without words have fingerprint
zero and are linked like any other; repeated rows are documents of their own
that share a component; rows with a null id take part, and a component's id is
its smallest non-null id (null if it has none); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import forget, freed_shuffles, stored
from driftline.llm.components import connected_components
from driftline.session import scratch_path

PASSES = 8                 # slices of the variant space, worked off one after the other
FOLDS = (0, 2)             # slices after which links are folded into roots, besides the last one
MIN_BUCKETS = 1024         # buckets of a slice, at least
BUCKET_VARIANTS = 500_000  # variants of a bucket, about, beyond that
EMITTED_AT_ONCE = 8192     # fingerprints of a task that deals variants out, about
LINKS_AT_ONCE = 200_000    # links that a task reduces to a forest at once
BLOCK = 1 << 16            # shingles hashed at once


def fingerprint(text: str | None, k: int = 4, seed: int = 42) -> int:
    """Majority bits over the hashes of all k-word shingles (repeats included)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))
    k = min(k, len(words))
    starts, stops = starts[:len(words) - k + 1], stops[k - 1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        spans = zip(starts[at:at + BLOCK].tolist(), stops[at:at + BLOCK].tolist(), strict=True)
        h = np.array([digest(joined[s:e], seed) for s, e in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """(id, th, fp): fingerprint of every row; ``th`` is a hash of the text."""
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, k) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["id", "th", "fp"])
    return src.mapInArrow(run, f"id {id_type}, th long, fp long")


class Variants:
    """The half ball's flip masks and the linear hash that deals variants out."""

    def __init__(self, radius: int, buckets: int, passes: int = PASSES):
        if radius % 2:
            raise ValueError("radius must be even: two fingerprints that meet are at most twice the half apart")
        bits = [np.uint64(1) << np.uint64(i) for i in range(64)]
        masks = [np.uint64(0)]
        for n in range(1, radius // 2 + 1):
            masks += [np.bitwise_or.reduce(np.array(c)) for c in combinations(bits, n)]
        self.radius, self.passes, self.buckets = radius, passes, buckets
        columns = np.random.default_rng(7).integers(0, 1 << 32, 64, dtype=np.uint64)
        self.table = np.zeros((8, 256), np.uint64)
        for byte in range(8):
            for value in range(256):
                on = [columns[8 * byte + i] for i in range(8) if value >> i & 1]
                self.table[byte, value] = np.bitwise_xor.reduce(np.array(on, np.uint64)) if on else 0
        masks = np.array(masks, np.uint64)
        codes = self.code(masks)
        order = np.argsort(codes, kind="stable")
        self.masks, self.codes = masks[order], codes[order]

    def code(self, x: np.ndarray) -> np.ndarray:
        """Linear over xor: code(x ^ m) == code(x) ^ code(m)."""
        parts = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)
        out = np.zeros(len(x), np.uint64)
        for byte in range(8):
            out ^= self.table[byte, parts[:, byte]]
        return (out & np.uint64(self.passes * self.buckets - 1)).astype(np.int64)

    def deal(self, x: np.ndarray, turn: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, fingerprints with a variant there) for one slice."""
        for bucket, at in self.places(x, turn):
            yield bucket, x[at]

    def places(self, x: np.ndarray, turn: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, places in x of the fingerprints with a variant there) for one slice."""
        cx, low, keys, rows = self.code(x), self.passes - 1, [], []
        kind = np.uint16 if self.buckets <= 1 << 16 else np.int64  # 16 bits sort by radix
        for c in range(self.passes):
            at = np.flatnonzero(cx & low == c ^ turn)
            m = self.codes[self.codes & low == c]
            keys.append(((cx[at, None] ^ m[None, :]) // self.passes).astype(kind).ravel())
            rows.append(np.repeat(at, len(m)))
        bucket, at = np.concatenate(keys), np.concatenate(rows)
        order = np.argsort(bucket, kind="stable")
        bucket, at = bucket[order], at[order]
        # one row's variants in a bucket are neighbours: name the row once
        cut = np.concatenate(([True], bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, bool)
        new = cut.copy()
        new[1:] |= at[1:] != at[:-1]
        bucket, at = bucket[new], at[new]
        starts = np.flatnonzero(cut[new])
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=False):
            yield int(bucket[lo]), at[lo:hi]

    def links(self, x: np.ndarray, bucket: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """Verified stars of the fingerprints that meet at a variant of the bucket."""
        need = self.code(x) ^ (bucket * self.passes + turn)
        lo, hi = np.searchsorted(self.codes, need, "left"), np.searchsorted(self.codes, need, "right")
        n = hi - lo
        who = np.repeat(np.arange(len(x)), n)
        which = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        variant, source = x[who] ^ self.masks[which], x[who]
        order = np.argsort(variant)
        variant, source = variant[order], source[order]
        starts = np.flatnonzero(np.concatenate(([True], variant[1:] != variant[:-1]))) if len(variant) else np.array([], int)
        if len(starts) == len(variant):
            return source[:0], source[:0]
        sizes = np.diff(np.append(starts, len(variant)))
        centre = np.repeat(np.minimum.reduceat(source, starts), sizes)
        near = (centre != source) & (np.bitwise_count(centre ^ source) <= self.radius)
        pair = np.unique(np.stack([centre[near], source[near]]), axis=1)
        return pair[0], pair[1]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all links connect: those that join two trees."""
    parent: dict[int, int] = {}

    def top(v: int) -> int:
        while (up := parent.setdefault(v, v)) != v:
            parent[v] = parent[up]
            v = up
        return v
    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(i)
    return a[keep], b[keep]


def _joined(ball: Variants, x: np.ndarray, root: np.ndarray, bucket: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one bucket between fingerprints of different roots, as links of the roots."""
    a, b = ball.links(x, bucket, turn)
    order = np.argsort(x)
    a, b = (root[order[np.searchsorted(x, v, sorter=order)]] for v in (a, b))
    return a[a != b], b[a != b]


def _folded(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after links between roots."""
    new = connected_components(links)
    if roots is None:
        return new
    moved = new.select(F.col("node").alias("old"), F.col("root").alias("top"))
    known = (roots.join(moved, F.col("root") == F.col("old"), "left")
                  .select("node", F.coalesce("top", "root").alias("root")))
    out = stored(known.unionByName(new), "roots")
    forget(roots, new)
    return out


def near_roots(distinct: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """(node, root) of every fingerprint (column ``fp``) that a chain of distances
    up to ``radius`` connects to a smaller one; ``root`` is the smallest of all."""
    spark = distinct.sparkSession
    buckets = MIN_BUCKETS
    while buckets * BUCKET_VARIANTS < n * 2081 // PASSES:
        buckets *= 2
    ball = Variants(radius, buckets)
    tasks = max(n // EMITTED_AT_ONCE + 1, spark.sparkContext.defaultParallelism)

    def emit(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, root = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
                held = x != root
                buckets, alone, led = [], [], []
                for bucket, at in ball.places(x, turn):
                    own = at[held[at]]
                    buckets.append(bucket)
                    alone.append(x[at[~held[at]]].tobytes())
                    led.append(np.stack([x[own], root[own]]).T.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets, pa.int64()), pa.array(alone, pa.binary()), pa.array(led, pa.binary())],
                    ["bucket", "alone", "led"])
        return run

    def meet(turn: int):
        def linked(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            """A task's links, reduced to a forest."""
            a, b = forest(*(np.concatenate(x) for x in zip(*found, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        def solve(alone: list[bytes], led: list[bytes], bucket: int) -> tuple[np.ndarray, np.ndarray]:
            own, pairs = np.frombuffer(b"".join(alone), np.uint64), np.frombuffer(b"".join(led), np.uint64).reshape(-1, 2)
            return _joined(ball, np.concatenate([own, pairs[:, 0]]), np.concatenate([own, pairs[:, 1]]), bucket, turn)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, alone, led, found, n = None, [], [], [], 0
            for b in batches:
                for bucket, one, two in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if bucket != now and alone:
                        found.append(solve(alone, led, now))
                        n, alone, led = n + len(found[-1][0]), [], []
                        if n > LINKS_AT_ONCE:
                            yield linked(found)
                            found, n = [], 0
                    now = bucket
                    alone.append(one)
                    led.append(two)
            if alone:
                found.append(solve(alone, led, now))
            if found:
                yield linked(found)
        return run

    roots, path = None, scratch_path(spark, "links")
    with freed_shuffles(spark):
        for turn in range(PASSES):
            spread = distinct.select("fp", F.col("fp").alias("root"))
            if roots is not None:
                known = roots.select("node", F.col("root").alias("top"))
                spread = (distinct.join(known, F.col("fp") == F.col("node"), "left")
                                  .select("fp", F.coalesce("top", "fp").alias("root")))
            dealt = spread.repartition(tasks).mapInArrow(emit(turn), "bucket long, alone binary, led binary")
            met = dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket")
            met.mapInArrow(meet(turn), "a long, b long").write.mode("append").parquet(path)
            if turn in FOLDS or turn == PASSES - 1:
                links = spark.read.schema("a long, b long").parquet(path)
                links.scratch = path
                roots = _folded(roots, links)
                forget(links)
                path = scratch_path(spark, "links")
    return roots


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   k: int = 4, radius: int = 4) -> DataFrame:
    """(id, th, fp, root, component_id), one row per input row; ``root`` names the
    component by its smallest fingerprint."""
    rows = stored(fingerprints(docs, id_col, text_col, k), "fingerprints")
    with freed_shuffles(docs.sparkSession):
        distinct = stored(rows.select("fp").distinct(), "distinct")
    roots = near_roots(distinct, distinct.count(), radius)
    forget(distinct)
    rooted = (rows.join(roots, F.col("fp") == F.col("node"), "left")
                  .select("id", "th", "fp", F.coalesce("root", "fp").alias("root")))
    names = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(names, "root").select("id", "th", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             k: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs``, one of each group: the one with the smallest id (a
    null id last; of rows that share it, the one with the smallest text hash)."""
    rows = simhash_groups(docs, id_col, text_col, k, radius)
    # one narrow row per distinct (component, id, text); n marks repeated rows
    narrow = rows.groupBy("root", "id", "th").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(F.col("id").isNull().alias("late"), "id", "th", "n")
    best = narrow.groupBy("root").agg(F.min(rank).alias("best")).select("best.*")
    best = best.select(F.col("id").alias("b_id"), F.col("th").alias("b_th"), "n")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))
    hit = packed.join(best, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("th") == F.col("b_th")))
    once = hit.filter("n = 1").select("row")
    repeated = hit.filter("n > 1").dropDuplicates(["id", "th"]).select("row")
    return once.unionByName(repeated).select("row.*")
