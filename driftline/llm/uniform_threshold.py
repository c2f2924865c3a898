"""Exact top-k inner products by a three-phase uniform threshold.

The components of a vector are split into ``parts`` lists; an item's score is
the sum of its local scores in the lists. For each block of queries:

1. every task gathers the ``k`` best of each local list and scores them in
   full; the k-th best of all of them is a safe lower bound of the query's
   k-th best score;
2. that bound divided by the number of lists is broadcast as the cutoff: an
   item below it in every list cannot reach the bound, so the entries at or
   above it in some list suffice;
3. the scores of those entries are resolved exactly, and the best ``k`` of each
   task meet in a final ranking (ties to the smaller id).

Scale: the rows are scanned where they lie and never shuffled; queries are a
stated set, dealt into blocks of about ``QUERIES_AT_ONCE`` vectors by a hash, so
what is broadcast (a block and its cutoffs) has a fixed size. One block lives at
a time: its rows are stored and its broadcasts dropped before the next. A task
sends at most k entries a query, whatever the number of equal vectors, and the
local lists are merged in a tree of tasks, ``FAN_IN`` to one.

Vectors are scaled to integers, ``floor(scale * x)`` as double, and scores are
exact: products of 32-bit or 64-bit floats where they hold every sum, of 64-bit
integers elsewhere.

Defined results: vectors that are null or hold null or non-finite components,
and rows with a null id, take no part; neither do vectors whose scaled squared
length is 2**62 or more, whose scores need not fit a long (all others' do, by
the Cauchy-Schwarz inequality); vectors of unequal length are compared
over the components that both have (missing ones count as zero); of rows that
repeat an id, none is a candidate of its own query, and each is a candidate
(and a query) of its own elsewhere once per distinct vector; an empty table or
no query gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import forget, freed_shuffles, stored

QUERIES_AT_ONCE = 2048
ROWS_AT_ONCE = 2048
FAN_IN = 16  # tasks whose local lists one task merges
LONGEST = float(1 << 62)  # bound of squared lengths


def integers(vector: Column, scale: float = 64.0) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _square(vector: Column, scale: float) -> Column:
    """Squared length of the scaled vector, as double."""
    part = lambda x: F.floor(x.cast("double") * scale)
    short = F.transform(vector, lambda x: F.when(F.abs(x.cast("double")) * scale < LONGEST, part(x).cast("double")).otherwise(LONGEST))
    return F.aggregate(short, F.lit(0.0), lambda a, x: a + x * x)


def usable(vector: Column, scale: float = 64.0) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = vector.isNotNull() & ~F.coalesce(bad, F.lit(False))
    return whole & (_square(vector, scale) < LONGEST)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, padded with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    col = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, col] = values
    return out


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row (all, if fewer), in any order."""
    if scores.shape[1] <= k:
        return scores
    return -np.partition(-scores, k - 1, axis=1)[:, :k]


class Block:
    """A block of queries and its three phases over batches of rows."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, parts: int, kind: type):
        self.ids, self.k, self.kind = ids, k, kind
        #: scores are added up and compared in this type; none is its own row's
        self.wide, self.none = (np.int64, -(1 << 62) - 1) if kind is np.int64 else (np.float64, -np.inf)
        self.cuts = np.array_split(np.arange(q.shape[1]), parts)
        self.lists = [np.ascontiguousarray(q[:, c], kind) for c in self.cuts]
        self.cutoff: np.ndarray | None = None

    def empty(self) -> np.ndarray:
        return np.full((len(self.ids), self.k), self.none, self.wide)

    def local(self, x: np.ndarray) -> list[np.ndarray]:
        """Scores of every query and row in each list."""
        return [(q @ x[:, c].astype(self.kind).T).astype(self.wide, copy=False) for q, c in zip(self.lists, self.cuts, strict=True)]

    def own(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the pairs that are a query's own row."""
        at = np.flatnonzero(np.isin(ids, self.ids))
        pairs = [(q, r) for r in at.tolist() for q in np.flatnonzero(self.ids == ids[r]).tolist()]
        return tuple(np.array(pairs, np.int64).reshape(-1, 2).T)

    def gather(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Phase 1: full scores of the rows that lead some local list."""
        lists = self.local(x)
        full, own = sum(lists[1:], lists[0]), self.own(ids)
        full[own] = self.none
        n, k = len(ids), self.k
        if n <= k:
            return _top(full, k)
        lead = np.sort(np.concatenate([np.argpartition(-s, k - 1, axis=1)[:, :k] for s in lists], axis=1), axis=1)
        scores = np.take_along_axis(full, lead, axis=1)
        scores[:, 1:][lead[:, 1:] == lead[:, :-1]] = self.none  # led two lists
        return _top(scores, k)

    def resolve(self, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phases 2 and 3: (query, row, score) of the entries that suffice."""
        lists, n = self.local(x), len(self.lists)
        if self.wide is np.int64:  # an integer's share, rounded up; without a cutoff all suffice
            share = np.where(self.cutoff == self.none, np.iinfo(np.int64).min, -(-self.cutoff // n))
        else:
            share = self.cutoff / n
        enough = np.logical_or.reduce([s >= share[:, None] for s in lists])
        enough[self.own(ids)] = False
        q, r = np.nonzero(enough)
        score = sum(s[q, r] for s in lists)
        keep = score >= self.cutoff[q]
        return q[keep], r[keep], score[keep]


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """At most k entries of each query, by score, then id."""
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    keep = rank < k
    return q[keep], ids[keep], score[keep]


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS_AT_ONCE):
            b = whole.slice(at, ROWS_AT_ONCE)
            yield b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1), width)


def _phases(rows: DataFrame, block: Block, width: int) -> DataFrame:
    """The entries that suffice for a block of queries, stored."""
    spark, ids, k = rows.sparkSession, block.ids, block.k
    shared = spark.sparkContext.broadcast(block)

    def told(best: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([best.tobytes()], pa.binary())], ["lists"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        best = known.empty()
        for row_ids, x in _batches(batches, width):
            best = _top(np.concatenate([best, known.gather(row_ids, x)], axis=1), k)
        yield told(best)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        best = known.empty()
        for b in batches:
            for blob in b.column(0).to_pylist():
                best = _top(np.concatenate([best, np.frombuffer(blob, known.wide).reshape(len(ids), k)], axis=1), k)
        yield told(best)

    lists, tasks = rows.mapInArrow(gather, "lists binary"), rows.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        lists = lists.repartition(tasks).mapInArrow(merge, "lists binary")
    lists = lists.repartition(1).mapInArrow(merge, "lists binary")  # at most FAN_IN lists of a block's size
    best = np.frombuffer(lists.first()["lists"], block.wide).reshape(len(ids), k)
    cutoff = spark.sparkContext.broadcast(best.min(axis=1))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        known.cutoff = cutoff.value
        q_at, row, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, known.wide)
        for row_ids, x in _batches(batches, width):
            a, r, s = known.resolve(row_ids, x)
            q_at, row, score = _best(np.append(q_at, a), np.append(row, row_ids[r]), np.append(score, s), k)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q_at]), pa.array(row), pa.array(score.astype(np.int64))],
                                         ["query_id", "vec_id", "score"])
    found = stored(rows.mapInArrow(resolve, "query_id long, vec_id long, score long"), "entries")
    shared.destroy(), cutoff.destroy()
    return found


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, parts: int = 2, scale: float = 64.0,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every query."""
    spark = vectors.sparkSession
    with freed_shuffles(spark):
        rows = stored(vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col), scale))
                             .select(F.col(id_col).cast("long").alias("id"), is_query.alias("asks"),
                                     integers(F.col(vector_col), scale).alias("x")).distinct(), "vectors")
        width, longest, asking = rows.agg(
            F.max(F.size("x")), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v)), F.count_if("asks")).first()
        found = None
        if width and asking:
            # partial sums stay below the product of the lengths
            kind = np.float32 if longest < 1 << 23 else np.float64 if longest < 1 << 52 else np.int64
            blocks = -(-asking // QUERIES_AT_ONCE)
            for turn in range(blocks):
                mine = rows.filter("asks").filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == turn).select("id", "x").collect()
                if not mine:
                    continue
                q = np.zeros((len(mine), width), np.int64)
                for i, r in enumerate(mine):
                    q[i, :len(r["x"])] = r["x"]
                part = _phases(rows.select("id", "x"), Block(np.array([r["id"] for r in mine], np.int64), q, k, parts, kind), width)
                found = part if found is None else found.unionByName(part)
    forget(rows)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
                 .select("query_id", "rank", "vec_id", "score"))
