"""Suffix-array dedup: maximal repeat groups of an enhanced suffix array.

The suffix array is sparse and dealt out by prefix. Of every ``length``-byte
window the ``GRAM``-byte string with the smallest hash is its anchor, so equal
windows have the same anchor at the same place. All windows around one anchor
form a stretch of bytes; the suffixes that start at anchors are dealt out by
their first ``GRAM`` bytes (buckets of the suffix array), and only buckets with
more than one suffix go on.

Equal stretches are counted, not repeated: a copy group of any size is one
stretch with a count. The distinct stretches of a bucket are sorted from their
anchor on; the common prefixes of neighbours are scanned with a stack, which
gives the interval tree of common prefixes with all members of each interval,
not just neighbours. The members of an interval are tested for the diversity of
what stands left of them in the same way (an interval tree over their left
contexts); members that share ``left`` bytes before and ``right`` bytes after
the anchor, and no more, are a maximal repeat group if ``left + right`` reaches
``length``. (Maximal within the stretch: a longer repeat is a chain of groups.)

What a bucket passes on is one row per stretch. All groups of a stretch hold
its anchor, so the bytes that any of them covers are one span: as far left and
as far right as its groups reach. The groups themselves, with all occurrences,
are expanded on demand (:meth:`Repeats.occurrences`).

Hot buckets. A bucket with more than ``BUCKET`` distinct stretches (a passage
that very many documents share, in as many contexts) is more than a task should
hold. Its spans are found by a partial aggregate over the hashes of all windows,
of which the first and the last repeated one bound a stretch's span. Its groups
are found by the same trees, dealt out anew by more of their bytes: a group that
reaches ``right`` bytes from the anchor on, between two of ``LEVELS`` levels,
shares the bytes up to the lower level and as many bytes on the left as the
upper one leaves to ``length``, and these name the part that it is found in.

Everything is judged on the input; every byte in a window that starts anywhere
else too, in the same document or another, is removed. Stretches and windows are
told apart by 64-bit hashes inside a 64-bit anchor bucket; the trees compare
bytes. Intermediate tables are stored in the shared checkpoint folder and
shuffle files dropped behind them.

Defined results: a null text is empty; a text may be of any length (long ones are
hashed in segments); texts shorter than ``length`` lose
nothing; rows that repeat a whole row are documents of their own, so each loses
what the others have; rows with a null id take part; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import forget, freed_shuffles, stored

GRAM = 32         # bytes of an anchor
LEVELS = 4        # levels that groups of a hot bucket are dealt out by
SEGMENT = 1 << 20  # bytes of a text that are hashed at once
BUCKET = 1 << 15  # distinct stretches that one interval tree takes (some 10 MB of bytes)

_MULT = 0x9E3779B97F4A7C15
_UNDO = pow(_MULT, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_TABLES: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _TABLES.get(base)
    if known is None or len(known) < n:
        known = np.full(max(2 * n, 1 << 14), base, np.uint64)
        known[0] = 1
        known = _TABLES[base] = np.cumprod(known)
    return known[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def _sums(b: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes."""
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b + np.uint64(1)) * _powers(_MULT, len(b)), out=out[1:])
    return out


def _hashes(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Place-free hashes of [start, stop)."""
    return _mix((sums[stops] - sums[starts]) * _powers(_UNDO, len(sums))[starts])


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = w - size
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def stretches(raw: bytes, length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, stretch hash, start, size, place of the anchor) of each stretch.

    A long text is worked off in segments that overlap by a window less a byte;
    every window is in one of them, and a stretch may be cut at their bounds."""
    if len(raw) < SEGMENT + length:
        return _segment(raw, length)
    parts = []
    for at in range(0, len(raw) - length + 1, SEGMENT):
        ak, sh, first, size, place = _segment(raw[at:at + SEGMENT + length - 1], length)
        parts.append((ak, sh, first + at, size, place))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _segment(raw: bytes, length: int) -> tuple[np.ndarray, ...]:
    n = len(raw)
    if n < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    sums = _sums(np.frombuffer(raw, np.uint8))
    grams = n - GRAM + 1
    h = _mix((sums[GRAM:] - sums[:grams]) * _powers(_UNDO, grams))
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
    at = (_least(key, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(first[1:], len(at)) - 1
    anchor, stops = at[first], last + length
    place = anchor - first
    whole = _hashes(sums, first, stops) ^ (place.astype(np.uint64) * np.uint64(_MULT))
    return h[anchor], whole, first, stops - first, place


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi - 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def intervals(prefixes: list[int]) -> list[tuple[int, int, int]]:
    """(common prefix, first, last) of every interval, by a stack scan over the
    common prefixes of neighbours (``prefixes[i]``: of members i and i + 1)."""
    out, stack = [], []
    for i, p in enumerate([*prefixes, -1]):
        first = i
        while stack and stack[-1][0] > p:
            value, first = stack.pop()
            out.append((value, first, i))
        if p >= 0 and (not stack or stack[-1][0] < p):
            stack.append((p, first))
    return out


def groups(members: list[tuple[bytes, int, int]], length: int) -> list[tuple[int, int, list[int]]]:
    """(left, right, members) of the maximal repeat groups of one bucket.

    A member is (stretch, place of the anchor, count)."""
    found = []
    after = [s[place:] for s, place, _ in members]
    before = [s[:place][::-1] for s, place, _ in members]
    order = sorted(range(len(members)), key=after.__getitem__)
    spot = {m: i for i, m in enumerate(order)}
    common = [_shared(after[a], after[b]) for a, b in zip(order, order[1:], strict=False)]
    for right, first, last in intervals(common):
        if right + max(map(len, (before[m] for m in order[first:last + 1]))) < length:
            continue
        inside = sorted(order[first:last + 1], key=before.__getitem__)
        ends = np.concatenate(([0], np.cumsum(np.array(common[first:last]) == right)))
        lefts = [_shared(before[a], before[b]) for a, b in zip(inside, inside[1:], strict=False)]
        for left, a, b in intervals(lefts):
            if left + right < length:
                continue
            own = inside[a:b + 1]
            spots = [spot[m] - first for m in own]
            if ends[max(spots)] > ends[min(spots)]:  # else they share more on the right
                found.append((left, right, own))
    whole = {m for left, right, own in found for m in own
             if (left, right) == (members[m][1], len(members[m][0]) - members[m][1])}
    return found + [(place, len(s) - place, [i]) for i, (s, place, count) in enumerate(members) if count > 1 and i not in whole]


def _id_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


class Repeats:
    """Repeat groups of a corpus and where they occur."""

    def __init__(self, docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text"):
        if length <= GRAM:
            raise ValueError(f"length must exceed {GRAM}")
        self.length = length
        self.docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
        with freed_shuffles(docs.sparkSession):
            self._find()

    def _anchors(self) -> DataFrame:
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, cols = [], [[], [], [], [], []]
                for i, text in enumerate(b.column(2).to_pylist()):
                    got = stretches((text or "").encode("utf-8", "surrogatepass"), length)
                    if len(got[0]):
                        rows.append(np.full(len(got[0]), i))
                        for c, g in zip(cols, got, strict=True):
                            c.append(g)
                if rows:
                    at = pa.array(np.concatenate(rows))
                    ak, sh, start, size, place = (np.concatenate(c) for c in cols)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(at), b.column(1).take(at), pa.array(ak.view(np.int64)), pa.array(sh.view(np.int64)),
                         pa.array(start), pa.array((size << 16) | place)], ["id", "th", "ak", "sh", "start", "shape"])
        return self.docs.mapInArrow(run, f"id {_id_type(self.docs, 'id')}, th long, ak long, sh long, start long, shape long")

    def _find(self) -> None:
        anchors = stored(self._anchors(), "anchors")
        shared = anchors.groupBy("ak").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("ak")
        #: every occurrence of a stretch whose bucket has another suffix
        self.places = stored(anchors.join(shared, "ak"), "places")
        forget(anchors)
        spot = F.struct("id", "th", "start")
        kinds = self.places.groupBy("ak", "sh", "shape").agg(F.count(F.lit(1)).alias("n"), F.min(spot).alias("spot"))
        sizes = kinds.groupBy("ak").agg(F.count(F.lit(1)).alias("kinds"))
        kinds = stored(kinds.join(sizes, "ak"), "kinds")
        per_doc = (kinds.filter("kinds > 1").groupBy("spot.id", "spot.th")
                        .agg(F.collect_list(F.struct("ak", "sh", "shape", "n", "kinds", F.col("spot.start").alias("start"))).alias("mine"))
                        .select(F.col("id").alias("m_id"), F.col("th").alias("m_th"), "mine"))
        raw = F.col("text").cast("binary")
        own = self.docs.join(per_doc, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th")))
        size = F.shiftright("shape", 16)
        bodies = (own.select("text", F.inline("mine"))
                     .select("ak", "sh", "n", "kinds", F.col("shape").bitwiseAND(0xFFFF).alias("place"),
                             F.substring(raw, F.col("start").cast("int") + 1, size.cast("int")).alias("body")))
        self.bodies = stored(bodies, "bodies")
        alone = kinds.filter("kinds = 1").select("ak", "sh", F.lit(0).cast("long").alias("lo"), size.cast("long").alias("hi"))
        #: (bucket, stretch, lo, hi): the bytes [lo, hi) of the stretch repeat
        self.spans = stored(alone.unionByName(self._tree_spans()).unionByName(self._window_spans()), "spans")
        self._kinds, self._alone = kinds, kinds.filter("kinds = 1")

    def _solved(self, dealt: DataFrame, solve: Callable[[tuple, list[tuple]], list[tuple]], keys: list[str],
                names: list[str]) -> DataFrame:
        """Rows of longs that ``solve(keys, stretches)`` makes of each bucket, or part of one."""
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, bucket, out = None, {}, []
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if row[:len(keys)] != now:
                        out += solve(now, list(bucket.values()))
                        now, bucket = row[:len(keys)], {}
                        if len(out) > 10_000:
                            yield batch(out)
                            out = []
                    own = row[len(keys):]
                    bucket[own[0]] = own  # a repeated row names a stretch twice
            yield batch(out + solve(now, list(bucket.values())))
        dealt = dealt.select(*keys, "sh", "n", "place", "body").repartition(*keys).sortWithinPartitions(*keys)
        return dealt.mapInArrow(run, ", ".join(f"{n} long" for n in names))

    def _tree_spans(self) -> DataFrame:
        length = self.length

        def solve(key: tuple, rows: list[tuple]) -> list[tuple]:
            reach: dict[int, tuple[int, int]] = {}
            for left, right, own in groups([(body, place, n) for _, n, place, body in rows], length):
                for m in own:
                    far = reach.get(m, (0, 0))
                    reach[m] = (max(far[0], left), max(far[1], right))
            return [(*key, rows[m][0], rows[m][2] - left, rows[m][2] + right) for m, (left, right) in reach.items()]
        return self._solved(self.bodies.filter(F.col("kinds") <= BUCKET), solve, ["ak"], ["ak", "sh", "lo", "hi"])

    def _tree_members(self) -> DataFrame:
        length = self.length

        def solve(key: tuple, rows: list[tuple]) -> list[tuple]:
            found = groups([(body, place, n) for _, n, place, body in rows], length)
            return [(*key, rows[m][0], 0, g, rows[m][2] - left, rows[m][2] + right)
                    for g, (left, right, own) in enumerate(found) for m in own]
        return self._solved(self.bodies.filter(F.col("kinds") <= BUCKET), solve, ["ak"], ["ak", "sh", "part", "grp", "lo", "hi"])

    def _part_members(self) -> DataFrame:
        """The groups of hot buckets, by parts."""
        length = self.length
        levels = [*np.linspace(GRAM, length, LEVELS + 1).astype(int).tolist()[:-1], 1 << 30]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, level, part = [], [], []
                for i, (place, body) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                    for j, (low, high) in enumerate(zip(levels, levels[1:], strict=False)):
                        left = max(length - high + 1, 0)
                        if len(body) - place >= low and place >= left:
                            own = np.frombuffer(body[place - left:place + low], np.uint8)
                            at.append(i), level.append(j)
                            part.append(_hashes(_sums(own), np.array([0]), np.array([len(own)])).view(np.int64)[0])
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in b.columns), pa.array(level, pa.int64()), pa.array(part, pa.int64())],
                                                 ["ak", "sh", "n", "place", "body", "level", "part"])

        def solve(key: tuple, rows: list[tuple]) -> list[tuple]:
            found = groups([(body, place, n) for _, n, place, body in rows], length)
            return [(key[0], rows[m][0], key[2], len(levels) * g + key[1], rows[m][2] - left, rows[m][2] + right)
                    for g, (left, right, own) in enumerate(found) if levels[key[1]] <= right < levels[key[1] + 1] for m in own]
        hot = (self.bodies.filter(F.col("kinds") > BUCKET).dropDuplicates(["ak", "sh"]).select("ak", "sh", "n", "place", "body")
                   .mapInArrow(deal, "ak long, sh long, n long, place long, body binary, level long, part long"))
        return self._solved(hot, solve, ["ak", "level", "part"], ["ak", "sh", "part", "grp", "lo", "hi"])

    def _window_spans(self) -> DataFrame:
        """The spans of hot buckets, from their repeated windows."""
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ak, sh, n, place, body = b.columns
                at, lo, wh = [], [], []
                for i, s in enumerate(body.to_pylist()):
                    starts = np.arange(len(s) - length + 1)
                    at.append(np.full(len(starts), i)), lo.append(starts)
                    wh.append(_hashes(_sums(np.frombuffer(s, np.uint8)), starts, starts + length))
                if at:
                    rows, los = pa.array(np.concatenate(at)), np.concatenate(lo)
                    before = place.take(rows).to_numpy() - los
                    yield pa.RecordBatch.from_arrays(
                        [ak.take(rows), sh.take(rows), n.take(rows), pa.array(before), pa.array(np.concatenate(wh).view(np.int64)),
                         pa.array(los)], ["ak", "sh", "n", "before", "wh", "lo"])
        every = (self.bodies.filter(F.col("kinds") > BUCKET).dropDuplicates(["ak", "sh"]).select("ak", "sh", "n", "place", "body")
                     .mapInArrow(run, "ak long, sh long, n long, before long, wh long, lo long"))
        keys = ["ak", "before", "wh"]
        again = every.groupBy(*keys).agg(F.sum("n").alias("times")).filter("times > 1").select(*keys)
        return every.join(again, keys).groupBy("ak", "sh").agg(F.min("lo").alias("lo"), (F.max("lo") + length).alias("hi"))

    def occurrences(self) -> DataFrame:
        """(bucket, group, id, th, start, stop): all occurrences of all repeat groups, in bytes."""
        size = F.shiftright("shape", 16).cast("long")
        zero = F.lit(0).cast("long")
        alone = self._alone.select("ak", "sh", zero.alias("part"), zero.alias("grp"), zero.alias("lo"), size.alias("hi"))
        members = alone.unionByName(self._tree_members()).unionByName(self._part_members())
        both = self.places.select("id", "th", "ak", "sh", "start").join(members, ["ak", "sh"])
        return both.select(F.col("ak").alias("bucket"), F.struct("part", "grp").alias("group"), "id", "th",
                           (F.col("start") + F.col("lo")).alias("start"), (F.col("start") + F.col("hi")).alias("stop"))

    def close(self) -> None:
        """Delete the stored tables; what was asked for must have been computed by then."""
        forget(self.places, self.bodies, self.spans, self._kinds)

    def removed(self) -> DataFrame:
        """(id, n_bytes, n_removed, n_spans, kept), one row per document; ``kept`` is binary."""
        per_doc = (self.places.select("id", "th", "ak", "sh", "start").join(self.spans, ["ak", "sh"])
                       .select("id", "th", (F.col("start") + F.col("lo")).alias("a"), (F.col("start") + F.col("hi")).alias("b"))
                       .groupBy("id", "th").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
                       .select(F.col("id").alias("f_id"), F.col("th").alias("f_th"), "a", "b"))
        both = self.docs.join(per_doc, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")), "left")
        both = both.select("id", "text", "a", "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for text, a, b in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    out.append((len(raw), *cut(raw, a or [], b or [])))
                n, gone, spans, kept = zip(*out, strict=True) if out else ([], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, pa.int64()) for c in (n, gone, spans)), pa.array(kept, pa.binary())],
                    ["id", "n_bytes", "n_removed", "n_spans", "kept"])
        return both.mapInArrow(run, f"id {_id_type(self.docs, 'id')}, n_bytes long, n_removed long, n_spans long, kept binary")


def cut(raw: bytes, starts: list[int], stops: list[int]) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, what is left)."""
    if not starts:
        return 0, 0, raw
    depth = np.zeros(len(raw) + 1, np.int64)
    np.add.at(depth, np.array(starts), 1)
    np.add.at(depth, np.array(stops), -1)
    gone = np.cumsum(depth[:-1]) > 0
    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
    return int(gone.sum()), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes()
