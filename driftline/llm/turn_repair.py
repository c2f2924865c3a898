"""Conversation structure repair by Wagner-Fischer target alignment.

A well-formed conversation reads ``(s?(ua)+)?`` in role initials: perhaps a
system turn, then user and assistant in turn. For each length there is one such
string. The turns are aligned with the string of each feasible length (keep,
rerole, delete, insert), inside an Ukkonen band: only cells that can still
reach the cost of the incumbent are filled. Lengths are tried from the smallest
lower bound on, so the incumbent is good early and cuts off the rest. Of the
cheapest alignments the backtraced audits (one initial per edit) are compared,
and the ASCII-least stays.

Scale. Turns are ranked by a range-partitioned sort and cut into blocks at
multiples of ``BLOCK`` ranks, so a conversation that holds a third of all turns
is many blocks. Each block is aligned for each state of the grammar it may be
entered in; what a block passes on is one byte a turn, never a text. A
conversation's blocks are then chained by their costs (16 small numbers a
block). A block's audit ends with an edit of one of its own turns, so audits of
one state are never prefixes of each other, and comparing them block by block
compares the whole. Which turns came before with the same role and text is a
partial aggregate. The repaired texts are hashed as a stream: a task holds one
Arrow batch, whatever the conversation's length (a SHA-256 needs its bytes in
order, so one conversation's hash is one stream).

Defined results: a null role or text is one space (so a null text is blank); a
null turn sorts first and is ignored by ``gaps``; rows with a null conversation
id are a conversation of their own; equal turns are ordered by role, then text;
texts of any length; repeated rows are turns of their own (the later ones are
duplicates); a span of turn numbers beyond a long gives null gaps; an empty
table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import forget, freed_shuffles, stored, task_count
from driftline.operators.ordering import number_rows

BLOCK = 256  # turns of a block, at most
BLANK = "[^\\x20\\x09-\\x0D]"

#: states of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLES = {"u": "user", "a": "assistant"}


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def _target(state: int, length: int, system: bool) -> str:
    """The grammar's string of ``length`` initials from ``state`` on."""
    body = ("au" if state == USER else "ua") * (length // 2 + 1)
    return ("s" + body if system else body)[:length]


def _reached(state: int, target: str) -> int:
    for t in target:
        state = NEXT[state, t]
    return state


def align(initials: str, faults: str, target: str, limit: float, costs: Costs, last: bool) -> tuple[float, str]:
    """(cost, audit) of the cheapest alignment of turns with the target, at most ``limit``.

    ``faults``: ``x`` must be deleted, ``t`` is truncated. Inserts behind the
    last turn are for the ``last`` block only."""
    n, m = len(initials), len(target)

    def ahead(k: int) -> int:  # least cost of k more targets than turns
        return k * costs.insert if k > 0 else -k * costs.delete
    shift = m - n
    lo = hi = 0  # diagonals that can still reach the limit
    while ahead(lo - 1) + ahead(shift - lo + 1) <= limit and lo - 1 >= -n:
        lo -= 1
    while ahead(hi + 1) + ahead(shift - hi - 1) <= limit and hi + 1 <= m:
        hi += 1
    if not lo <= shift <= hi or ahead(shift) > limit:
        return math.inf, ""
    inf, width = math.inf, hi - lo + 1

    def matched(r: int, c: int) -> float:
        if faults[r] == "x":
            return inf
        same = initials[r] == target[c]
        if not same and target[c] == "s":
            return inf
        return (0 if same else costs.rerole) + (costs.truncated if faults[r] == "t" else 0)

    below, table = [inf] * width, [[]] * (n + 1)
    for r in range(n, -1, -1):
        row = [inf] * width
        for k in range(min(hi, m - r), max(lo, -r) - 1, -1):
            c, i = r + k, k - lo
            best = 0 if r == n and c == m else inf
            if c < m and target[c] != "s" and (r < n or last) and i + 1 < width:
                best = min(best, row[i + 1] + costs.insert)
            if r < n:
                if i:
                    best = min(best, below[i - 1] + costs.delete)
                if c < m and below[i] < inf:
                    best = min(best, below[i] + matched(r, c))
            row[i] = best
        table[r] = below = row
    if not 0 <= -lo < width or table[0][-lo] > limit:
        return math.inf, ""
    audit, r, c = [], 0, 0
    while r < n or c < m:
        i = c - r - lo
        here = table[r][i]
        if r < n and i and table[r + 1][i - 1] + costs.delete == here:
            edit = "D"
        elif c < m and target[c] != "s" and (r < n or last) and i + 1 < width and table[r][i + 1] + costs.insert == here:
            edit = "I"
        else:
            edit = "K" if initials[r] == target[c] else "R"
        audit.append(edit)
        r, c = r + (edit != "I"), c + (edit != "D")
    return table[0][-lo], "".join(audit)


@functools.lru_cache(maxsize=1 << 15)
def block_table(initials: str, faults: str, first: bool, last: bool, costs: Costs = Costs()) -> tuple[tuple[int, int, int, str], ...]:
    """(entered in, left in, cost, audit): the cheapest edits of a block for each pair of states."""
    n = len(initials)
    gone, cut = faults.count("x"), faults.count("t")
    ceiling = n * costs.delete + 2 * costs.insert  # delete all, insert at most two: reaches any later state

    def bound(length: int) -> int:
        deleted = max(gone, n - length)
        kept = max(0, cut - (deleted - gone)) * min(costs.truncated, costs.delete + costs.insert)
        return deleted * costs.delete + (length - n + deleted) * costs.insert + kept
    out = []
    for state in (START,) if first else (START, SYSTEM, USER, ASSISTANT):
        best: dict[int, tuple[float, str]] = {}
        lengths = range(n + ceiling // costs.insert + 1)
        for length in sorted(lengths, key=bound):
            for system in (False, True) if state == START and length else (False,):
                target = _target(state, length, system)
                left = _reached(state, target)
                if last and left not in ENDS:
                    continue
                limit = min(best.get(left, (math.inf,))[0], ceiling)
                if bound(length) > limit:
                    continue
                found = align(initials, faults, target, limit, costs, last)
                if found[0] <= limit:
                    best[left] = min(best.get(left, found), found)
        out += [(state, left, int(cost), audit) for left, (cost, audit) in sorted(best.items())]
    return tuple(out)


def illegal_pairs(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _initial(role: Column) -> Column:
    one = F.substring(role, 1, 1)
    return F.when(one.isin("s", "u", "a"), one).otherwise(F.lit("o"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


class Repair:
    """The cheapest repair of every conversation of a table of turns."""

    def __init__(self, turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", costs: Costs = Costs()):
        self.costs = costs
        space = F.lit(" ")
        rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                            F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"))
        order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
        with freed_shuffles(turns.sparkSession):
            #: (pos, conv, turn, role, text): every turn with its rank
            self.rows = stored(number_rows(rows, order, "pos"), "turns")
            self._align()

    def _align(self) -> None:
        first = self.rows.groupBy("conv", "role", "text").agg(F.min("pos").alias("f_pos")).select("f_pos")
        blank = ~F.col("text").rlike(BLANK)
        ends = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
        seen = (self.rows.select("pos", "conv", "turn", _initial(F.col("role")).alias("initial"), blank.alias("blank"),
                                 (~blank & ~ends.isin(".", "!", "?")).alias("open_end"))
                         .join(first, F.col("pos") == F.col("f_pos"), "left"))
        fault = (F.when(F.col("blank"), "b").when(F.col("f_pos").isNull(), "d").when(F.col("open_end"), "t").otherwise(" "))
        #: (pos, conv, turn, initial, fault)
        self.marks = stored(seen.select("pos", "conv", "turn", "initial", fault.alias("fault")), "marks")
        block = F.floor(F.col("pos") / F.lit(BLOCK))
        code = F.struct("pos", "initial", F.when(F.col("fault").isin("b", "d"), "x").otherwise(F.col("fault")).alias("fault"))
        blocks = (self.marks.groupBy("conv", block.alias("block")).agg(F.sort_array(F.collect_list(code)).alias("codes"))
                            .select("conv", "block", F.col("codes")[0]["pos"].alias("start"),
                                    F.array_join("codes.initial", "").alias("initials"), F.array_join("codes.fault", "").alias("faults")))
        ranges = self.marks.groupBy(F.col("conv").alias("r_conv")).agg(F.min(block).alias("b0"), F.max(block).alias("b1"))
        blocks = (blocks.join(ranges, _same("conv", "r_conv"))
                        .select("conv", "block", "start", "initials", "faults",
                                (F.col("block") == F.col("b0")).alias("first"), (F.col("block") == F.col("b1")).alias("last")))
        self.blocks = stored(self._tables(blocks), "blocks")
        chosen = self._chain(self.blocks.select("conv", "block", "initials", "last",
                                                F.expr("transform(ways, w -> struct(w.entered, w.left, w.cost, w.rank))").alias("ways")))
        way = F.expr("filter(ways, w -> w.entered = c_entered AND w.left = c_left)[0]")
        both = self.blocks.join(chosen, _same("conv", "c_conv") & (F.col("block") == F.col("c_block")))
        #: (conv, block, start, initials, entered, cost, audit, illegal)
        self.chosen = stored(both.withColumn("way", way).select(
            "conv", "block", "start", "initials", F.col("c_entered").alias("entered"), "way.cost", "way.audit", "illegal"), "chosen")
        forget(self.blocks)

    def _tables(self, blocks: DataFrame) -> DataFrame:
        costs = self.costs
        way = pa.struct([("entered", pa.int32()), ("left", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("audit", pa.string())])

        def ways(initials: str, faults: str, first: bool, last: bool) -> list[dict]:
            table = block_table(initials, faults, first, last, costs)
            rank = {audit: i for i, audit in enumerate(sorted({w[3] for w in table}))}
            return [dict(zip(("entered", "left", "cost", "rank", "audit"), (*w[:3], rank[w[3]], w[3]), strict=True)) for w in table]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [ways(*r) for r in zip(*(b.column(i).to_pylist() for i in (3, 4, 5, 6)), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), b.column(6),
                                                  pa.array(found, pa.list_(way))],
                                                 ["conv", "block", "start", "initials", "last", "ways"])
        conv = blocks.schema["conv"].dataType.simpleString()
        spread = blocks.repartition(task_count(blocks.sparkSession), "conv", "block")
        return spread.mapInArrow(run, f"conv {conv}, block long, start long, initials string, last boolean, "
                                      "ways array<struct<entered int, left int, cost long, rank int, audit string>>")

    def _chain(self, blocks: DataFrame) -> DataFrame:
        """The states each block is entered and left in, for the cheapest chain with the least audit."""
        conv = blocks.schema["conv"].dataType.simpleString()

        def solve(chain: list[tuple]) -> list[tuple]:
            later = [{s: 0 for s in ENDS}]
            for _, _, _, _, ways in reversed(chain):
                now: dict[int, int] = {}
                for w in ways:
                    if w["left"] in later[-1]:
                        total = w["cost"] + later[-1][w["left"]]
                        now[w["entered"]] = min(total, now.get(w["entered"], total))
                later.append(now)
            out, state, before = [], START, ""
            for (c, block, initials, _, ways), rest, total in zip(chain, later[-2::-1], later[:0:-1], strict=True):
                best = min((w for w in ways if w["entered"] == state and w["left"] in rest
                            and w["cost"] + rest[w["left"]] == total[state]), key=lambda w: w["rank"])
                out.append((c, block, state, best["left"], illegal_pairs(before + initials)))
                state, before = best["left"], initials[-1]
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chain, out = [], []
            for b in batches:
                schema = pa.schema([("c_conv", b.schema.field(0).type), ("c_block", pa.int64()), ("c_entered", pa.int32()),
                                    ("c_left", pa.int32()), ("illegal", pa.int64())])
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    chain.append(row)
                    if row[3]:  # the conversation's last block
                        out += solve(chain)
                        chain = []
                if len(out) > 10_000:
                    yield _batch(out, schema)
                    out = []
            if out:
                yield _batch(out, schema)
        return (blocks.select("conv", "block", "initials", "last", "ways").repartition("conv").sortWithinPartitions("conv", "block")
                      .mapInArrow(run, f"c_conv {conv}, c_block long, c_entered int, c_left int, illegal long"))

    def close(self) -> None:
        """Delete the stored tables; what was asked for must have been computed by then."""
        forget(self.rows, self.marks, self.chosen)

    def edits(self) -> DataFrame:
        """(conv, pos, place, edit, new_role): every edit in order; an insert stands before the turn of
        its ``pos`` (behind it at a conversation's end); ``new_role`` is null for Keep and Delete."""
        conv = self.chosen.schema["conv"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows: list[tuple] = []
                schema = pa.schema([("conv", b.schema.field(0).type), ("pos", pa.int64()), ("place", pa.int32()),
                                    ("edit", pa.string()), ("new_role", pa.string())])
                for c, start, initials, state, audit in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    r = 0
                    for place, edit in enumerate(audit):
                        pos, role = start + min(r, len(initials) - 1), None
                        if edit != "D":
                            t = initials[r] if edit == "K" else "a" if state == USER else "u"
                            state, role = NEXT[state, t], ROLES[t] if edit in "RI" else None
                        r += edit != "I"
                        rows.append((c, pos, place, edit, role))
                        if len(rows) >= 10_000:
                            yield _batch(rows, schema)
                            rows = []
                if rows:
                    yield _batch(rows, schema)
        return (self.chosen.select("conv", "start", "initials", "entered", "audit")
                    .mapInArrow(run, f"conv {conv}, pos long, place int, edit string, new_role string"))

    def repaired(self) -> DataFrame:
        """(conv, pos, place, role, text): the turns of the repaired conversations; order by pos, place."""
        edits = self.edits().filter("edit <> 'D'").select(F.col("pos").alias("e_pos"), "place", "edit", "new_role")
        return (self.rows.join(edits, F.col("pos") == F.col("e_pos"))
                    .select("conv", "pos", "place", F.coalesce("new_role", "role").alias("role"),
                            F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text")))

    def _hashes(self) -> DataFrame:
        """(h_conv, sha): SHA-256 of the repaired ``role:text`` lines of each conversation."""
        conv = self.rows.schema["conv"].dataType.simpleString()
        line = F.concat("role", F.lit(":"), "text").cast("binary")
        lines = self.repaired().select("conv", "pos", "place", line.alias("line"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            started, now, digest, out = False, None, None, []
            for b in batches:
                schema = pa.schema([("h_conv", b.schema.field(0).type), ("sha", pa.string())])
                for c, text in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                    if not started or c != now:
                        if started:
                            out.append((now, digest.hexdigest()))
                        started, now, digest = True, c, hashlib.sha256(text)
                    else:
                        digest.update(b"\n")
                        digest.update(text)
                if len(out) > 10_000:
                    yield _batch(out, schema)
                    out = []
            if started:
                yield _batch([*out, (now, digest.hexdigest())], schema)
        return (lines.repartition("conv").sortWithinPartitions("conv", "pos", "place")
                     .mapInArrow(run, f"h_conv {conv}, sha string"))

    def report(self) -> DataFrame:
        """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row a conversation."""
        wide = F.col("turn").cast("decimal(38,0)")
        span = F.max(wide) - F.min(wide) + 1 - F.count_distinct("turn")
        found = self.marks.groupBy("conv").agg(
            F.when(F.count("turn") == 0, F.lit(0).cast("long")).otherwise(span.try_cast("long")).alias("gaps"),
            F.count_if(F.col("fault") == "b").alias("blank"), F.count_if(F.col("fault") == "d").alias("duplicate"),
            F.count_if(F.col("fault") == "t").alias("truncated"))
        audits = (self.chosen.groupBy(F.col("conv").alias("a_conv"))
                      .agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
                           F.sort_array(F.collect_list(F.struct("block", "audit"))).alias("parts"))
                      .select("a_conv", "illegal", "cost", F.array_join("parts.audit", "").alias("audit")))
        nothing = F.lit(hashlib.sha256(b"").hexdigest())
        return (found.join(audits, _same("conv", "a_conv")).join(self._hashes(), _same("conv", "h_conv"), "left")
                     .select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                             F.coalesce("sha", nothing).alias("repaired_sha256")))


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) after faults drawn by crc32 of ``conv_id:turn``: of 20 remainders 0 drops the
    row, 1 empties the text, 2 removes its ``.!?``, 3 repeats it, 4 sets role user; nulls count as one space."""
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col))) % 20
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), spaced(role_col).alias("role"),
                        spaced(text_col).alias("text"), draw.alias("draw")).filter("draw <> 0")
    text = (F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", ""))
             .otherwise(F.col("text")))
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), copies.alias("copy")).drop("copy")
