import hashlib
import random
import zlib
from itertools import product

import pytest

from driftline.llm import turn_repair
from driftline.llm.catalog import op12_turn_repair
from driftline.llm.turn_repair import Costs, Repair, block_table, damage

SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING, pos LONG, edit STRING, conv STRING, block INT, ways INT"
WORD = set(map(chr, range(0x9, 0xE))) | {" "}


def cheapest(initials, faults, costs=Costs()):
    """(cost, audit) by relaxation over (turn, state) with whole audits; inserts at any place."""
    step = {"": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}
    best = {("", 0): (0, "")}
    frontier = [("", 0)]
    while frontier:  # all costs are positive but Keep's, so audits settle
        state, r = frontier.pop()
        cost, audit = best[state, r]
        moves = []
        if len(audit) < 2 * len(initials) + 4:
            moves += [(step[state][t], r, costs.insert, "I") for t in step[state] if t != "s"]
        if r < len(initials):
            moves.append((state, r + 1, costs.delete, "D"))
            if faults[r] != "x":
                late = costs.truncated if faults[r] == "t" else 0
                for t in step[state]:
                    if initials[r] == t:
                        moves.append((step[state][t], r + 1, late, "K"))
                    elif t != "s":
                        moves.append((step[state][t], r + 1, costs.rerole + late, "R"))
        for s, q, extra, edit in moves:
            new = (cost + extra, audit + edit)
            if new < best.get((s, q), (10**9, "")):
                best[s, q] = new
                frontier.append((s, q))
    return min(best[k] for k in (("", len(initials)), ("A", len(initials))) if k in best)


def apply(turns, audit):
    out, state, rest = [], "", list(turns)
    for edit in audit:
        role, text = (None, "") if edit == "I" else rest.pop(0)
        if edit == "D":
            continue
        role = role if edit == "K" else "assistant" if state == "u" else "user"
        out.append(f"{role}:{text}")
        state = role[:1]
    return "\n".join(out)


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        draw = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if draw == 1 else "".join(c for c in text if c not in ".!?") if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


def brute(rows, best=cheapest):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, turns in convs.items():
        turns = sorted(turns, key=lambda t: (t[0], t[1] or 0, t[2].encode(), t[3].encode()))
        seen, faults, known = set(), "", [t[1] for t in turns if t[0]]
        n = {"b": 0, "d": 0, "t": 0}
        for _, _, role, text in turns:
            solid = [c for c in text if c not in WORD]
            kind = "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            n[kind] = n.get(kind, 0) + 1
            faults += "x" if kind in ("b", "d") else kind or " "
        initials = "".join(t[2][0] if t[2][:1] in ("s", "u", "a") else "o" for t in turns)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = best(initials, faults)
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        sha = hashlib.sha256(apply([t[2:] for t in turns], audit).encode()).hexdigest()
        out[conv] = (gaps, n["b"], n["d"], n["t"], illegal, cost, audit, sha)
    return out


def chained(initials, faults):
    """The chain of block tables in plain Python; itself held against :func:`cheapest`."""
    found = {w[1]: w[2:] for w in block_table(initials, faults, True, True)}
    return min(found.values())


def wide(rows):
    return [(*r, 7, "x", "y", 7, 7) for r in rows]


def answers(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_block_table_is_exhaustive():
    for n in range(5):
        for initials in product("suao", repeat=n):
            for faults in product(" xt", repeat=n):
                if n == 4 and hash((initials, faults)) % 7:
                    continue
                i, f = "".join(initials), "".join(faults)
                if n:
                    assert chained(i, f) == cheapest(i, f), (i, f)


def test_other_costs():
    rng = random.Random(4)
    for _ in range(400):
        n = rng.randint(1, 7)
        costs = Costs(rng.randint(1, 4), rng.randint(1, 6), rng.randint(1, 3), rng.randint(0, 6))
        i, f = ("".join(rng.choice(x) for _ in range(n)) for x in ("suao", "  xt"))
        got = min(w[2:] for w in block_table(i, f, True, True, costs))
        assert got == cheapest(i, f, costs), (i, f, costs)


def conversations(seed, n, longest=9):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "sage"])
            text = rng.choice(["Hello there.", "Why?", "open end", "", " \t", "é fine!  ", "Yes. ", "No\n", "Über"]) + rng.choice(["", str(turn)])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), rng.choice([role] * 9 + [None]), rng.choice([text] * 9 + [None])))
    return rows


@pytest.mark.parametrize("block", [256, 3, 1])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    rows = conversations(1, 60)
    rows += [(900, i // 2, "user" if i % 3 else "assistant", f"turn {i}." if i % 7 else "open") for i in range(30)]
    df = spark.createDataFrame(wide(rows), SCHEMA).repartition(5)
    found = Repair(df)
    assert answers(found.report()) == brute(rows)
    turns = {}
    for r in sorted(found.repaired().collect(), key=lambda r: (r.pos, r.place)):
        turns.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    want = {c: w[-1] for c, w in brute(rows).items()}
    assert {c: hashlib.sha256("\n".join(turns.get(c, [])).encode()).hexdigest() for c in want} == want


def test_long_conversation_and_long_text(spark):
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["user", "assistant"]), rng.choice(["fine %d." % i, "open %d" % i, " ", "same."])) for i in range(900)]
    rows += [(2, 0, "user", "x" * 5_000_000 + "?"), (2, 1, "assistant", "ok.")]
    got = answers(Repair(spark.createDataFrame(wide(rows), SCHEMA)).report())
    assert got == brute(rows, best=chained)
    assert got[2][:-1] == (0, 0, 0, 0, 0, 0, "KK")


def test_damage(spark):
    rows = conversations(3, 200)
    got = damage(spark.createDataFrame(wide(rows), SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(harmed(rows), key=repr)


def test_query_keeps_conversations_that_lost_all_turns(spark, tmp_path):
    rows = conversations(6, 300, 3)
    spark.createDataFrame(wide(rows), SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: nothing for c, *_ in rows} | brute(harmed(rows))
    out = op12_turn_repair(spark, str(tmp_path))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert answers(out) == want
    assert nothing in want.values()


def test_edge_cases(spark):
    assert Repair(spark.createDataFrame([], SCHEMA)).report().collect() == []
    far = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b."), (2, None, None, None)]
    got = answers(Repair(spark.createDataFrame(wide(far), SCHEMA)).report())
    assert got[1][0] is None and got[1][6] == "KK"
    assert got[2] == (0, 1, 0, 0, 0, 2, "D", hashlib.sha256(b"").hexdigest())
