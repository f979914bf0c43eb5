"""Conversation repair: all edits by search over small cases, a plain program over whole tables, and odd rows."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillon.llm import conversations as C

WORD = re.compile("[^\x20\x09-\x0d]")
GOOD = re.compile(r"(s?(ua)+)?\Z")


def damaged(conv_id, rows):
    """(turn, role, text) of one conversation as they are after damage, in order."""
    out = []
    name = lambda x: " " if x is None else str(x)
    for turn, role, text in rows:
        role, text = name(role), name(text)
        code = zlib.crc32(f"{name(conv_id)}:{name(turn)}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def told(rows):
    """Faults of rows (turn, role, text): b, d, t or none."""
    seen, out = set(), []
    for _, role, text in rows:
        last = WORD.findall(text)[-1:]
        out.append("b" if not last else "d" if (role, text) in seen else "" if last[0] in ".!?" else "t")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Least (cost, audit) and the repaired rows: a best-first search over edits."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, made = heapq.heappop(heap)
        if (i, roles[-1:], len(roles) > 0) in done:
            continue
        if i == len(rows) and GOOD.match(roles):
            return cost, audit, made
        # a later visit of the same place costs more, or has a larger audit
        done.add((i, roles[-1:], len(roles) > 0))
        after = "user" if roles[-1:] in ("", "s", "a") else "assistant"
        heapq.heappush(heap, (cost + 5, audit + "I", i, roles + after[0], (*made, (after, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, made))
            if faults[i] in ("", "t"):
                stays = cost + 5 * (faults[i] == "t")
                heapq.heappush(heap, (stays + 1, audit + "R", i + 1, roles + after[0], (*made, (after, text))))
                if role[:1] == after[0] or (role[:1] == "s" and not roles):
                    heapq.heappush(heap, (stays, audit + "K", i + 1, roles + role[:1], (*made, (role, text))))
    raise AssertionError


def brute(conv_id, rows, hurt=True):
    rows = damaged(conv_id, rows) if hurt else rows
    if not rows:
        return conv_id, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()
    faults, turns = told(rows), {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, made = cheapest(rows, faults)
    return conv_id, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest()


def enumerated(roles, faults, most=3):
    """Least (cost, audit) over all edits with at most `most` insertions, by listing them all."""
    best = None

    def go(i, cost, audit, out, left):
        nonlocal best
        if i == len(roles) and GOOD.match(out):
            best = min(best or (cost, audit), (cost, audit))
        if left:
            for x in "ua":
                go(i, cost + 5, audit + "I", out + x, left - 1)
        if i < len(roles):
            go(i + 1, cost + 2, audit + "D", out, left)
            if faults[i] != 2:
                stays = cost + 5 * faults[i]
                go(i + 1, stays, audit + "K", out + roles[i], left)
                for x in "ua":
                    go(i + 1, stays + 1, audit + "R", out + x, left)

    go(0, 0, "", "", most)
    return best


def test_least_edits_of_all():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randrange(5)
        symbols = [rng.choice([0, 1, 1, 2, 2, 3, 4, 5, 6, 8, 9]) for _ in range(n)]
        runs = C.runs_of(symbols, [1] * n)
        cost, audit = enumerated("".join("suax"[x % 4] for x in symbols), [x // 4 for x in symbols])
        letters, states = C.unroll(runs, C.FINAL)
        got = letters[C.EMPTY] + {C.SYSTEM: "II", C.USER: "I"}.get(states[C.EMPTY], "")
        assert (C._apply(C.transition(runs), C.FINAL)[C.EMPTY], got) == (cost, audit), symbols


def test_powers_are_steps():
    for symbol in range(12):
        one = C.power(symbol, 0)
        many = C.ONE
        for n in range(1, 40):
            many = C._times(many, one)
            assert C.transition(((symbol, n),)) == many


def rows_of(made):
    return [tuple(r[x] for x in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in made.collect()]


def by_conversation(pairs):
    out = {}
    for conv_id, *row in pairs:
        out.setdefault(conv_id, []).append(tuple(row))
    return out


def check(df, pairs):
    want = [brute(k, v) for k, v in by_conversation(pairs).items()]
    assert sorted(rows_of(C.repair(df)), key=str) == sorted(want, key=str)


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    check(table, [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_random_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(8)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "Ünder", "a"]
    texts = ["Yes.", "No!", "cut", "", " \t", None, "Ends. \x0b\n", "é", "ok?", ".!?"]
    pairs = [(rng.choice([1, 2, 3, 4, 5, 6, None]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(120)]
    pairs += [(40 + i, 0, "user", "Hi.") for i in range(40)] + [(99, t, "user", "again") for t in range(30)]
    df = spark.createDataFrame(pairs, "conv_id long, turn int, role string, text string").repartition(4)
    clash = {x: F.lit(1) for x in ("kind", "digest", "lead", "block", "symbol", "copies", "n", "_c", "letters", "costs")}
    check(df.withColumns(clash), pairs)


def test_one_conversation_of_many_rows(spark, monkeypatch):
    """A third of all rows in one conversation, one row of it many times: many blocks, and counts instead of copies."""
    monkeypatch.setattr(C, "BLOCK", 16)
    pairs = [(7, i, ("user", "assistant")[i % 2], f"Turn {i}." if i % 5 else "cut") for i in range(400)] + [(7, 400, "user", "Same.")] * 300
    pairs += [(1000 + i, 0, "user", "long " * 50_000 + ".") for i in range(3)]
    df = spark.createDataFrame(pairs, "conv_id long, turn long, role string, text string").repartition(4)
    check(df, pairs)


def test_nothing_and_damaged_input(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repair(empty).collect() == []
    rows = [(0, "user", "Hi."), (1, "assistant", "Hello."), (5, "assistant", "cut")]
    df = spark.createDataFrame([(1, *r) for r in rows], "conv_id long, turn long, role string, text string")
    assert rows_of(C.repair(df, damaged=True)) == [brute(1, rows, hurt=False)]
    assert rows_of(C.repair(df, damaged=True))[0][7] == "KKD"
