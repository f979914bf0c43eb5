"""Repair of damaged conversations: cheapest edits to a legal order of roles, by a min-plus program over runs of equal faults."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import common

#: Rows of one block of a conversation, at most; blocks are worked on apart.
BLOCK = 4096
#: Costs: another role, deletion, an inserted row, a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACES = " \t\n\x0b\x0c\r"
FAR = 1 << 50

# A state is what the repaired rows end with: nothing, a system row, a user's, an assistant's.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The role that may be inserted or given after each state, as the state that it leads to.
AFTER = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
# A symbol is 4 * fault + role: fault 0 none, 1 truncated, 2 must go; role 0 s, 1 u, 2 a, 3 any other initial.
LEGAL = {(0, 1), (1, 2), (2, 1)}

Vector = tuple[int, ...]
Runs = tuple[tuple[int, int], ...]


def _keep(state: int, role: int) -> int | None:
    """The state after a row that stays as it is; null: it may not."""
    if role == 0:
        return SYSTEM if state == EMPTY else None
    return role + 1 if role in (1, 2) and AFTER[state] == role + 1 else None


def _times(a: tuple[Vector, ...], b: tuple[Vector, ...]) -> tuple[Vector, ...]:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def _apply(a: tuple[Vector, ...], v: Vector) -> Vector:
    return tuple(min(x + y for x, y in zip(row, v, strict=True)) for row in a)


ONE = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))
_INSERTED = tuple(tuple(0 if i == j else INSERT if AFTER[i] == j else FAR for j in range(4)) for i in range(4))
#: Any number of insertions: two suffice to reach every state that can be reached.
INSERTED = _times(_INSERTED, _INSERTED)
#: Cost to a legal end from each state when no rows are left.
FINAL = _apply(INSERTED, (0, FAR, FAR, 0))


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> tuple[Vector, ...]:
    """The transition of 2^k rows of one symbol, each after any number of insertions."""
    if k:
        return _times(power(symbol, k - 1), power(symbol, k - 1))
    fault, role = divmod(symbol, 4)
    step = [[FAR] * 4 for _ in range(4)]
    for s in range(4):
        step[s][s] = DELETE
        if fault < 2:
            stays = TRUNCATED * fault
            step[s][AFTER[s]] = min(step[s][AFTER[s]], REROLE + stays)
            if (t := _keep(s, role)) is not None:
                step[s][t] = min(step[s][t], stays)
    return _times(INSERTED, tuple(map(tuple, step)))


def runs_of(symbols: list[int], counts: list[int]) -> Runs:
    """Equal neighbours collapsed; a row's repeats are duplicates, which must go."""
    found: list[list[int]] = []
    for symbol, n in zip(symbols, counts, strict=True):
        for one, many in ((symbol, 1), (8 + symbol % 4, n - 1)):
            if not many:
                continue
            if found and found[-1][0] == one:
                found[-1][1] += many
            else:
                found.append([one, many])
    return tuple((a, b) for a, b in found)


@lru_cache(maxsize=50_000)
def transition(runs: Runs) -> tuple[Vector, ...]:
    """The transition of all runs, each advanced through powers of two."""
    out = ONE
    for symbol, n in runs:
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = _times(out, power(symbol, k))
    return out


@lru_cache(maxsize=50_000)
def unroll(runs: Runs, after: Vector) -> tuple[tuple[str, ...], Vector]:
    """From each state, the ASCII-least cheapest edits of the runs, given the costs after them, and the state they lead to.

    Costs at the ends of runs come from powers; inside a run they are taken row by row.
    """
    ends = [after]
    for symbol, n in reversed(runs):
        v = ends[-1]
        for k in range(n.bit_length()):
            if n >> k & 1:
                v = _apply(power(symbol, k), v)
        ends.append(v)
    letters, states = [[], [], [], []], list(range(4))
    for (symbol, n), end in zip(runs, reversed(ends[:-1]), strict=True):
        costs = [end]
        for _ in range(n):
            costs.append(_apply(power(symbol, 0), costs[-1]))
        fault, role = divmod(symbol, 4)
        stays = TRUNCATED * fault
        for place in range(n, 0, -1):
            here, later = costs[place], costs[place - 1]
            for start in range(4):
                s, own = states[start], letters[start]
                while True:  # letters in ASCII order: D, I, K, R
                    if DELETE + later[s] == here[s]:
                        own.append("D")
                        break
                    if INSERT + here[AFTER[s]] == here[s]:
                        own.append("I")
                        s = AFTER[s]
                        continue
                    kept = _keep(s, role) if fault < 2 else None
                    if kept is not None and stays + later[kept] == here[s]:
                        own.append("K")
                        s = kept
                    else:
                        own.append("R")
                        s = AFTER[s]
                    break
                states[start] = s
    return tuple("".join(x) for x in letters), tuple(states)


# the tables


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as they are after damage, with `copies` of each; nulls of role and text are one space."""
    name = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    found = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), name("role").alias("role"), name("text").alias("text"))
    code = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    return found.select("conv_id", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.cast("long").alias("copies")).where("copies > 0")


#: Rows of one conversation are in this order; beyond 64 characters that of the digest stands for that of the text.
ORDER = ["conv_id", "turn", "lead_role", "lead", "digest"]


def _keyed(rows: DataFrame) -> DataFrame:
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumns({"lead_role": F.substring("role", 1, 64), "lead": F.substring("text", 1, 64), "digest": F.unhex(F.sha2(whole, 256))})


def _symbol() -> Column:
    end = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    fault = F.when(end == "", 2).when(end.isin(".", "!", "?"), 0).otherwise(1)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return (4 * fault + role).cast("int")


def blocks(rows: DataFrame) -> DataFrame:
    """Blocks of at most BLOCK distinct rows of one conversation, in order, without texts.

    Equal rows become one with a count before they travel. A row repeats an earlier one if a row of its conversation has
    its digest at an earlier turn. Places come from prefix sums over ranges, so a long conversation is many blocks.
    """
    narrow = _keyed(rows).select(*ORDER, _symbol().alias("symbol"), "copies")
    alike = narrow.groupBy(*ORDER, "symbol").agg(F.sum("copies").alias("n"))
    alike = common.materialize(alike, "messages")
    turn = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    first = alike.groupBy(F.col("conv_id").alias("_c"), F.col("digest").alias("_d")).agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1").drop("turns")
    met = alike.join(first.hint("merge"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("digest") == F.col("_d")), "left")
    again = F.coalesce(F.col("first") < turn, F.lit(False))
    # symbols of rows that are blank keep what they are; `again` is counted apart from blank
    told = met.select(*ORDER, F.when(again & (F.col("symbol") < 8), F.col("symbol") % 4 + 8).otherwise(F.col("symbol")).alias("symbol"), (F.col("symbol") >= 8).alias("blank"), "n")
    placed = common.with_prefix(told, [F.col(x) for x in ORDER], F.lit(1).cast("long"), "message-order")
    entry = F.struct("_index", *ORDER[1:], "symbol", "blank", "n")
    grouped = placed.groupBy("conv_id", F.expr(f"_index div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    heads = [F.col("e")[0][x].alias(x) for x in ORDER[1:]]
    return grouped.select("conv_id", "block", *heads, *[F.col(f"e.{x}").alias(f"{x}s") for x in ("turn", "symbol", "blank", "n")])


_FACTS = ["n_blank", "n_duplicate", "n_truncated", "n_illegal", "role_first", "role_last", "turn_first", "turn_last", "n_turns"]


def _facts(turns: list, symbols: list[int], blank: list[bool], counts: list[int]) -> tuple:
    """What a block tells of its own rows, in the order of _FACTS."""
    roles = [x % 4 for x in symbols]
    n_blank = sum(n for b, n in zip(blank, counts, strict=True) if b)
    n_truncated = sum(x // 4 == 1 for x in symbols)
    n_duplicate = sum(n - (x < 8) for x, b, n in zip(symbols, blank, counts, strict=True) if not b)
    # a role after itself is never legal
    n_illegal = sum(counts) - len(counts) + sum((a, b) not in LEGAL for a, b in zip(roles, roles[1:], strict=False))
    known = [t for t in turns if t is not None]
    return n_blank, n_duplicate, n_truncated, n_illegal, roles[0], roles[-1], known[0] if known else None, known[-1] if known else None, len(set(known))


def _with_costs(found: DataFrame) -> DataFrame:
    """Add to each block the costs before (`costs`) and after it (`after`), from the last block of a conversation to the first."""
    n = common.partitions(found.sparkSession)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [transition(runs_of(s, c)) for s, c in zip(batch.column("symbols").to_pylist(), batch.column("ns").to_pylist(), strict=True)]
            yield batch.append_column("matrix", pa.array([[x for row in m for x in row] for m in told], pa.list_(pa.int64())))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, v = (), FINAL
        for batch in batches:
            after, costs = [], []
            for conv, m in zip(batch.column("conv_id").to_pylist(), batch.column("matrix").to_pylist(), strict=True):
                if (conv,) != held:
                    held, v = (conv,), FINAL
                after.append(v)
                v = _apply((m[:4], m[4:8], m[8:12], m[12:]), v)
                costs.append(v)
            more = [pa.array(x, pa.list_(pa.int64())) for x in (after, costs)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), *more], names=["conv_id", "block", "after", "costs"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    matrices = common.materialize(found.mapInArrow(summed, f"{shape}, matrix array<long>"), "matrices")
    # one row per BLOCK rows of a conversation, and only a vector is held
    ordered = matrices.select("conv_id", "block", "matrix").repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("block").desc())
    scan = ordered.mapInArrow(scanned, "conv_id long, block long, after array<long>, costs array<long>")
    scan = scan.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "after", "costs")
    return matrices.drop("matrix").join(scan.hint("merge"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b")


_CHOSEN = f"{', '.join(f'{x} long' for x in _FACTS)}, letters array<string>, states array<long>"
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _chosen(found: DataFrame) -> DataFrame:
    """Each block with its facts and, for each state that it may begin in, its edits and the state after them."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts, letters, states = [], [], []
            for turns, symbols, blank, counts, after in zip(*(batch.column(x).to_pylist() for x in ("turns", "symbols", "blanks", "ns", "after")), strict=True):
                facts.append(_facts(turns, symbols, blank, counts))
                own, ends = unroll(runs_of(symbols, counts), tuple(after))
                letters.append(own)
                states.append(ends)
            kept = [batch.column(x) for x in (*ORDER, "ns", "costs")]
            told = [pa.array(x, pa.int64()) for x in zip(*facts, strict=True)] if facts else [pa.array([], pa.int64())] * len(_FACTS)
            names = [*ORDER, "ns", "costs", *_FACTS, "letters", "states"]
            yield pa.RecordBatch.from_arrays([*kept, *told, pa.array(letters, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int64()))], names=names)

    return found.mapInArrow(choose, f"conv_id long, turn long, lead_role string, lead string, digest binary, ns array<long>, costs array<long>, {_CHOSEN}")


class _Conversation:
    """One conversation as its blocks and texts go by in order: sums, edits, and the hash of what is repaired."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.sums, self.cost, self.audit = conv_id, [0, 0, 0, 0], 0, []
        self.state, self.begins, self.hash, self.items = EMPTY, EMPTY, hashlib.sha256(), 0
        self.role = self.turn_first = self.turn_last = self.seen = None
        self.turns, self.letters, self.place, self.counts = 0, "", 0, iter(())

    def block(self, facts: tuple, counts: list[int], costs: list[int], letters: list[str], states: list[int]) -> None:
        *sums, first, last, turn_first, turn_last, n_turns = facts
        if self.role is None:
            self.cost = costs[EMPTY]
        elif (self.role, first) not in LEGAL:
            self.sums[3] += 1
        self.sums, self.role = [a + b for a, b in zip(self.sums, sums, strict=True)], last
        if turn_first is not None:
            self.turns += n_turns - (turn_first == self.turn_last)
            self.turn_first, self.turn_last = turn_first if self.turn_first is None else self.turn_first, turn_last
        self.letters, self.place, self.counts = letters[self.begins], 0, iter(counts)
        self.begins = states[self.begins]
        self.audit.append(self.letters)

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.items else ''}{role}:{text}".encode())
        self.items += 1

    def _insert(self) -> None:
        self.state = AFTER[self.state]
        self._put(NAMES[self.state], "")

    def text(self, key: tuple, role: str, text: pa.Scalar) -> None:
        if key == self.seen:
            return  # its count is with the first of them
        self.seen, left = key, next(self.counts)
        while left:
            letter = self.letters[self.place]
            self.place += 1
            if letter == "I":
                self._insert()
                continue
            left -= 1
            if letter == "K":
                self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                self._put(role, text.as_py())
            elif letter == "R":
                self.state = AFTER[self.state]
                self._put(NAMES[self.state], text.as_py())

    def row(self) -> tuple:
        while self.state in (SYSTEM, USER):
            self._insert()
            self.audit.append("I")
        gaps = 0 if self.turn_first is None else self.turn_last - self.turn_first + 1 - self.turns
        blank, duplicate, truncated, illegal = self.sums
        return self.conv_id, gaps, blank, duplicate, truncated, illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def repair(rows: DataFrame, damaged: bool = False) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows (conv_id, turn, role, text) are damaged first, unless they are so already. In a conversation's order (turn,
    nulls first; then role and text, repeats together), blank and repeated rows must go, and the roles' initials must
    become nothing, or user and assistant in turn after at most one system row, at the least cost; of equally cheap
    edits the audit that is least in ASCII is taken. Faults and roles give symbols; runs of one symbol are advanced by
    powers of two of its min-plus transition. Transitions of blocks are made apart, costs run back over them, edits of
    blocks are chosen apart for each state that they may begin in, and one pass over a conversation's texts, which
    SHA-256 needs in order, puts them together in constant memory but for the audit that the row holds.

    Null conv_id: a conversation of its own. Null roles and texts are one space, null turns take no part in gaps.
    Conversations without rows after damage: zeros, an empty audit and the hash of nothing. Other columns are ignored.
    No rows: an empty result.
    """
    n = common.partitions(rows.sparkSession)
    whole = rows.withColumn("copies", F.lit(1).cast("long")).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(x), F.lit(" ")).alias(x) for x in ("role", "text")], "copies") if damaged else damage(rows)
    chosen = _chosen(_with_costs(blocks(whole)))
    texts = _keyed(whole).select(*ORDER, "role", "text").withColumns({"kind": F.lit(2)})
    names = rows.select(F.col("conv_id").cast("long")).distinct().withColumn("kind", F.lit(0))
    both = texts.unionByName(chosen.withColumn("kind", F.lit(1)), allowMissingColumns=True).unionByName(names, allowMissingColumns=True)
    dealt = both.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("kind") > 0, *ORDER[1:], "kind")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        schema = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _RESULT.split(", ")])
        for batch in batches:
            out, texts = [], batch.column("text")
            plain = {x: batch.column(x).to_pylist() for x in ("conv_id", "kind", "turn", "digest", "role")}
            listed = {x: batch.column(x) for x in ("ns", "costs", "letters", "states", *_FACTS)}
            for i, kind in enumerate(plain["kind"]):
                if kind == 0:
                    if now is not None:
                        out.append(now.row())
                    now = _Conversation(plain["conv_id"][i])
                elif kind == 1:
                    now.block(tuple(listed[x][i].as_py() for x in _FACTS), *(listed[x][i].as_py() for x in ("ns", "costs", "letters", "states")))
                else:
                    now.text((plain["turn"][i], plain["digest"][i]), plain["role"][i], texts[i])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(now.row(), schema.types, strict=True)], schema=schema)

    return dealt.mapInArrow(fold, _RESULT)
