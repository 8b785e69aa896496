"""Conversation structure repair: the cheapest edits that make a conversation alternate.

A conversation's roles shall read ``(s?(ua)+)?`` by their initials. Rows are kept, given another role, deleted or put in, each
at a cost; rows without words and repeats must go. The costs to go from each of four states (nothing yet, system, user or
assistant last) follow from those of the next row, backward. Of these vectors only checkpoints are stored; walking forward,
each block's vectors are computed again from its end's checkpoint, and of the edits that are tight (whose cost and what
follows add up to the cost to go) the one with the least letter is taken, which gives the least string of all cheapest ones.

Twice over: a conversation is cut in blocks of at most ``BLOCK`` rows, wherever Spark's range partitioning puts them, and a
block's effect on the vectors is a 4 by 4 matrix of least sums; so the blocks' matrices are computed side by side and the
checkpoints between blocks come from a backward pass over matrices alone. Within a block the checkpoints are the square root of
its rows apart. Both passes over a conversation's blocks are streams over sorted partitions: a task holds one block, its
checkpoints and the audit so far, whatever a conversation's length. A conversation's digest and audit are one value each,
so its forward pass is in one task.

Rows that are alike in conversation, turn, role and text are counted before they are moved, and a repeat is recognised by a
join with the turns at which such rows are first seen, so a text that fills a third of the table is in no task's hands.

Defined results: a null role or text is one blank; a null conversation id is an id of its own; null turns come first; rows of
one turn are ordered by role and text; repeated rows are repeats; a role's initial is its first character, whatever follows,
and an empty role has none; a conversation without rows has zeros, no edits and the digest of nothing; an empty table gives an
empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import inf, isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthcal.llm.shared import materialize

#: Rows and characters of a block.
BLOCK, BLOCK_CHARS = 1024, 4_000_000
#: Fixed by the contract: costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, system last, user last, assistant last; the state after the role that each one asks for.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
#: Costs to go at the end: nothing and "assistant last" are complete.
END = (0, 2 * INSERT, INSERT, 0)
#: A row's code: its initial (0 other, 1 system, 2 user, 3 assistant), plus 4 if truncated; GONE if it must be deleted.
INITIALS = {"s": 1, "u": 2, "a": 3}
GONE = 8
ROLES = {USER: "user", ASSISTANT: "assistant"}


def kept_state(state: int, code: int) -> int | None:
    """The state after a row is kept, None where its role doesn't fit."""
    initial = code & 3
    if initial == 1:
        return SYSTEM if state == START else None
    return NEXT[state] if initial and ROLES[NEXT[state]][0] == "sua"[initial - 1] else None


def options(state: int, code: int) -> Iterator[tuple[int, str, int, bool]]:
    """Cost, letter, next state of every edit at a row, and whether it moves on to the next row; letters ascend."""
    yield DELETE, "D", state, True
    yield INSERT, "I", NEXT[state], False
    if not code & GONE:
        extra = TRUNCATED if code & 4 else 0
        to = kept_state(state, code)
        if to is not None:
            yield extra, "K", to, True
        yield REROLE + extra, "R", NEXT[state], True


#: Edits of a row by code and state, without insertions: (cost, state after).
MOVES = [[[(c, to) for c, letter, to, on in options(s, code) if on] for s in range(4)] for code in range(16)]


def back(code: int, after: tuple) -> tuple:
    """The costs to go before a row, from those after it; insertions before the row included."""
    b0, b1, b2, b3 = (min([cost + after[to] for cost, to in moves]) for moves in MOVES[code])
    c2, c3 = min(b2, INSERT + b3), min(b3, INSERT + b2)
    return min(b0, INSERT + c2), min(b1, INSERT + c2), c2, c3


UNIT = tuple(tuple(0 if s == t else inf for s in range(4)) for t in range(4))


def matrix(codes: bytes) -> list[int]:
    """Least cost from each state before the rows to each state after them, row by row; -1 for none."""
    columns = list(UNIT)
    for code in reversed(codes):
        columns = [back(code, c) for c in columns]
    return [-1 if columns[t][s] == inf else columns[t][s] for s in range(4) for t in range(4)]


def through(m: list[int], after: tuple) -> tuple:
    """The costs to go before a block, from its matrix and those after it."""
    return tuple(min(m[4 * s + t] + after[t] for t in range(4) if m[4 * s + t] >= 0) for s in range(4))


def walk(codes: bytes, state: int, end: tuple, last: bool) -> Iterator[tuple[str, int | None, int]]:
    """The least tight edits of a block: letter, the row it takes (None for insertions) and the state after.

    The vectors are stored every square root of the rows and computed again between two checkpoints.
    """
    n = len(codes)
    step = max(1, isqrt(n))
    checkpoints, vector = {n: end}, end
    for i in range(n - 1, -1, -1):
        vector = back(codes[i], vector)
        if i % step == 0:
            checkpoints[i] = vector
    for begin in range(0, n, step):
        stop = min(begin + step, n)
        vectors = [checkpoints[stop]]
        for i in range(stop - 1, begin, -1):
            vectors.append(back(codes[i], vectors[-1]))
        vectors.append(checkpoints[begin])
        for i in range(begin, stop):
            here, after = vectors[stop - i], vectors[stop - i - 1]
            moved = False
            while not moved:
                letter, to, moved = next((x, t, on) for cost, x, t, on in options(state, codes[i]) if cost + (after if on else here)[t] == here[state])
                state = to
                yield letter, i if moved else None, state
    while last and END[state]:
        state = NEXT[state]
        yield "I", None, state


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, copies: the rows after the damage that their checksum asks for."""
    blank = F.lit(" ")
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), blank).alias("role"), F.coalesce(F.col(text).cast("string"), blank).alias("text"))
    fault = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    rows = rows.withColumn("fault", fault).where("fault <> 0")
    said = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"))


def judged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, fault, code: distinct rows, of which all but the first of a kind are repeats."""
    rows = rows.withColumn("digest", F.sha2("text", 256))
    kinds = ["conv_id", "role", "digest"]
    seen = rows.groupBy(kinds).agg(F.max(F.col("turn").isNull()).alias("any_null"), F.min("turn").alias("least"), F.max("turn").alias("most"))
    # only what is seen at several turns; the first of them
    seen = seen.where((F.col("least") != F.col("most")) | (F.col("any_null") & F.col("least").isNotNull()))
    seen = seen.select(*(F.col(k).alias(f"k_{k}") for k in kinds), F.when(~F.col("any_null"), F.col("least")).alias("first_turn"), F.lit(True).alias("again"))
    distinct = rows.groupBy("conv_id", "turn", "role", "digest").agg(F.first("text").alias("text"), F.sum("copies").alias("copies"))
    on = F.lit(True)
    for k in kinds:
        on = on & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    distinct = distinct.join(seen, on, "left")
    solid = F.rtrim("text", F.lit(" \t\n\v\f\r"))
    fault = (
        F.when(solid == "", "blank")
        .when(F.coalesce("again", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first_turn")), "duplicate")
        .when(~F.substring(solid, -1, 1).isin(".", "!", "?"), "truncated")
    )
    initial = F.substring("role", 1, 1)
    code = sum((F.when(initial == k, v).otherwise(0) for k, v in INITIALS.items()), F.lit(0))
    code = F.when(F.col("fault").isin("blank", "duplicate"), code + GONE).when(F.col("fault") == "truncated", code + 4).otherwise(code)
    return distinct.withColumn("fault", fault).select("conv_id", "turn", "role", "text", "copies", "fault", code.cast("int").alias("code"))


BLOCKS = "part int, block int, turns array<bigint>, roles array<string>, texts array<string>, faults array<string>, codes binary, costs array<bigint>"
_BLOCK_TYPES = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary(), pa.list_(pa.int64())]


def blocks(rows: DataFrame, block: int) -> DataFrame:
    """conv_id and BLOCKS: the rows of a conversation in order, cut into blocks; (part, block) gives their order."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ready, chars, size, open_rows, owner, id_type = TaskContext.get().partitionId(), 0, [], 0, 0, [], None, None

        def close() -> None:
            nonlocal number, open_rows, size
            turns, roles, texts, faults, codes = zip(*open_rows, strict=True)
            ready.append((owner, part, number, turns, roles, texts, faults, bytes(codes), matrix(bytes(codes))))
            number, open_rows, size = number + 1, [], 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*ready, strict=True), [id_type, *_BLOCK_TYPES], strict=True)]
            ready.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", *(c.split()[0] for c in BLOCKS.split(", "))])

        for batch in batches:
            id_type = batch.column(0).type
            for i in range(batch.num_rows):
                conv, turn, role, text, copies, fault, code = (batch.column(c)[i].as_py() for c in range(7))
                if open_rows and conv != owner:
                    close()
                owner = conv
                for copy in range(copies):
                    again = copy and fault != "blank"
                    open_rows.append((turn, role, text, "duplicate" if again else fault, code & 3 | GONE if again else code))
                    size, chars = size + len(text), chars + len(text)
                    if len(open_rows) >= block or size > BLOCK_CHARS:
                        close()
                    if chars > BLOCK_CHARS and ready:
                        yield flush()
                        chars = 0
        if open_rows:
            close()
        if ready:
            yield flush()

    return rows.select("conv_id", "turn", "role", "text", "copies", "fault", "code").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, f"conv_id {kind}, {BLOCKS}")


def checkpoints(pieces: DataFrame) -> DataFrame:
    """part, block, after, last: the costs to go behind each block, from the matrices alone."""
    order = [F.asc_nulls_first("conv_id"), F.desc("part"), F.desc("block")]

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, vector = (), END
        for batch in batches:
            out = []
            for conv, part, number, costs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if owner != (conv,):
                    owner, vector = (conv,), END
                    out.append((part, number, vector, True))
                else:
                    out.append((part, number, vector, False))
                vector = through(costs, vector)
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.bool_()], strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "after", "last"])

    return pieces.select("conv_id", "part", "block", "costs").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(backward, "part int, block int, after array<bigint>, last boolean")


class Repair:
    """One conversation on its way through its blocks."""

    def __init__(self, conv):
        self.conv, self.state, self.cost = conv, START, None
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.initial, self.turns, self.turn, self.least = 0, None, 0, None, None
        self.audit, self.digest, self.lines = [], hashlib.sha256(), 0

    def take(self, turns: list, roles: list, texts: list, faults: list, codes: bytes, after: list, last: bool) -> None:
        for turn, role, fault in zip(turns, roles, faults, strict=True):
            if fault:
                self.counts[fault] += 1
            initial = role[:1]
            self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
            self.initial = initial
            if turn is not None and turn != self.turn:
                self.turns, self.turn = self.turns + 1, turn
                self.least = turn if self.least is None else self.least
        if self.cost is None:
            vector = tuple(after)
            for code in reversed(codes):
                vector = back(code, vector)
            self.cost = vector[START]
        audit = []
        for letter, row, state in walk(codes, self.state, tuple(after), last):
            audit.append(letter)
            self.state = state
            if letter != "D":
                role = roles[row] if letter == "K" else ROLES[state]
                line = f"{role}:{'' if row is None else texts[row]}"
                self.digest.update((("\n" if self.lines else "") + line).encode("utf-8", "surrogatepass"))
                self.lines += 1
        self.audit.append("".join(audit))

    def row(self) -> tuple:
        gaps = self.turn - self.least + 1 - self.turns if self.turns else 0
        return self.conv, gaps, self.counts["blank"], self.counts["duplicate"], self.counts["truncated"], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT_TYPES = [*[pa.int64()] * 6, pa.string(), pa.string()]


def repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id and RESULT for every conversation of damaged rows (conv_id, turn, role, text, copies)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    pieces = materialize(blocks(judged(rows), block), "repair")
    order = [F.asc_nulls_first("conv_id"), F.asc("part"), F.asc("block")]
    joined = pieces.drop("costs").join(checkpoints(pieces), ["part", "block"])

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def flush(id_type: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [id_type, *_RESULT_TYPES], strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", *(c.split()[0] for c in RESULT.split(", "))])

        for batch in batches:
            for i in range(batch.num_rows):
                conv, *values = (c[i].as_py() for c in batch.columns)
                if now is None or now.conv != conv:
                    now = Repair(conv)
                now.take(*values)
                if values[-1]:
                    out.append(now.row())
            if out:
                yield flush(batch.column(0).type)

    stream = joined.select("conv_id", "part", "block", "turns", "roles", "texts", "faults", "codes", "after", "last").repartition("conv_id").sortWithinPartitions(*order)
    return stream.drop("part", "block").mapInArrow(forward, f"conv_id {kind}, {RESULT}")


def repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """conv_id and RESULT for every original conversation, after damage by checksum."""
    found = repaired(damaged(conversations, conv_id, turn, role, text), block).withColumnRenamed("conv_id", "found_id")
    every = conversations.select(F.col(conv_id).alias("conv_id")).distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
