"""Repair of a conversation's role structure by the cheapest edits, by a square-root checkpointed dynamic program.

A conversation should read ``(s?(ua)+)?`` in role initials.  A walk along its rows is in one of four states
(nothing written, after system, after user, after assistant).  Backward, each row turns the least costs of its
end into those of its start; the four costs are kept only at every ``sqrt(n)``-th row.  Forward, one block of
costs is recomputed at a time, and from the state reached the ASCII-least edit whose cost is tight is written,
so the audit is the least of all cheapest ones.  Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (the only
one for a blank or repeated row), Insert an empty user or assistant row 2; a truncated row that stays adds 1.

The texts are judged in the JVM.  Rows are dealt by conversation once, sorted inside the task (Spark spills), and
streamed: the program keeps two bytes per row of the conversation it is in, which is what its audit takes as a
value, and no text.  A second stream, with the audit sorted in front of its conversation's rows, writes the
repaired rows into a running digest.  An edit depends on all rows before and after it and a digest on all bytes
before it, so one conversation is one stream; what a long one costs is time, not memory.

Defined cases: a null role or text is one space (so the text is blank), a null conversation id is one conversation
and a null turn sorts first; in the damage rule both read as one space.  Rows of equal turn are ordered by role,
then text.  Roles are judged by their first character; a kept row keeps its whole role.  Other columns are
ignored, an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.registry import query
from corpusmill.session import materialize, read_table

# --- fixed values -----------------------------------------------------------------------------
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACES = " \t\n\x0b\x0c\r"
ROLES = ("user", "assistant")
LEGAL = {"su", "ua", "au"}
# ----------------------------------------------------------------------------------------------

START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
END = (0, 2 * INSERT, INSERT, 0)  # what is left to write in each state
OPENED = (USER, USER, ASSISTANT, USER)  # the state after an inserted or reroled row
BLANK, REPEATED, CUT = 1, 2, 3  # faults
INITIALS = "sua"
GONE = 255  # a dropped row: only its conversation counts


def after_keep(state: int, initial: int) -> int | None:
    """The state after a kept row; None where its role cannot stand."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if initial == 2 and state == USER else None


def backward(code: int, ends: tuple) -> tuple:
    """Least costs before a row, per state, from those after it."""
    initial, fault = divmod(code, 4)
    stays = TRUNCATED * (fault == CUT)
    own = []
    for state in range(4):
        best = DELETE + ends[state]
        if fault not in (BLANK, REPEATED):
            best = min(best, REROLE + stays + ends[OPENED[state]])
            kept = after_keep(state, initial)
            if kept is not None:
                best = min(best, KEEP + stays + ends[kept])
        own.append(best)
    user, assistant = own[USER], own[ASSISTANT]
    own[USER], own[ASSISTANT] = min(user, INSERT + assistant), min(assistant, INSERT + user)
    own[START], own[SYSTEM] = min(own[START], INSERT + own[USER]), min(own[SYSTEM], INSERT + own[USER])
    return tuple(own)


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and ASCII-least audit of the cheapest edits; a code is 4 * initial + fault."""
    n = len(codes)
    step = max(1, math.isqrt(n))
    marks, costs = {}, END
    for i in range(n - 1, -1, -1):
        if (i + 1) % step == 0 or i == n - 1:
            marks[i // step] = costs  # the costs after the last row of a block
        costs = backward(codes[i], costs)
    total, state, audit = costs[START], START, []
    for block in range(-(-n // step)):
        rows = range(block * step, min(n, (block + 1) * step))
        after = [marks[block]]
        for i in reversed(rows):
            after.append(backward(codes[i], after[-1]))
        after.reverse()  # after[0]: before the block's first row
        for place, i in enumerate(rows):
            initial, fault = divmod(codes[i], 4)
            stays, now, then = TRUNCATED * (fault == CUT), after[place], after[place + 1]
            while True:  # letters in ASCII order: D, I, K, R
                if now[state] == DELETE + then[state]:
                    audit.append("D")
                elif now[state] == INSERT + now[OPENED[state]]:
                    audit.append("I")
                    state = OPENED[state]
                    continue
                elif (kept := after_keep(state, initial)) is not None and now[state] == KEEP + stays + then[kept]:
                    audit.append("K")
                    state = kept
                else:
                    audit.append("R")
                    state = OPENED[state]
                break
    while END[state]:
        audit.append("I")
        state = OPENED[state]
    return total, "".join(audit)


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, gone)`` after the damage that a row's own checksum decides."""
    named = F.concat(*[x for name, end in (("conv_id", ":"), ("turn", "")) for x in (F.coalesce(F.col(name).cast("string"), F.lit(" ")), F.lit(end))])
    kind = F.crc32(named.cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("_kind"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, ROLES[0]).otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("_kind") == 0).alias("gone"), copies.alias("_copy")).drop("_copy")


def _codes(rows: DataFrame) -> DataFrame:
    """Rows dealt by conversation with their code (initial and first fault)."""
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("gone"), F.col("turn").asc_nulls_first())  # dealt by conversation already: no further shuffle
    said = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(said == "", BLANK).when(F.col("seen") > 1, REPEATED).when(~F.right(said, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0)
    first = F.left(F.col("role"), F.lit(1))
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    dealt = rows.repartition("conv_id").withColumn("seen", F.row_number().over(same))
    return dealt.withColumn("code", F.when(F.col("gone"), GONE).otherwise(initial * 4 + fault).cast("int"))


class _Conversation:
    """What is kept of a conversation while its rows stream by."""

    def __init__(self, conv_id):
        self.conv_id, self.codes = conv_id, bytearray()
        self.low = self.high = None
        self.turns, self.before = 0, None

    def add(self, codes: np.ndarray, turns: list) -> None:
        self.codes += codes.astype(np.uint8).tobytes()
        for turn in turns:  # sorted, nulls first
            if turn is not None and turn != self.before:
                self.turns += 1
                self.low = turn if self.low is None else self.low
                self.high = self.before = turn

    def result(self) -> list:
        codes = bytes(self.codes)
        fault = np.frombuffer(codes, np.uint8) % 4
        cost, audit = cheapest(codes)
        letters = (INITIALS + "?").encode()
        initials = codes.translate(bytes(letters[min(c // 4, 3)] for c in range(256))).decode()
        illegal = sum(initials[i:i + 2] not in LEGAL for i in range(len(initials) - 1))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [self.conv_id, gaps, *(int((fault == k).sum()) for k in (BLANK, REPEATED, CUT)), illegal, cost, audit]


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _runs(column: pa.Array):
    """Start and end of the runs of equal conversation ids of a batch."""
    ids = column.to_pylist()
    cuts = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
    return [(a, b, ids[a]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _blocks(made: list, kinds: list[str]):
    names = [k.split()[0] for k in kinds]
    types = [pa.string() if k.endswith("string") else pa.int64() for k in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names)


def audits(rows: DataFrame) -> DataFrame:
    """A row per conversation of ``rows`` (``conv_id, turn, role, text, gone``): counts, cost and audit."""
    kinds = SUMMARY.split(", ")

    def run(batches):
        held, made = None, []
        for batch in batches:
            codes = batch.column("code").to_numpy()
            turns = batch.column("turn")
            for a, b, conv in _runs(batch.column("conv_id")):
                if held is None or held.conv_id != conv:
                    if held:
                        made.append(held.result())
                    held = _Conversation(conv)
                here = np.flatnonzero(codes[a:b] != GONE)
                held.add(codes[a:b][here], turns.slice(a, b - a).take(pa.array(here)).to_pylist())
            if len(made) > 1000 or sum(len(m[-1]) for m in made) > 1 << 20:
                yield _blocks(made, kinds)
                made = []
        if held:
            made.append(held.result())
        if made:
            yield _blocks(made, kinds)

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "seen"]
    return _codes(rows).sortWithinPartitions(*order).select("conv_id", "turn", "code").mapInArrow(run, SUMMARY)


class _Writer:
    """Digest of a repaired conversation, row by row along its audit."""

    def __init__(self, conv_id, audit: str):
        self.conv_id, self.audit, self.at, self.state = conv_id, audit, 0, START
        self.digest, self.empty = hashlib.sha256(), True

    def _write(self, role: str, text: str) -> None:
        self.digest.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "replace"))
        self.empty = False

    def _inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.at, self.state = self.at + 1, OPENED[self.state]
            self._write(ROLES[self.state - USER], "")

    def add(self, role: str, text: str) -> None:
        self._inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "R":
            self.state = OPENED[self.state]
            self._write(ROLES[self.state - USER], text)
        elif edit == "K":
            self.state = after_keep(self.state, INITIALS.find(role[:1]))
            self._write(role, text)

    def result(self) -> list:
        self._inserts()
        return [self.conv_id, self.digest.hexdigest()]


def repaired_digests(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)``: the repaired rows as ``role:text`` lines, digested as they stream by."""
    kinds = ["conv_id long", "repaired_sha256 string"]

    def run(batches):
        held, made = None, []
        for batch in batches:
            heads = batch.column("audit").to_pylist()
            for conv, audit, role, text in zip(batch.column("conv_id").to_pylist(), heads, batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if audit is not None:
                    if held:
                        made.append(held.result())
                    held = _Writer(conv, audit)
                else:
                    held.add(role, text)
            if made:
                yield _blocks(made, kinds)
                made = []
        if held:
            yield _blocks([held.result()], kinds)

    none = F.lit(None)
    heads = audited.select("conv_id", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"), "audit", F.lit(0).alias("_part"))
    body = rows.where(~F.col("gone")).select("conv_id", "turn", "role", "text", none.cast("string").alias("audit"), F.lit(1).alias("_part"))
    order = ["conv_id", "_part", F.col("turn").asc_nulls_first(), "role", "text"]
    stream = heads.unionAll(body).repartition("conv_id").sortWithinPartitions(*order)
    return stream.select("conv_id", "role", "text", "audit").mapInArrow(run, ", ".join(kinds))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: counts of faults, cost and audit of the cheapest edits, digest of the result.

    ``rows`` has ``conv_id, turn, role, text`` and ``gone`` (true: only the conversation's name counts).
    """
    audited = materialize(audits(rows), "audits")
    digests = repaired_digests(rows, audited).withColumnRenamed("conv_id", "_conv")
    return audited.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
