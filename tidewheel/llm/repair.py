"""Repair of conversations whose turns were lost, emptied, cut, repeated or given a wrong role.

A conversation's rows are read by turn (nulls first; then by role and text).
Each row's first fault counts: blank (nothing but ASCII white space),
duplicate (its role and text were seen before), truncated (its last other
character is none of . ! ?). The cheapest edits make the initials of the roles
an optional s and pairs of ua, at least one, or nothing at all: Keep costs 0,
Rerole to user or assistant 2, Delete 3 (blank and duplicate rows must go),
Insert of an empty user or assistant turn 2, and an undeleted truncated row 1
more. The audit is the edits' initials in order; of equally cheap ones the
ASCII-least is taken.

Signatures: all that the edits depend on is, per row, the role's initial and
the fault, one character each (see symbol). Conversations are grouped by this
string, each distinct one is solved once, and the audit is joined back.

Solving: what lies behind a row matters only by the cost to go on from each of
four states (nothing yet; after s; after u; after a), and of it only by the
differences, which are small numbers. So the recursion halves the string and
remembers (piece, differences behind it): pieces that many conversations
share, and repeats within a long one, are solved once, and the depth is the
logarithm of the length. Deciding by the cost to go makes the least audit
the one that takes the least letter at each step.

Replay: the rows of a conversation stream in order past its audit, which comes
first; nothing but the audit and one batch of rows is held.

Cases: null roles and texts are one space, and so are null ids and turns in the
key that damages rows; rows with a null conv_id are one conversation; repeated
rows are rows (the second is a duplicate); roles with other initials than s, u
and a can only be reroled or deleted; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidewheel.llm.common import beside_classes, keep_nothing, written

BLANK = r"[^\x20\x09-\x0D]"
OPEN_END = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"
#: Rows of a conversation that must go.
GONE = "x"
#: Audits up to this length may be broadcast with a hot signature.
LIGHT = 4096

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or reroled turn, which each state determines.
NEXT = (USER, USER, ASSISTANT, USER)
#: Cost to end in each state, and the insertions that do it.
END = ((0, 4, 2, 0), ("", "II", "I", ""))
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with rows damaged by crc32 of conv_id:turn modulo 20, and lost, which marks those that are dropped.

    0 drops the row, 1 empties its text, 2 removes its . ! ?, 3 repeats it and 4 makes its role user.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    kind = (F.crc32(key) % 20).alias("kind")
    one = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return one.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("lost"), F.explode(times).alias("copy")).drop("copy")


def symbol(initial: Column, fault: Column) -> Column:
    """One character: x must go; else s, u, a or o for any other initial, in capitals where truncated."""
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(fault.isin("blank", "duplicate"), GONE).when(fault == "truncated", F.upper(letter)).otherwise(letter)


def faults(rows: DataFrame) -> DataFrame:
    """Narrow rows of a damaged table: conv_id, turn, lost, pos (from 1), fault (or null), symbol, illegal (against the row before).

    Rows that are lost come last and have no fault. Texts are told apart by
    SHA-256 here, so they are not shuffled.
    """
    blank, cut = ~F.col("text").rlike(BLANK), F.col("text").rlike(OPEN_END)
    narrow = rows.select("conv_id", "turn", "role", "lost", _text_key().alias("key"), F.substring("role", 1, 1).alias("initial"), blank.alias("is_blank"), cut.alias("is_cut"))
    by_conv = W.partitionBy("conv_id").orderBy("lost", *_order())
    before = F.lag("initial").over(by_conv)
    legal = F.concat(before, F.col("initial")).isin("su", "ua", "au")
    # The window by conversation comes first: its shuffle serves the other one and the grouping, too.
    out = narrow.withColumns({"pos": F.row_number().over(by_conv), "illegal": before.isNotNull() & ~legal})
    out = out.withColumn("seen", F.row_number().over(W.partitionBy("conv_id", "lost", "role", "key").orderBy("pos")) > 1)
    fault = F.when(F.col("is_blank"), "blank").when(F.col("seen"), "duplicate").when(F.col("is_cut"), "truncated")
    out = out.withColumn("fault", F.when(~F.col("lost"), fault))
    return out.withColumn("symbol", symbol(F.col("initial"), F.col("fault"))).select("conv_id", "turn", "lost", "pos", "fault", "symbol", "illegal")


def _text_key() -> Column:
    return F.unhex(F.sha2("text", 256))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")]


def summaries(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows with faults: conv_id, gaps, numbers of faults, illegal and its signature."""
    there = ~F.col("lost")

    def number(what: Column) -> Column:
        return F.count_if(there & what)

    turn = F.when(there, F.col("turn"))
    gaps = F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn)
    letters = F.array_sort(F.collect_list(F.when(there, F.struct("pos", "symbol"))))
    return rows.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        *[number(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        number(F.col("illegal")).alias("illegal"),
        F.array_join(F.transform(letters, lambda x: x["symbol"]), "").alias("signature"),
    )


@lru_cache(maxsize=1 << 16)
def _plan(piece: str, behind: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[str, ...], tuple[int, ...]]:
    """For a piece and the costs to go on behind it (the least of them 0): what all costs rise by, the differences in front of
    the piece, and per state in front the edits and the state behind."""
    if len(piece) > 1:
        half = len(piece) // 2
        rise, middle, last, ends = _plan(piece[half:], behind)
        more, front, first, turns = _plan(piece[:half], middle)
        return rise + more, front, tuple(first[s] + last[turns[s]] for s in range(4)), tuple(ends[turns[s]] for s in range(4))
    kept = KEEPS.get(piece.lower(), {})
    extra = 1 if piece.isupper() else 0
    # What the row itself may become, in each state: (cost, letter, state behind).
    direct = []
    for s in range(4):
        ways = [(3 + behind[s], "D", s)]
        if piece != GONE:
            ways.append((2 + extra + behind[NEXT[s]], "R", NEXT[s]))
            if s in kept:
                ways.append((extra + behind[kept[s]], "K", kept[s]))
        direct.append(min(ways))
    # Two insertions lead through all states that any number leads to.
    cost = [min(direct[s][0], 2 + direct[NEXT[s]][0], 4 + direct[NEXT[NEXT[s]]][0]) for s in range(4)]
    edits, states = [], []
    for s in range(4):
        at, letters = s, ""
        while True:
            own = direct[at]
            inserts = 2 + cost[NEXT[at]] == cost[at]
            if own[0] == cost[at] and (own[1] == "D" or not inserts):
                break
            at, letters = NEXT[at], letters + "I"
        edits.append(letters + own[1])
        states.append(own[2])
    least = min(cost)
    return least, tuple(c - least for c in cost), tuple(edits), tuple(states)


def solve(signature: str) -> tuple[int, str]:
    """The cost and the audit of a signature."""
    costs, endings = END
    if not signature:
        return 0, ""
    rise, front, edits, ends = _plan(signature, costs)
    return rise + front[START], edits[START] + endings[ends[START]]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep_nothing()
    for batch in batches:
        found = [solve(s) for s in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["signature", "n", "cost", "audit"])
    _plan.cache_clear()


def solved(convs: DataFrame) -> DataFrame:
    """signature, n (conversations that have it), cost, audit: one row per distinct signature."""
    return convs.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).mapInArrow(_solved, "signature string, n long, cost long, audit string")


TURN = ("user", "assistant")


def _replayed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches (conv_id, head, role, text) in order, a head before the rows of its conversation, with these rows edited."""
    keep_nothing()
    audit, at, state, place, conv = "", 0, ASSISTANT, 0, None
    out: list[tuple[object, ...]] = []

    def put(role: str, text: str) -> None:
        nonlocal state, place
        state = {"s": SYSTEM, "u": USER}.get(role[:1], ASSISTANT)
        place += 1
        out.append((conv, None, place, role, text))

    def insert() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            at += 1
            put(TURN[NEXT[state] == ASSISTANT], "")

    for batch in batches:
        for own, head, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            insert()
            if head is not None:
                conv, audit, at, state, place = own, head["audit"], 0, START, 0
                out.append((conv, head, 0, None, None))
                continue
            edit = audit[at]
            at += 1
            if edit == "K":
                put(role, text)
            elif edit == "R":
                put(TURN[NEXT[state] == ASSISTANT], text)
        if out:
            yield _batch(out, schema)
    insert()
    if out:
        yield _batch(out, schema)


def replayed(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, head, place, role, text: of each conversation a row with its summary as head (place 0), then its repaired turns.

    rows is a damaged table, convs has conv_id, audit and what else the head is
    to hold. The order holds inside partitions, and a conversation lies in one.
    """
    head = convs.select("conv_id", F.struct(*convs.columns).alias("head"))
    first = head.select("conv_id", "head", F.lit(0).alias("kind"), *[F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("role", "string"), ("text", "string"), ("key", "binary"))])
    after = rows.where(~F.col("lost")).select("conv_id", F.lit(None).cast(head.schema["head"].dataType).alias("head"), F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "text", _text_key().alias("key"))
    stream = first.unionByName(after).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_order()).select("conv_id", "head", "role", "text")
    fields = StructType([stream.schema["conv_id"], stream.schema["head"], StructField("place", LongType()), StructField("role", StringType()), StructField("text", StringType())])
    return stream.mapInArrow(partial(_replayed, schema=to_arrow_schema(fields)), fields)


def repair(conversations: DataFrame) -> DataFrame:
    """As replayed: the damaged rows of conversations with the cheapest edits made, each conversation led by its summary."""
    rows = damage(conversations)
    convs = written(summaries(faults(rows)), "repair-conversations")
    answers = written(solved(convs), "repair-signatures")
    light = F.length("signature") <= LIGHT
    audited = beside_classes(convs, answers, ["signature"], "n", light)
    return replayed(rows, audited)


def _digested(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The heads of a stream of replayed conversations, each with the digest of its turns as role:text lines."""
    held: list[tuple[object, object, str]] = []
    now, sha, lines = None, hashlib.sha256(), False
    for batch in batches:
        for conv, head, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "head", "role", "text")), strict=True):
            if head is not None:
                if now is not None:
                    held.append((*now, sha.hexdigest()))
                now, sha, lines = (conv, head), hashlib.sha256(), False
                continue
            sha.update(b"\n" * lines + f"{role}:{text}".encode())
            lines = True
        if held:
            yield _batch(held, schema)
    if now is not None:
        yield _batch([(*now, sha.hexdigest())], schema)


def _batch(rows: list[tuple[object, ...]], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of the rows, which are taken out of the list."""
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    rows.clear()
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def audits(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    turns = repair(conversations)
    fields = StructType([turns.schema["conv_id"], turns.schema["head"], StructField("repaired_sha256", StringType())])
    rows = turns.mapInArrow(partial(_digested, schema=to_arrow_schema(fields)), fields)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return rows.select("conv_id", *[F.col(f"head.{n}").alias(n) for n in names], "repaired_sha256")
