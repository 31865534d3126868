"""Repair of damaged conversations by a generalised LR parse with edits.

The grammar of role initials is (s?(ua)+)?.  Its LR states are the tops of a graph-structured
stack: nothing read, s, u, a.  Every row is kept, given another role or deleted, and messages
are inserted before it; tops of the same state merge into the one of least (cost, audit), where
the audit is the string of edit initials D, I, K, R.  Tops of one state have read the same rows,
so of two audits with the same cost neither begins the other, and whatever follows cannot turn
their order round.

The parse of a stretch of rows is a table (state before, state after) -> (cost, audit), and two
tables compose.  A conversation of any length is cut where the range partitions are cut; the
stretches are parsed side by side and only their tables meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from newsmill.llm.common import partitions, pick
from newsmill.session import durable

NONE, SYSTEM, USER, ASSISTANT = range(4)
# (state before, initial) -> state after
SHIFT = {
    (NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
ACCEPTING = (NONE, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
# rows whose audits are kept as separate strings before they are joined to longer ones
STRETCH = 256
BLANKS = " \t\n\x0b\x0c\r"
ID = ["conv_id"]
ORDER = ["turn", "role", "same"]


def _least(tops: dict, state: int, cost: int, audit: str) -> None:
    if state not in tops or (cost, audit) < tops[state]:
        tops[state] = (cost, audit)


def inserted(tops: dict) -> dict:
    """The tops after inserting any number of messages.  Three reach every state that can be."""
    for _ in range(3):
        for state, (cost, audit) in list(tops.items()):
            for initial in NAMES:
                after = SHIFT.get((state, initial))
                if after is not None:
                    _least(tops, after, cost + INSERT, audit + "I")
    return tops


def step(tops: dict, initial: str, gone: bool, truncated: bool) -> dict:
    """The tops after one row; ``gone`` rows must be deleted."""
    after: dict = {}
    for state, (cost, audit) in inserted(dict(tops)).items():
        _least(after, state, cost + DELETE, audit + "D")
        if gone:
            continue
        kept = cost + TRUNCATED * truncated
        if (state, initial) in SHIFT:
            _least(after, SHIFT[state, initial], kept, audit + "K")
        for other in NAMES:
            if (state, other) in SHIFT:
                _least(after, SHIFT[state, other], kept + REROLE, audit + "R")
    return after


def compose(left: dict, right: dict) -> dict:
    """Tables of two stretches, one after the other."""
    out: dict = {}
    for before, tops in left.items():
        joined: dict = {}
        for middle, (cost, audit) in tops.items():
            for after, (more, rest) in right.get(middle, {}).items():
                _least(joined, after, cost + more, audit + rest)
        out[before] = joined
    return out


def accept(tops: dict) -> tuple[int, str]:
    """The least (cost, audit) that ends in a legal conversation."""
    return min(top for state, top in inserted(dict(tops)).items() if state in ACCEPTING)


class Stretch:
    """What is known of a run of rows of one conversation: the table of its parse and the counts."""

    def __init__(self, starts=(NONE, SYSTEM, USER, ASSISTANT)):
        self.table = None
        self.open = {s: {s: (0, "")} for s in starts}
        self.fresh, self.read = dict(self.open), 0
        self.first = self.last = None
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, initial: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        gone = blank or duplicate
        self.open = {s: step(tops, initial, gone, truncated and not gone) for s, tops in self.open.items()}
        self.read += 1
        if self.read % STRETCH == 0:
            self.close()
        if self.first is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.blank += blank
        self.duplicate += duplicate and not blank
        self.truncated += truncated and not gone

    def close(self) -> None:
        if self.table is None:
            self.table = self.open
        else:
            self.table = compose(self.table, self.open)
        self.open = {s: {s: (0, "")} for s in (NONE, SYSTEM, USER, ASSISTANT)}

    def tuple(self) -> tuple:
        self.close()
        cells = [
            {"before": b, "after": a, "cost": cost, "audit": audit}
            for b, tops in self.table.items() for a, (cost, audit) in tops.items()
        ]
        return (cells, self.first, self.last, self.low, self.high, self.turns, self.blank, self.duplicate,
                self.truncated, self.illegal)


STRETCHES = (
    "cells array<struct<before int, after int, cost long, audit string>>, first string, last string, low {turn}, "
    "high {turn}, turns long, blank long, duplicate long, truncated long, illegal long"
)
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def parsed(rows: DataFrame) -> DataFrame:
    """(conv_id, part, ...): a stretch per conversation and range partition.  ``rows`` has conv_id,
    turn, role, same, copies, blank, truncated and duplicates (how many of the copies)."""
    kinds = dict(rows.dtypes)

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, conv, held, out = TaskContext.get().partitionId(), None, None, []

        def flush():
            held.close()
            return (conv, part, *held.tuple())

        def batch_of(found):
            columns = list(zip(*found))
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)

        for batch in batches:
            shape = pa.schema([
                ("conv_id", batch.schema.field("conv_id").type), ("part", pa.int32()),
                ("cells", pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
                ("first", pa.string()), ("last", pa.string()),
                ("low", batch.schema.field("turn").type), ("high", batch.schema.field("turn").type),
                *[(c, pa.int64()) for c in ("turns", "blank", "duplicate", "truncated", "illegal")],
            ])
            for c, turn, role, blank, truncated, copies, again in zip(*(
                batch.column(n).to_pylist()
                for n in ("conv_id", "turn", "role", "blank", "truncated", "copies", "duplicates")
            )):
                if held is None or c != conv:
                    if held is not None:
                        out.append(flush())
                    # only the first conversation of a partition can have begun in another
                    conv, held = c, Stretch() if held is None else Stretch((NONE,))
                for k in range(copies):
                    held.add(turn, role[:1], blank, k >= copies - again, truncated)
                if len(out) >= 1000:
                    yield batch_of(out)
                    out = []
        if held is not None:
            out.append(flush())
        if out:
            yield batch_of(out)

    shape = f"conv_id {kinds['conv_id']}, part int, " + STRETCHES.format(turn=kinds["turn"])
    columns = ["conv_id", "turn", "role", "blank", "truncated", "copies", "duplicates"]
    return (
        rows.repartitionByRange(partitions(rows), *ID, *ORDER)
        .sortWithinPartitions(*ID, *ORDER)
        .select(*columns)
        .mapInArrow(each, shape)
    )


def joined(stretches: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, ..., cost, audit): the stretches of each conversation, of which there
    are no more than range partitions, composed in order."""
    kind = dict(stretches.dtypes)["conv_id"]

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shape = None

        def end():
            cost, audit = accept(table[NONE])
            gaps = 0 if low is None else int(high - low + 1 - turns)
            return (conv, gaps, *sums, cost, audit)

        started, conv, table, last, low, high, turns, sums = False, None, None, None, None, None, 0, [0] * 4
        for batch in batches:
            shape = pa.schema([("conv_id", batch.schema.field("conv_id").type),
                               *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                               ("audit", pa.string())])
            done = []
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                c, _, cells, first, end_role, lo, hi, n, *counts = row
                if not started or c != conv:
                    if started:
                        done.append(end())
                    started, conv, table = True, c, {NONE: {NONE: (0, "")}}
                    last = low = high = None
                    turns, sums = 0, [0] * 4
                more: dict = {}
                for cell in cells:
                    more.setdefault(cell["before"], {})[cell["after"]] = (cell["cost"], cell["audit"])
                table = compose(table, more)
                turns += n - (n > 0 and lo == high)
                low = lo if low is None else low
                high = hi if hi is not None else high
                sums = [a + b for a, b in zip(sums, counts)]
                if last is not None and last + first not in LEGAL:
                    sums[3] += 1
                last = end_role
            if done:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*done), shape)], schema=shape)
        if started:
            yield pa.record_batch([pa.array([x], f.type) for x, f in zip(end(), shape)], schema=shape)

    return (
        stretches.repartition(partitions(stretches), *ID)
        .sortWithinPartitions(*ID, "part")
        .mapInArrow(each, f"conv_id {kind}, {COUNTS}")
    )


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the repaired conversation as ``role:text`` lines.

    A digest runs over a text from its beginning, so the rows of a conversation stream through one
    task in order, each hashed and let go; none is gathered."""
    kind = dict(rows.dtypes)["conv_id"]
    both = rows.select(*ID, F.lit(1).alias("kind"), *ORDER, "copies", "text", F.lit(None).cast("string").alias("audit")).unionByName(
        found.select(*ID, F.lit(0).alias("kind"), "audit"), allowMissingColumns=True
    )

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        conv, digest, edits, begun, at, place = None, None, "", False, 0, 0
        shape = None

        def put(role: str, text: str) -> None:
            nonlocal begun
            digest.update((("\n" if begun else "") + role + ":").encode())
            digest.update(text.encode())
            begun = True

        def inserts() -> None:
            nonlocal at, place
            while at < len(edits) and edits[at] == "I":
                put(NAMES["ua"[place % 2]], "")
                at, place = at + 1, place + 1

        for batch in batches:
            shape = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("repaired_sha256", pa.string())])
            done = []
            for c, which, role, copies, text, audit in zip(*(
                batch.column(n).to_pylist() for n in ("conv_id", "kind", "role", "copies", "text", "audit")
            )):
                if which == 0:
                    if digest is not None:
                        inserts()
                        done.append((conv, digest.hexdigest()))
                    conv, digest, edits, begun, at, place = c, hashlib.sha256(), audit, False, 0, 0
                    continue
                for _ in range(copies):
                    inserts()
                    edit, at = edits[at], at + 1
                    if edit == "D":
                        continue
                    put(role if edit == "K" else NAMES["ua"[place % 2]], text)
                    place += not (edit == "K" and role[:1] == "s")
            if done:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*done), shape)], schema=shape)
        if digest is not None:
            inserts()
            yield pa.record_batch([pa.array([x], f.type) for x, f in zip((conv, digest.hexdigest()), shape)], schema=shape)

    return (
        both.repartition(partitions(both), *ID)
        .sortWithinPartitions(*ID, "kind", *ORDER)
        .select(*ID, "kind", "role", "copies", "text", "audit")
        .mapInArrow(each, f"conv_id {kind}, repaired_sha256 string")
    )


def repair(messages: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): the
    cheapest edits that make each conversation one of the grammar.

    ``messages`` has conv_id, turn, role, text and, if rows stand for several, copies.  ``convs``
    (conv_id) adds conversations that may have no message: zeros, no audit, the hash of the empty
    string.  Rows go by turn, null turns first, then by role and by sha256 of role and text; equal
    rows are next to each other.  Null roles and texts count as one space, so a null text is blank
    and a null role is neither s, u nor a.  Rows without conv_id are one conversation.  Any role
    with the right initial can be kept; an empty one cannot."""
    if "copies" not in messages.columns:
        messages = messages.withColumn("copies", F.lit(1))
    rows = (
        messages.select("conv_id", "turn", "copies", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
        .withColumn("same", F.sha2(F.concat_ws("\0", F.length("role"), "role", "text"), 256))
    )
    end = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    light = (
        rows.select(*ID, *ORDER, "copies", (end == "").alias("blank"), ((end != "") & ~end.isin(".", "!", "?")).alias("truncated"))
        .groupBy(*ID, *ORDER)
        .agg(F.sum("copies").cast("int").alias("copies"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    )
    light = durable(light, "turns")
    # equal rows stand first where the turn is null or least; keys are summed before the shuffle
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = light.groupBy(*ID, "role", "same").agg(F.min(place).alias("at"))
    alike = [a.eqNullSafe(b) for a, b in ((F.col(f"l.{c}"), F.col(f"r.{c}")) for c in ("conv_id", "role", "same"))]
    first = F.col("l.turn").eqNullSafe(F.col("r.at.turn"))
    marked = (
        light.alias("l")
        .join(firsts.alias("r"), alike[0] & alike[1] & alike[2])
        .select("l.*", F.when(first, F.col("copies") - 1).otherwise(F.col("copies")).alias("duplicates"))
    )
    found = durable(joined(durable(parsed(marked), "stretches")), "repairs")
    ids = (convs if convs is not None else messages).select(*ID).distinct().alias("i")
    hashed = repaired(rows, found).alias("h")
    counts = [c.split()[0] for c in COUNTS.split(", ")]
    return (
        ids.join(found.alias("f"), F.col("i.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
        .join(hashed, F.col("i.conv_id").eqNullSafe(F.col("h.conv_id")), "left")
        .select(
            "i.conv_id",
            *[F.coalesce(F.col(f"f.{c}"), F.lit("" if c == "audit" else 0)).alias(c) for c in counts],
            F.coalesce("h.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        )
    )


def damaged(messages: DataFrame) -> DataFrame:
    """The faults of the contract, dealt by crc32 of ``conv_id:turn``: the row goes, its text goes,
    its sentence ends go, it stands twice, or a user says it.  Null counts as one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    deal = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    return messages.where(deal != 0).select(
        "conv_id", "turn",
        F.when(deal == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(deal == 1, "").when(deal == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(deal == 3, 2).otherwise(1).alias("copies"),
    )


def repair_damaged(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Damage the conversations and repair them; one row per conv_id of ``df``, null among them.
    Other columns are not looked at.  An empty table gives an empty result."""
    messages = pick(df, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    return repair(damaged(messages), messages)
