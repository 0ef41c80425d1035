"""Conversation structure repair as lightest derivations.

A conversation should read ``(system? (user assistant)+)?``. Editing it is a
weighted deduction: an item says "the first i rows are edited and the roles so
far end in state q"; a row's edit, or an insertion, deduces the next item from
it. Values are (cost, audit), and a deduction adds to the cost and appends to
the audit, so it is monotone and never better than its premise: items popped
from Knuth's agenda in order of value are final, and so is the goal.

Derivations are found for runs of at most BLOCK rows, from each state to each
state, and runs are put together by the same agenda over their tables. So a
conversation of any length is split over tasks by ranges of turns, and equal
runs are derived once per task. Only row kinds take part; texts are met once,
in order, when the edits are carried out.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import stage

BLOCK = 64  # rows derived by one agenda
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5  # costs; keeping costs nothing
START, SYSTEM, USER, ASSISTANT = range(4)  # what the roles so far end with
_STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_SPACE = r"\x20\x09-\x0D"

Table = tuple  # of (from, to, cost, audit)


def lightest(axiom, deductions) -> dict:
    """Knuth's agenda: the final (cost, audit) of every item that can be
    derived from the axiom. ``deductions(item)`` gives (item, cost, edits)."""
    agenda, final = [(0, "", axiom)], {}
    while agenda:
        cost, audit, item = heappop(agenda)
        if item in final:
            continue
        final[item] = cost, audit
        for then, more, edits in deductions(item):
            if then not in final:
                heappush(agenda, (cost + more, audit + edits, then))
    return final


@lru_cache(maxsize=1 << 15)
def derive(kinds: str) -> Table:
    """Lightest edits of some rows from each state to each state.

    A row's kind is s, u, a or x (another role); a capital if it is truncated,
    D if it must be deleted.
    """

    def deductions(item):
        i, q = item
        for role in "ua":
            if (q, role) in _STEP:
                yield (i, _STEP[q, role]), INSERT, "I"
        if i < len(kinds):
            kind = kinds[i]
            yield (i + 1, q), DELETE, "D"
            if kind != "D":
                kept = TRUNCATED if kind.isupper() else 0
                if (q, kind.lower()) in _STEP:
                    yield (i + 1, _STEP[q, kind.lower()]), kept, "K"
                for role in "ua":
                    if (q, role) in _STEP:
                        yield (i + 1, _STEP[q, role]), kept + REROLE, "R"

    return tuple((p, q, *value) for p in range(4) for (i, q), value in lightest((0, p), deductions).items() if i == len(kinds))


def join_tables(left: Table, right: Table) -> Table:
    """Lightest edits of two neighbouring runs."""

    def deductions(item):
        at, state = item
        return [((at + 1, q), cost, audit) for p, q, cost, audit in (left, right, ())[at] if p == state]

    return tuple((p, q, *value) for p in range(4) for (at, q), value in lightest((0, p), deductions).items() if at == 2)


def derive_long(kinds: str) -> Table:
    """As ``derive`` for any number of rows: blocks joined pair by pair, so
    that no audit is copied more often than there are levels."""
    return join_all([derive(kinds[at : at + BLOCK]) for at in range(0, len(kinds), BLOCK)])


def join_all(tables: list[Table]) -> Table:
    while len(tables) > 1:
        tables = [join_tables(*tables[k : k + 2]) if k + 1 < len(tables) else tables[k] for k in range(0, len(tables), 2)]
    return tables[0]


def goal(table: Table) -> tuple[int, str]:
    return min((cost, audit) for p, q, cost, audit in table if p == START and q in (START, ASSISTANT))


def _unlawful(pair: str) -> bool:
    return pair not in ("su", "ua", "au")


_TABLE_TYPE = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_SEGMENT = "key string, part int, head string, tail string, illegal long, derived array<struct<p: int, q: int, cost: long, audit: string>>"


def _segments(batches):
    """What lies of each conversation in this task: its derivations, its
    outer role initials and the illegal neighbours inside."""
    part = TaskContext.get().partitionId()
    key, kinds, head, tail, illegal = None, [], None, None, 0

    def segment():
        derived = [dict(zip("p q cost audit".split(), entry)) for entry in derive_long("".join(kinds))]
        return key, part, head, tail, illegal, derived

    def out(found):
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), _TABLE_TYPE]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], ["key", "part", "head", "tail", "illegal", "derived"])

    for batch in batches:
        found = []
        for own, letters, initial in zip(*(batch.column(c).to_pylist() for c in ("key", "letters", "initial"))):
            if own != key:
                if key is not None:
                    found.append(segment())
                key, kinds, head, illegal = own, [], initial, 0
            else:
                illegal += _unlawful(tail + initial)
            illegal += (len(letters) - 1) * _unlawful(initial * 2)
            tail = initial
            kinds.append(letters)
        if found:
            yield out(found)
    if key is not None:
        yield out([segment()])


def _plans(batches):
    """Join the segments of each conversation; they come in order."""
    key, tables, tail, illegal = None, [], None, 0

    def out(found):
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], ["key", "illegal", "cost", "audit"])

    for batch in batches:
        found = []
        for own, head, last, inside, derived in zip(*(batch.column(c).to_pylist() for c in ("key", "head", "tail", "illegal", "derived"))):
            if own != key:
                if key is not None:
                    found.append((key, illegal, *goal(join_all(tables))))
                key, tables, illegal = own, [], 0
            else:
                illegal += _unlawful(tail + head)
            illegal += inside
            tail = last
            tables.append(tuple(tuple(entry.values()) for entry in derived))
        if found:
            yield out(found)
    if key is not None:
        yield out([(key, illegal, *goal(join_all(tables)))])


def _keyed(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows with a key that is never null, and what orders and judges them."""
    conv, text = F.col(conv_col), F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    return rows.select(
        conv.alias("conv"), F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("")).alias("key"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), text.alias("text"), F.md5(text.cast("binary")).alias("digest"),
    )


_ORDER = ["key", "turn", "role", "digest"]


def _judged(rows: DataFrame) -> DataFrame:
    """One row per key, turn, role and text: ``m`` copies, their kinds as
    ``letters`` and how many have each fault."""
    blank = ~F.col("text").rlike(rf"[^{_SPACE}]")
    cut = F.col("text").rlike(rf"[^.!?{_SPACE}][{_SPACE}]*\z")
    narrow = rows.select(*_ORDER, blank.alias("blank"), cut.alias("cut"))
    kinds = stage(narrow.groupBy(*_ORDER).agg(F.count("*").alias("m"), F.min("blank").alias("blank"), F.min("cut").alias("cut")), "kinds")
    earliest = stage(kinds.groupBy("key", "role", "digest").agg(F.min(F.struct("turn")).alias("earliest")), "earliest")
    both = kinds.join(earliest, ["key", "role", "digest"])
    repeat = ~F.col("turn").eqNullSafe(F.col("earliest.turn"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    kind = F.when(F.col("cut"), F.upper(kind)).otherwise(kind)
    gone = F.col("blank") | repeat
    return both.select(
        *_ORDER, "m", initial.alias("initial"),
        F.when(gone, F.repeat(F.lit("D"), F.col("m").cast("int"))).otherwise(F.concat(kind, F.repeat(F.lit("D"), F.col("m").cast("int") - 1))).alias("letters"),
        F.when(F.col("blank"), F.col("m")).otherwise(0).alias("n_blank"),
        F.when(F.col("blank"), 0).when(repeat, F.col("m")).otherwise(F.col("m") - 1).alias("n_duplicate"),
        F.when(gone | ~F.col("cut"), 0).otherwise(1).alias("n_truncated"),
    )


def _facts(keyed: DataFrame) -> DataFrame:
    """``key`` with the counts, cost and audit of each conversation."""
    judged = stage(_judged(keyed), "judged")
    turns = judged.groupBy("key", "turn").agg(*(F.sum(c).alias(c) for c in ("n_blank", "n_duplicate", "n_truncated")))
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    counts = turns.groupBy("key").agg(
        F.coalesce(gaps, F.lit(0)).alias("gaps"), F.sum("n_blank").alias("blank"), F.sum("n_duplicate").alias("duplicate"), F.sum("n_truncated").alias("truncated")
    )
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = judged.select(*_ORDER, "letters", "initial").repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER)
    segments = ordered.mapInArrow(_segments, _SEGMENT)  # ranges are numbered in order, so a long conversation's segments are too
    plans = segments.repartition("key").sortWithinPartitions("key", "part").mapInArrow(_plans, "key string, illegal long, cost long, audit string")
    return counts.join(plans, "key")


def _walk(batches):
    """Carry out the edits, row by row: first ``(facts, None)`` for a
    conversation, then ``(edit, (role, text))`` for its rows in order."""
    audit, at, ends = "", 0, ""
    turn = {"": "user", "s": "user", "a": "user", "u": "assistant"}

    def inserted():
        nonlocal at, ends
        while at < len(audit) and audit[at] == "I":
            role = turn[ends]
            at, ends = at + 1, role[0]
            yield "I", (role, "")

    for batch in batches:
        for facts, role, text in zip(*(batch.column(c).to_pylist() for c in ("facts", "role", "text"))):
            if facts is not None:
                yield from inserted()
                audit, at, ends = facts["audit"], 0, ""
                yield facts, None
                continue
            yield from inserted()
            edit = audit[at]
            at += 1
            if edit != "D":
                role = turn[ends] if edit == "R" else role
                ends = role[0]
                yield edit, (role, text)
        yield None, None  # the end of a batch
    yield from inserted()


def _rows(batches):
    """The repaired conversations."""
    facts, place, found = None, 0, []

    def out():
        key, edit, where, role, text = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(where, pa.int64()), pa.array(edit), pa.array(role), pa.array(text)], ["key", "place", "edit", "role", "text"])

    for edit, row in _walk(batches):
        if row is not None:
            place += 1
            found.append((facts["key"], edit, place, *row))
        elif edit is not None:
            facts, place = edit, 0
        elif found:
            yield out()
            found = []
    if found:
        yield out()


def _digests(batches):
    """The facts of each conversation, with the SHA-256 of its repaired lines."""
    facts, digest, lines, found, kind = None, None, 0, [], None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], kind), pa.array([d for _, d in found])], ["facts", "repaired_sha256"])

    def watched():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("facts").type
            yield batch

    for edit, row in _walk(watched()):
        if row is not None:
            digest.update((("\n" if lines else "") + ":".join(row)).encode())
            lines += 1
        elif edit is not None:
            if facts is not None:
                found.append((facts, digest.hexdigest()))
            facts, digest, lines = edit, hashlib.sha256(), 0
        elif found:
            yield out()
            found = []
    if facts is not None:
        found.append((facts, digest.hexdigest()))
    if found:
        yield out()


def _stream(keyed: DataFrame, facts: DataFrame) -> DataFrame:
    """Every conversation's facts and then its rows, in order. Texts of a
    conversation pass through one task, which keeps one batch of them."""
    first = facts.select("key", F.lit(0).alias("tag"), F.struct("key", *[c for c in facts.columns if c != "key"]).alias("facts"))
    rest = keyed.select("key", F.lit(1).alias("tag"), "turn", "role", "digest", "text")
    both = first.unionByName(rest, allowMissingColumns=True)
    return both.repartition("key").sortWithinPartitions("key", "tag", "turn", "role", "digest")


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, place, edit, role, text)``: the rows of every repaired
    conversation in order; ``edit`` is K (kept), R (new role) or I (inserted).

    Rows are taken by turn, nulls first, then role and text; a null role or
    text reads as one space, a null conversation is one of its own. Repeated
    rows are duplicates. An empty table gives none, as does a conversation
    whose cheapest repair deletes all. Other columns are ignored.
    """
    keyed = _keyed(rows, conv_col, turn_col, role_col, text_col)
    facts = stage(_facts(keyed), "facts")
    repaired = _stream(keyed, facts.select("key", "audit")).mapInArrow(_rows, "key string, place long, edit string, role string, text string")
    names = keyed.groupBy("key").agg(F.first("conv").alias(conv_col))
    return repaired.join(names, "key").select(conv_col, "place", "edit", "role", "text")


def repair_report(rows: DataFrame, conversations: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation of ``rows`` and of ``conversations`` (ids):
    ``gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``. Each row's first fault counts; one without rows has
    zeros. Nulls and ties as in :func:`repair_conversations`."""
    keyed = _keyed(rows, conv_col, turn_col, role_col, text_col)
    facts = _facts(keyed)
    ids = keyed.select("key", "conv")
    if conversations is not None:
        conv = F.col(conv_col)
        ids = ids.union(conversations.select(F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("")), conv))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    full = ids.groupBy("key").agg(F.first("conv").alias("conv")).join(facts, "key", "left")
    full = full.select("key", "conv", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"))
    stream = _stream(keyed, stage(full, "facts"))
    kind = stream.schema["facts"].dataType.simpleString()
    out = stream.select("facts", "role", "text").mapInArrow(_digests, f"facts {kind}, repaired_sha256 string")
    return out.select(F.col("facts.conv").alias(conv_col), *(f"facts.{c}" for c in (*numbers, "audit")), "repaired_sha256")


def damage(rows: DataFrame) -> DataFrame:
    """A fixed share of the rows of ``conversations``, by a checksum of
    conversation and turn, is dropped, emptied, cut, repeated or said by the user."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    die = F.crc32(F.concat(read("conv_id"), F.lit(":"), read("turn")).cast("binary")) % 20
    hurt = rows.select("conv_id", "turn", read("role").alias("role"), read("text").alias("text"), die.alias("die")).where("die <> 0")
    text = F.when(F.col("die") == 1, "").when(F.col("die") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("die") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("die") == 3, 2).otherwise(1)
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")
