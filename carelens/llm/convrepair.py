"""Conversation structure repair by weighted CYK parsing of intervals.

The language is the sequences of role initials ``(s?(ua)+)?``. The repair grammar is in Chomsky
normal form: a nonterminal is the empty word or the first and last initial of what a span of source
turns becomes, a binary rule joins two neighbouring spans where the second may follow the first,
and a source turn becomes

* its own initial (Keep, 0), user or assistant (Rerole, 3) or the empty word (Delete, 4); a turn
  that is blank or a duplicate can only be deleted, one that is truncated and stays adds 3;
* inserted user or assistant turns (3 each) join either side: the insertion closure.

A cell keeps per nonterminal the least (cost, audit), audit being the edits' initials in order. No
audit of a span is a proper prefix of another one of equal cost (the rest would be insertions, which
cost), so the least audits of two parts make the least audit of the whole, and minima compose.

Spans are combined bottom-up by length. Up to BLOCK turns the whole chart is filled, every span
and every split; charts depend on the turns' kinds alone and are kept by them. Beyond that the
grammar makes one split enough: every word of a nonterminal can be cut at every place into words of
two nonterminals, and closed cells take in the insertions at the cut, so all splits of a span
give the same cell (the tests compare both). Blocks are therefore joined two by two, segments of
SEGMENT turns leave a task as one cell, and a conversation's cells meet in one task, which holds no
more than the conversation's own audit a few times. Turns are dealt by range over their order, so a
conversation with any share of all rows is spread over tasks up to there; applying its audit and
reading its turns in order is a stream through one task that holds one turn at a time.

Defined results: turns are ordered by turn (null first), role, text; null role or text is one space;
repeated rows are turns of their own (all but the first are duplicates); rows without conv_id form
one conversation; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
FOLLOWS = ("su", "ua", "au")
CLASSES = ("", "ss", "su", "sa", "uu", "ua", "au", "aa")
ACCEPTED = ("", "ua", "sa")
ROLE = {"u": "user", "a": "assistant"}
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
SPACE = " \t\n\x0b\x0c\r"
KINDS = "abcdefghijkl"          # 3 x (initial s, u, a, other) + (sound, to delete, truncated)
BLOCK = 8                       # turns of a full chart
SEGMENT = 4_096                 # turns of one conversation that leave a task as one cell
FLUSH_ROWS, FLUSH_CHARS = 4_000, 4 << 20


def _joined(x: str, y: str) -> str | None:
    """The nonterminal of a span of class ``x`` and the next one of class ``y``."""
    if not x or not y:
        return x or y
    return x[0] + y[1] if x[1] + y[0] in FOLLOWS else None


RULES = [(i, j, CLASSES.index(z)) for i, x in enumerate(CLASSES) for j, y in enumerate(CLASSES)
         if (z := _joined(x, y)) is not None]


def combine(left: tuple, right: tuple) -> tuple:
    """The cell of two neighbouring spans: (cost, audit) or None per class."""
    best: list = [None] * len(CLASSES)
    for i, j, k in RULES:
        a, b = left[i], right[j]
        if a is None or b is None:
            continue
        old, cost = best[k], a[0] + b[0]
        if old is None or cost < old[0] or cost == old[0] and a[1] + b[1] < old[1]:
            best[k] = (cost, a[1] + b[1])
    return tuple(best)


def least(one: tuple, two: tuple) -> tuple:
    return tuple(b if a is None or b is not None and b < a else a for a, b in zip(one, two))


INSERTED = tuple((INSERT, "I") if c in ("uu", "aa") else None for c in CLASSES)


def closure(cell: tuple) -> tuple:
    """``cell`` with inserted turns before and after, as long as that betters a class."""
    while True:
        more = least(least(cell, combine(INSERTED, cell)), combine(cell, INSERTED))
        if more == cell:
            return cell
        cell = more


@lru_cache(maxsize=None)
def terminal(kind: str) -> tuple:
    """The closed cell of one turn."""
    initial, state = divmod(KINDS.index(kind), 3)
    cell: dict = {"": (DELETE, "D")}
    if state != 1:
        more = TRUNCATED if state == 2 else 0
        cell["uu"] = cell["aa"] = (REROLE + more, "R")
        if initial < 3:
            cell["sua"[initial] * 2] = (more, "K")
    return closure(tuple(cell.get(c) for c in CLASSES))


@lru_cache(maxsize=50_000)
def chart(kinds: str) -> tuple:
    """The cell of a whole block: all spans by length, all splits."""
    n = len(kinds)
    cells = {(i, i + 1): terminal(k) for i, k in enumerate(kinds)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            best = (None,) * len(CLASSES)
            for cut in range(i + 1, i + length):
                best = least(best, combine(cells[i, cut], cells[cut, i + length]))
            cells[i, i + length] = best
    return cells[0, n]


def paired(cells: list) -> tuple:
    """One cell of consecutive ones, joined two by two."""
    while len(cells) > 1:
        cells = [combine(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i]
                 for i in range(0, len(cells), 2)]
    return cells[0]


def span_cell(kinds: str) -> tuple:
    return paired([chart(kinds[i:i + BLOCK]) for i in range(0, len(kinds), BLOCK)])


def cheapest(cell: tuple) -> tuple[int, str]:
    return min(x for c, x in zip(CLASSES, cell) if c in ACCEPTED and x is not None)


def _illegal(initials: str) -> int:
    return sum(initials[i:i + 2] not in FOLLOWS for i in range(len(initials) - 1))


def _initials(kinds: str) -> str:
    return "".join("suao"[KINDS.index(k) // 3] for k in kinds)


def conversation_key(conv_id: Column) -> Column:
    """Text of an id; empty for null."""
    return F.coalesce(conv_id.cast("string"), F.lit(""))


def ordered(turns: DataFrame) -> DataFrame:
    """(conv, nr, seg, turn, role, text, fault): the turns, ``nr`` rising in their order within a
    conversation, and each turn's first fault (blank, duplicate, truncated or null)."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = turns.select(conversation_key(F.col("conv_id")).alias("conv"),
                     F.col("turn").cast("long").alias("turn"),
                     F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                     F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    # the beginning of a text has its order, so ranges agree with the order by whole texts
    dealt = (t.withColumn("head", F.substring("text", 1, 64))
             .repartitionByRange(n, "conv", F.col("turn").asc_nulls_first(), "role", "head")
             .sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text"))
    body = F.rtrim("text", F.lit(SPACE))
    dealt = materialize(
        dealt.select("conv", F.monotonically_increasing_id().alias("nr"), "turn", "role", "text",
                     body.alias("body"))
        .select("conv", "nr", F.floor(F.col("nr") / SEGMENT).alias("seg"), "turn", "role", "text",
                (F.col("body") == "").alias("blank"),
                (~F.right("body", F.lit(1)).isin(".", "!", "?")).alias("open"),
                F.sha2("text", 256).alias("print")), "turns")
    first = (dealt.groupBy("conv", "role", "print")
             .agg(F.min("nr").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    fault = (F.when(F.col("blank"), "blank").when(F.col("nr") > F.col("first"), "duplicate")
             .when(F.col("open"), "truncated"))
    return dealt.join(first, ["conv", "role", "print"], "left").select(
        "conv", "nr", "seg", "turn", "role", "text", fault.alias("fault"))


def _table(rows: list, kinds: dict) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values())],
                                      list(kinds))


def parse(rows: DataFrame) -> DataFrame:
    """(conv, illegal, cost, audit) of every conversation of ``ordered`` turns: neighbours whose
    initials may not follow each other, and the cheapest repair."""
    place = F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1)).cast("int")
    initial = F.when(place > 0, place - 1).otherwise(3)
    state = (F.when(F.col("fault").isin("blank", "duplicate"), 1)
             .when(F.col("fault") == "truncated", 2).otherwise(0))
    kind = F.substring(F.lit(KINDS), initial * 3 + state + 1, F.lit(1))
    segments = (rows.select("conv", "seg", "nr", kind.alias("kind")).groupBy("conv", "seg")
                .agg(F.array_sort(F.collect_list(F.struct("nr", "kind"))).alias("at"))
                .select("conv", "seg", F.array_join(F.transform("at", lambda x: x["kind"]), "")
                        .alias("kinds")))
    cell = {"conv": pa.string(), "seg": pa.int64(), "edge": pa.string(), "illegal": pa.int64(),
            "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string())}

    def cells(batches):
        for batch in batches:
            out = []
            for conv, seg, kinds in zip(*(c.to_pylist() for c in batch.columns)):
                found, initials = span_cell(kinds), _initials(kinds)
                out.append((conv, seg, initials[0] + initials[-1], _illegal(initials),
                            [x and x[0] for x in found], [x and x[1] for x in found]))
            yield _table(out, cell)

    result = {"conv": pa.string(), "illegal": pa.int64(), "cost": pa.int64(),
              "audit": pa.string()}

    def meet(batches):
        conv, parts, illegal, edge, out = None, [], 0, "", []

        def settled():
            if conv is not None:
                out.append((conv, illegal, *cheapest(paired(parts))))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != conv:
                    settled()
                    conv, parts, illegal, edge = row[0], [], 0, ""
                illegal += row[3] + (bool(edge) and edge + row[2][0] not in FOLLOWS)
                edge = row[2][1]
                parts.append(tuple(None if c is None else (c, a) for c, a in zip(row[4], row[5])))
            if len(out) >= FLUSH_ROWS:
                yield _table(out, result)
                out.clear()
        settled()
        yield _table(out, result)

    return (segments.mapInArrow(cells, "conv string, seg long, edge string, illegal long, "
                                       "costs array<long>, audits array<string>")
            .repartition("conv").sortWithinPartitions("conv", "seg")
            .mapInArrow(meet, "conv string, illegal long, cost long, audit string"))


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, place, edit, turn, role, text): the turns of the repaired conversations, in order
    within each task, a conversation in one task. edit is K, R or I; inserted turns have no turn
    number and the empty text."""
    lines = rows.select("conv", "nr", "turn", "role", "text").unionByName(
        audits.select("conv", F.lit(-1).cast("long").alias("nr"), F.lit(None).cast("long")
                      .alias("turn"), F.lit(None).cast("string").alias("role"),
                      F.col("audit").alias("text")))
    made = {"conv": pa.string(), "place": pa.int64(), "edit": pa.string(), "turn": pa.int64(),
            "role": pa.string(), "text": pa.string()}

    def apply(batches):
        audit, at, last, place, out, size = "", 0, "", 0, [], 0
        for batch in batches:
            for conv, nr, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if nr < 0:
                    audit, at, last, place = text, 0, "", 0
                else:
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        role = ROLE[NEXT[last]] if edit == "R" else role
                        out.append((conv, place, edit, turn, role, text))
                        last, place, size = role[0], place + 1, size + len(text)
                while at < len(audit) and audit[at] == "I":
                    last = NEXT[last]
                    out.append((conv, place, "I", None, ROLE[last], ""))
                    at, place = at + 1, place + 1
                if len(out) >= FLUSH_ROWS or size >= FLUSH_CHARS:
                    yield _table(out, made)
                    out, size = [], 0
        yield _table(out, made)

    return (lines.repartition("conv").sortWithinPartitions("conv", "nr")
            .mapInArrow(apply, "conv string, place long, edit string, turn long, role string, "
                               "text string"))


def digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256) over ``role:text`` of ``repaired`` turns, joined by newlines."""
    kinds = {"conv": pa.string(), "sha256": pa.string()}

    def run(batches):
        conv, state, out = None, None, []
        for batch in batches:
            for c, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                if c != conv:
                    if state is not None:
                        out.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:".encode())
                state.update(text.encode())
            if len(out) >= FLUSH_ROWS:
                yield _table(out, kinds)
                out = []
        if state is not None:
            out.append((conv, state.hexdigest()))
        yield _table(out, kinds)

    return turns.select("conv", "role", "text").mapInArrow(run, "conv string, sha256 string")


def faults(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated) of every conversation of ``ordered`` turns."""
    def number(name):
        return F.sum((F.col("n") * (F.coalesce(F.col("fault"), F.lit("")) == name).cast("long")))
    # turns first, so that a conversation of any size is summed in its tasks
    by_turn = rows.groupBy("conv", "turn", "fault").agg(F.count("*").alias("n"))
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    return by_turn.groupBy("conv").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"),
        *(number(x).cast("long").alias(x) for x in ("blank", "duplicate", "truncated")))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of the conversations and
    the repaired turns (conv, place, edit, turn, role, text); conv is ``conversation_key``."""
    rows = materialize(ordered(turns), "ordered-turns")
    audits = materialize(parse(rows), "audits")
    return faults(rows).join(audits, "conv"), repaired(rows, audits)


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): every row damaged by the checksum of ``conv_id:turn``."""
    def spaced(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    t = turns.select(hit.alias("hit"), "conv_id", F.col("turn").cast("long").alias("turn"),
                     spaced("role").alias("role"), spaced("text").alias("text")).filter("hit <> 0")
    text = (F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")))
    return t.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
                    .alias("role"), text.alias("text"),
                    F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1)))
                              .otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def damage_and_repair(turns: DataFrame) -> DataFrame:
    """The digest of every conversation of ``turns`` after damage and repair."""
    found, fixed = repair(damaged(turns))
    prints = digests(fixed)
    ids = turns.select(conversation_key(F.col("conv_id")).alias("conv")).distinct()
    kind = turns.schema["conv_id"].dataType
    zero = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return (ids.join(found, "conv", "left").join(prints, "conv", "left").select(
        F.when(F.col("conv") != "", F.col("conv")).cast(kind).alias("conv_id"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")))
