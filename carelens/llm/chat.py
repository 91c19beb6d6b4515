"""Chat formatting with minimum-cost role repair.

A legal conversation is [system] (user assistant)+. Each source turn keeps its role, takes another
(relabel), joins the turn before it (merge), or follows an inserted empty turn; the cheapest way
through the legal-turn automaton is found by dynamic programming and rendered.

The step of a turn is a small matrix over the automaton's states whose entries are (cost, turns
made), so a conversation is a product of matrices in the (min, +) semiring, which is associative:
conversations are cut into segments of bounded size, each segment multiplies its own matrices,
one small matrix a segment decides the states at the cuts, and each segment then decodes itself.
Rows are dealt by range over the full order of turns, so a conversation that holds any share of
all rows is spread over tasks.

Ties: least cost, then fewest turns, then keep before merge, relabel and insert.

Defined results: turns are ordered by turn (null last), role, text; repeated rows are turns of
their own; null and unknown roles are relabelled; null text is the empty text; rows without
conv_id form one conversation; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

ROLES = ("system", "user", "assistant")
STATES = ("start", *ROLES)      # the role of the last turn made
FOLLOWS = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",),
           "assistant": ("user",)}
MERGE, RELABEL, INSERT = 1, 3, 2
SEGMENT = 4_096                 # source turns of one conversation decoded together
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
NO_ID = -(1 << 63)
FAR = (1 << 40, 0)


def steps(role: str | None) -> list[tuple[int, int, int, int, str, tuple[str, ...]]]:
    """(from, to, cost, turns made, action, inserted roles) a source turn of ``role`` allows, in
    order of preference."""
    out = []
    for s, state in enumerate(STATES):
        for q, label in enumerate(ROLES, 1):
            change = 0 if label == role else RELABEL
            if label in FOLLOWS[state]:
                out.append((s, q, change, 1, "relabel" if change else "keep", ()))
            for between in FOLLOWS[state]:
                if label in FOLLOWS[between]:
                    out.append((s, q, change + INSERT, 2,
                                "insert+relabel" if change else "insert", (between,)))
        if s:
            change = 0 if state == role else RELABEL
            out.append((s, s, MERGE + change, 0, "merge+relabel" if change else "merge", ()))
    order = {"keep": 0, "merge": 1, "relabel": 2}
    return sorted(out, key=lambda x: (x[2], x[3], order.get(x[4], 3), x[0], x[1]))


def endings(state: int) -> tuple[int, tuple[str, ...]]:
    """Cost and inserted roles that make ``state`` a legal end."""
    need = {"start": ROLES[1:], "system": ROLES[1:], "user": ROLES[2:], "assistant": ()}
    added = need[STATES[state]]
    return INSERT * len(added), added


def product(a: list, b: list) -> list:
    """Matrices as rows of (cost, turns)."""
    n = len(STATES)
    return [[min((a[i][k][0] + b[k][j][0], a[i][k][1] + b[k][j][1]) for k in range(n))
             for j in range(n)] for i in range(n)]


def identity() -> list:
    return [[(0, 0) if i == j else FAR for j in range(len(STATES))] for i in range(len(STATES))]


def matrix(role: str | None) -> list:
    m = [[FAR] * len(STATES) for _ in STATES]
    for s, q, cost, made, *_ in steps(role):
        m[s][q] = min(m[s][q], (cost, made))
    return m


def decode(roles: list[str | None], entry: int, leave: int) -> list[tuple[int, str, tuple]]:
    """(state after, action, inserted roles) of each turn on the best way from entry to leave."""
    best = {entry: (0, 0)}
    back = []
    known = {r: steps(r) for r in set(roles)}
    for role in roles:
        nxt, how = {}, {}
        for s, q, cost, made, action, added in known[role]:
            if s in best:
                value = (best[s][0] + cost, best[s][1] + made)
                if q not in nxt or value < nxt[q]:
                    nxt[q], how[q] = value, (s, action, added)
        best = nxt
        back.append(how)
    out, state = [], leave
    for how in reversed(back):
        s, action, added = how[state]
        out.append((state, action, added))
        state = s
    return out[::-1]


def _grouped(batches, width: int):
    """Consecutive rows (lists) with equal first ``width`` values, across batches."""
    held, key = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:width] != key and held:
                yield key, held
                held = []
            key = row[:width]
            held.append(row)
    if held:
        yield key, held


def _known(role: str | None) -> str | None:
    role = (role or "").strip().lower()
    return role if role in ROLES else None


def _dealt(turns: DataFrame) -> DataFrame:
    """Turns in full order: (conv, seg, nr, turn, role, text); seg cuts a conversation into
    consecutive segments."""
    t = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"),
                     F.col("turn").cast("long").alias("turn"),
                     F.col("role").cast("string").alias("role"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("late", F.col("turn").isNull()).withColumn(
        "tie", F.monotonically_increasing_id())
    order = ["conv", "late", "turn", "role", "text", "tie"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    # the beginning of a text has its order, so ranges agree with the order by whole texts
    return materialize(
        t.withColumn("head", F.substring("text", 1, 64))
        .repartitionByRange(n, "conv", "late", "turn", "role", "head")
        .sortWithinPartitions(*order).withColumn("nr", place)
        .withColumn("seg", F.floor(F.col("nr") / SEGMENT))
        .select("conv", "seg", "nr", "turn", "role", "text"), "turns")


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, out_turn, part, turn, role, action, content, rendered): the pieces of the
    repaired conversations. A source turn is one piece, inserted turns and the end are pieces
    without a source turn. Joining ``rendered`` by (out_turn, part) gives the conversation."""
    dealt = _dealt(turns)

    def multiply(batches):
        known = {r: matrix(r) for r in (*ROLES, None)}
        out = []
        for (conv, seg), rows in _grouped(batches, 2):
            m = identity()
            for row in rows:
                m = product(m, known[_known(row[3])])
            out.append((conv, seg, [x for line in m for cell in line for x in cell]))
            if len(out) >= 10_000:
                yield table(out, segment)
                out = []
        yield table(out, segment)

    def choose(batches):
        n = len(STATES)
        out = []
        for (conv,), rows in _grouped(batches, 1):
            ms = [[[tuple(v[2 * (i * n + j):2 * (i * n + j) + 2]) for j in range(n)]
                   for i in range(n)] for _, _, v in rows]
            best, back = {0: (0, 0)}, []
            for m in ms:
                nxt, how = {}, {}
                for s in sorted(best):
                    for q in range(n):
                        value = (best[s][0] + m[s][q][0], best[s][1] + m[s][q][1])
                        if m[s][q] < FAR and (q not in nxt or value < nxt[q]):
                            nxt[q], how[q] = value, s
                best = nxt
                back.append(how)
            state = min(best, key=lambda s: (best[s][0] + endings(s)[0],
                                             best[s][1] + len(endings(s)[1]), s))
            cuts = [state]
            for how in reversed(back):
                state = how[state]
                cuts.append(state)
            cuts.reverse()
            made = 0
            for k, row in enumerate(rows):
                out.append((conv, row[1], cuts[k], cuts[k + 1], made, k == len(rows) - 1))
                made += ms[k][cuts[k]][cuts[k + 1]][1]
            if len(out) >= 10_000:
                yield table(out, cut)
                out = []
        yield table(out, cut)

    def render(batches):
        out = []
        for (conv, _), rows in _grouped(batches, 2):
            _, _, _, _, _, _, entry, leave, made, last = rows[0]
            roles = [_known(r[4]) for r in rows]
            now = made - 1

            def add(nr, turn, role, action, text, starts, part):
                head = (CLOSE if now > 0 else "") + OPEN + role + "\n" if starts else "\n"
                out.append((conv, now, part, turn, role, action, text, head + text))

            for row, (state, action, added) in zip(rows, decode(roles, entry, leave)):
                nr, turn, text = row[2], row[3], row[5]
                for role in added:
                    now += 1
                    add(nr, None, role, "inserted", "", True, 2 * nr)
                starts = not action.startswith("merge")
                now += starts
                add(nr, turn, STATES[state], action, text, starts, 2 * nr + 1)
            if last:
                nr = rows[-1][2]
                for k, role in enumerate(endings(leave)[1]):
                    now += 1
                    add(nr, None, role, "inserted", "", True, 2 * nr + 2 + k)
                out.append((conv, now, 2 * nr + 4, None, None, "end", "", CLOSE))
            if len(out) >= 5_000:
                yield table(out, piece)
                out = []
        yield table(out, piece)

    def table(rows, kinds):
        cols = list(zip(*rows)) if rows else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values())],
                                          list(kinds))

    whole, text = pa.int64(), pa.string()
    segment = {"conv": whole, "seg": whole, "m": pa.list_(whole)}
    cut = {"conv": whole, "seg": whole, "entry": whole, "leave": whole, "made": whole,
           "last": pa.bool_()}
    piece = {"conv_id": whole, "out_turn": whole, "part": whole, "turn": whole, "role": text,
             "action": text, "content": text, "rendered": text}
    own = ["conv", "seg", "nr"]
    small = (dealt.select(*own, "role").repartition("conv", "seg").sortWithinPartitions(*own)
             .mapInArrow(multiply, "conv long, seg long, m array<long>"))
    cuts = materialize(
        small.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(
            choose, "conv long, seg long, entry long, leave long, made long, last boolean"),
        "turn-cuts")
    joined = (dealt.select(*own, "turn", "role", "text").join(cuts, ["conv", "seg"])
              .select(*own, "turn", "role", "text", "entry", "leave", "made", "last")
              .repartition("conv", "seg").sortWithinPartitions(*own))
    out = joined.mapInArrow(
        render, "conv_id long, out_turn long, part long, turn long, role string, action string, "
                "content string, rendered string")
    return out.withColumn("conv_id", F.when(F.col("conv_id") != NO_ID, F.col("conv_id")))
