"""Conversation repair against a shortest-path search and full charts."""
import hashlib
import itertools
import random
import zlib
from heapq import heappop, heappush

from carelens.llm import convrepair as cr

SCHEMA = "conv_id long, turn long, role string, text string, conv string, nr string, kind string"
AFTER = {"": "su", "s": "u", "u": "a", "a": "u"}


def search(turns):
    """Cheapest (cost, audit) by uniform-cost search over (turns read, last initial)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(turns) and last in ("", "a"):
            return cost, audit
        for x in AFTER[last]:
            if x != "s":
                heappush(heap, (cost + 3, audit + "I", i, x))
        if i < len(turns):
            initial, fault = turns[i]
            heappush(heap, (cost + 4, audit + "D", i + 1, last))
            if fault != "x":
                more = 3 * (fault == "t")
                for x in AFTER[last]:
                    if x == initial:
                        heappush(heap, (cost + more, audit + "K", i + 1, x))
                    if x != "s":
                        heappush(heap, (cost + 3 + more, audit + "R", i + 1, x))


def kinds(turns):
    return "".join(cr.KINDS["suao".index(i) * 3 + " xt".index(f)] for i, f in turns)


ALL = list(itertools.product("suao", " xt"))


def test_short_conversations_all_kinds():
    for n in (1, 2, 3):
        for turns in itertools.product(ALL, repeat=n):
            assert cr.cheapest(cr.chart(kinds(turns))) == search(turns), turns


def test_long_spans_need_one_split():
    rng = random.Random(3)
    for n in (5, 9, 17, 23, 40):
        for _ in range(12):
            turns = [rng.choice(ALL) for _ in range(n)]
            assert cr.cheapest(cr.span_cell(kinds(turns))) == search(turns)
    for _ in range(6):
        k = kinds([rng.choice(ALL) for _ in range(14)])
        whole = cr.chart.__wrapped__(k)
        assert whole == cr.span_cell(k) == cr.closure(whole)
        assert all(cr.combine(cr.span_cell(k[:c]), cr.span_cell(k[c:])) == whole
                   for c in range(1, 14))


def rows():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "User", "tool", "", None]
    texts = ["Hi.", "What now?", "open end", "", " \t\n", None, "Same text!", "x " * 900 + "."]
    out = []
    for conv in range(60):
        for turn in range(rng.randint(1, 12)):
            out.append((conv, rng.choice([turn, turn, turn, turn + 40, None]),
                        rng.choice(roles[:2] if rng.random() < .7 else roles), rng.choice(texts)))
    out += [(90, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(700)]
    out += [(91, 1, "user", "Again.")] * 40
    out += [(None, None, None, None), (None, 4, "user", "Lost."), (None, 2, "assistant", "é。")]
    out += [(c, 1, "user", "One.") for c in range(100, 160)]
    return out


def brute(source):
    out = []
    by = {}
    for conv, turn, role, text in source:
        kept = by.setdefault(conv, [])
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        hit = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 1:
            text = ""
        if hit == 2:
            text = "".join(c for c in text if c not in ".!?")
        if hit == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    for conv, kept in by.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in kept:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = ("blank" if not body else "duplicate" if (role, text) in seen else
                     "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
            if fault:
                n[fault] += 1
            initial = role[:1] if role[:1] in tuple("sua") else "o"
            turns.append((initial, {None: " ", "truncated": "t"}.get(fault, "x")))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit = search(turns)
        nrs = {r[0] for r in kept if r[0] is not None}
        gaps = max(nrs) - min(nrs) + 1 - len(nrs) if nrs else 0
        lines, last, it = [], "", iter(kept)
        for e in audit:
            if e == "I":
                role, text = {"u": "user", "a": "assistant"}[AFTER[last][-1]], ""
            else:
                _, role, text = next(it)
                if e == "D":
                    continue
                if e == "R":
                    role = {"u": "user", "a": "assistant"}[AFTER[last][-1]]
            lines.append(f"{role}:{text}")
            last = role[0]
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
           "repaired_sha256"]


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in cr.damage_and_repair(df).collect()),
                  key=repr)


def table(spark, source, parts):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in source], SCHEMA).repartition(parts)


def test_whole_conversations(spark):
    source = rows()
    want = brute(source)
    assert any(w[7] == "" for w in want)
    assert result(table(spark, source, 4)) == want


def test_segments_and_partitions(spark, monkeypatch):
    monkeypatch.setattr(cr, "SEGMENT", 5)
    monkeypatch.setattr(cr, "FLUSH_ROWS", 3)
    source = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert result(table(spark, source, 7)) == brute(source)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_repaired_turns_are_legal(spark):
    source = rows()
    _, fixed = cr.repair(spark.createDataFrame([(*r, "a", "b", "c") for r in source], SCHEMA))
    by = {}
    for r in fixed.collect():
        by.setdefault(r["conv"], []).append(r)
    for turns in by.values():
        turns.sort(key=lambda r: r["place"])
        assert [r["place"] for r in turns] == list(range(len(turns)))
        initials = "".join(r["role"][0] for r in turns).removeprefix("s")
        assert initials and initials == "ua" * (len(initials) // 2)
        assert all(r["text"] == "" and r["turn"] is None for r in turns if r["edit"] == "I")


def test_empty_table(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []
