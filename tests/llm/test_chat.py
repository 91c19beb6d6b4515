"""Role repair against the cheapest of all repairs, found by search over all of them."""
import random
from collections import defaultdict
from functools import cache

from carelens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, key string, seg string"


def cheapest(roles):
    """Least (cost, turns) over every sequence of actions."""

    @cache
    def best(i, state):
        if i == len(roles):
            cost, added = chat.endings(chat.STATES.index(state))
            return cost, len(added)
        found = []
        for label in chat.ROLES:
            change = 0 if label == roles[i] else chat.RELABEL
            ways = []
            if label in chat.FOLLOWS[state]:
                ways.append((change, 1, label))
            for between in chat.FOLLOWS[state]:
                if label in chat.FOLLOWS[between]:
                    ways.append((change + chat.INSERT, 2, label))
            if state == label:
                ways.append((change + chat.MERGE, 0, state))
            for cost, made, after in ways:
                c, m = best(i + 1, after)
                found.append((c + cost, m + made))
        return min(found)

    return best(0, "start")


def rows():
    rng = random.Random(4)
    pool = ["user", "assistant", "system", "User ", "tool", None]
    out = []
    for conv in range(30):
        for turn in range(rng.randint(1, 9)):
            out.append((conv, turn, rng.choice(pool), rng.choice(["hi", "", None, "x " * 50]),
                        "k", "s"))
    out += [(50, t, ["user", "assistant"][t % 2], f"t{t}", "k", "s") for t in range(300)]
    out += [(None, None, "user", "lost", "k", "s"), (None, 3, "user", "kept", "k", "s")]
    out += [(60, 1, "user", "same", "k", "s")] * 3
    return out


def check(spark):
    source = rows()
    got = chat.repair(spark.createDataFrame(source, SCHEMA).repartition(4)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["conv_id"]].append(r)
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in source:
        turns[conv].append((turn is None, turn or 0, role is not None, role or "", text or ""))
    assert by.keys() == turns.keys()
    price = {"keep": 0, "insert": 0, "merge": chat.MERGE, "relabel": chat.RELABEL,
             "inserted": chat.INSERT, "end": 0, "merge+relabel": chat.MERGE + chat.RELABEL,
             "insert+relabel": chat.RELABEL}
    for conv, parts in by.items():
        parts.sort(key=lambda r: (r["out_turn"], r["part"]))
        roles = [chat._known(t[3] if t[2] else None) for t in sorted(turns[conv])]
        cost, made = cheapest(tuple(roles))
        assert sum(price[r["action"]] for r in parts) == cost
        seen = {r["out_turn"]: r["role"] for r in parts if r["action"] != "end"}
        assert sorted(seen) == list(range(made))
        chain = [seen[i] for i in range(made)]
        if chain[0] == "system":
            chain = chain[1:]
        assert chain == ["user", "assistant"] * (len(chain) // 2) and chain
        assert [r["content"] for r in parts if r["action"] not in ("inserted", "end")] == \
            [t[4] for t in sorted(turns[conv])]
        text = "".join(r["rendered"] for r in parts)
        assert text.count(chat.OPEN) == text.count(chat.CLOSE) == made
        assert text.startswith(chat.OPEN) and text.endswith(chat.CLOSE)


def test_whole_conversations(spark):
    check(spark)


def test_conversations_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 3)
    check(spark)


def test_order_of_equal_turns_does_not_depend_on_partitions(spark):
    texts = [f"t{i:02d}" + "x" * (100 * (i % 3)) for i in range(40)]
    source = [(1, 1, "user", t, "k", "s") for t in texts] + \
        [(2, 1, "user", "same start " * 9 + t, "k", "s") for t in texts]
    random.Random(3).shuffle(source)
    for n in (1, 8, 211):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            got = chat.repair(spark.createDataFrame(source, SCHEMA).repartition(6)).filter(
                "turn is not null").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        for conv in (1, 2):
            own = sorted((r["out_turn"], r["part"], r["content"]) for r in got
                         if r["conv_id"] == conv)
            assert [x[2] for x in own] == sorted(r[3] for r in source if r[0] == conv)


def test_empty_table(spark):
    assert chat.repair(spark.createDataFrame([], SCHEMA)).collect() == []
