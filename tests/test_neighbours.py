"""Nearest-member filtering against all pairs; the two scoring plans against each other."""
import math
import random

import pytest
from pyspark.sql import functions as F

from carelens.operators import neighbours

SCHEMA = "member_id long, condition_name string, chronic_flag string"


def panel():
    rng = random.Random(12)
    held = {m: {rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))}
            for m in range(1, 120)}
    held |= {200 + i: {"a"} for i in range(14)}            # a group of equal sets, larger than k
    held |= {300 + i: {"a", "b", "c"} for i in range(3)}
    held |= {400 + i: {"a", "b", chr(99 + i % 9), chr(100 + i % 11)} for i in range(60)}
    return {m: {(c, str(ord(c) % 2)) for c in s} for m, s in held.items()}


def brute(held, least, neighbours_, k):
    out = set()
    for m, own in held.items():
        near = []
        for u, other in held.items():
            both = len(own & other)
            if u != m and both * both >= least * least * len(own) * len(other) - 1e-9:
                near.append((-round(both / math.sqrt(len(own) * len(other)), 9), u))
        votes = {}
        for c, u in sorted(near)[:neighbours_]:
            for x in held[u] - own:
                votes[x] = votes.get(x, 0) - c
        best = sorted(votes.items(), key=lambda v: (-round(v[1], 9), v[0]))[:k]
        out |= {(m, *x, round(v, 6), r) for r, (x, v) in enumerate(best, 1)}
    return out


def rows(held):
    return [(m, *x) for m, s in held.items() for x in s]


@pytest.mark.parametrize("least,block", [(0.5, 512), (0.7, 5), (0.3, 3)])
def test_nearest_members_against_all_pairs(spark, monkeypatch, least, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    held = panel()
    known = spark.createDataFrame(rows(held) + rows(held)[:20], SCHEMA).repartition(5)
    got = {(r.member_id, r.condition_name, r.chronic_flag, round(r.score, 6), r.pred_rank)
           for r in neighbours.nearest_based(known, least, 8, 4).collect()}
    assert got == brute(held, least, 8, 4) and got


def test_nearest_members_of_none(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert neighbours.nearest_based(empty).collect() == []
    alone = spark.createDataFrame([(1, "a", "1"), (2, "b", "0")], SCHEMA)
    assert neighbours.nearest_based(alone).collect() == []


def test_dense_and_joined_scores_are_equal(spark, monkeypatch):
    known = spark.createDataFrame(rows(panel()), SCHEMA)
    for model in (neighbours.item_based, neighbours.user_based):
        for k in (3, None):
            def found():
                return sorted(tuple(r) for r in model(known, k).collect())
            monkeypatch.setattr(neighbours, "DENSE_ITEMS", 2_000)
            dense = found()
            monkeypatch.setattr(neighbours, "DENSE_ITEMS", 0)
            assert found() == dense and dense


def test_dense_sets_are_streamed_and_give_the_same_neighbours(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(m, f"c{c:02d}", "1") for m in range(150) for c in rng.sample(range(14), rng.randint(3, 9))]
    rows += [(m + 1000, c, f) for m, c, f in rows if m < 20] + [(5000, "c00", "1"), (5001, "z", "1")]
    known = spark.createDataFrame(rows, "member_id long, condition_name string, chronic_flag string")
    _, classes, items = neighbours._classes(known)
    assert not neighbours._prefixes_help(classes, items, 0.5)
    monkeypatch.setattr(neighbours, "HELD", (40, 50))

    def run():
        return sorted(map(tuple, neighbours.nearest_based(known, 0.5, 4, 5).collect()))

    monkeypatch.setattr(neighbours, "similar_classes", None)         # all pairs are not written
    streamed = run()
    kept = neighbours.nearest_classes(classes, 20, 0.5, 4).groupBy("a").count()
    assert kept.filter("count > 4").count() == 0 and kept.count() > 100
    monkeypatch.undo()
    monkeypatch.setattr(neighbours, "_prefixes_help", lambda *a: True)
    assert streamed == run()


def test_blocks_are_dealt_evenly_and_votes_are_added_by_class(spark, monkeypatch):
    rng = random.Random(7)
    held = {m: {(f"c{c:02d}", "1") for c in rng.sample(range(15), rng.randint(4, 9))}
            for m in rng.sample(range(10_000), 160)}                 # ids in no order, many ties
    known = spark.createDataFrame(rows(held), SCHEMA).repartition(3)
    _, classes, items = neighbours._classes(known)
    width = items.count()
    monkeypatch.setattr(neighbours, "HELD", (10, 10))
    monkeypatch.setattr(neighbours, "PACKED", 4)
    monkeypatch.setattr(neighbours, "TILE", 3)
    near = neighbours.nearest_classes(classes, width, 0.5, 4)
    part = near.select("a", F.spark_partition_id().alias("p")).distinct().groupBy("p").count()
    blocks = -(-classes.count() // 10)
    assert blocks > 12 and part.count() == blocks         # a task a block, none with two
    sets = {r["class"]: set(r["items"]) for r in classes.collect()}
    want = set()
    for a, x in sets.items():
        found = sorted((-round(len(x & y) / math.sqrt(len(x) * len(y)), 9), b)
                       for b, y in sets.items() if a != b and
                       len(x & y) ** 2 >= 0.25 * len(x) * len(y) - 1e-9)
        want |= {(a, b, -c) for c, b in found[:4]}
    assert {(r.a, r.b, round(r.cosine, 9)) for r in near.collect()} == want

    def run():
        return {(r.member_id, r.condition_name, r.chronic_flag, round(r.score, 6), r.pred_rank)
                for r in neighbours.nearest_based(known, 0.5, 4, 5).collect()}

    expected = brute(held, 0.5, 4, 5)
    monkeypatch.setattr(neighbours, "MAX_CELLS", 7 * (width + 1))
    monkeypatch.setattr(neighbours, "_joined_votes", None)           # votes are not exploded
    assert run() == expected and expected
    monkeypatch.undo()
    monkeypatch.setattr(neighbours, "DENSE_ITEMS", 0)
    assert run() == expected
