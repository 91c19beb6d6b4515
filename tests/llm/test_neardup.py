"""Near duplicates against all pairs of full sets."""
import re
from itertools import combinations

import numpy as np

from carelens.llm import neardup

from .samples import DOC_SCHEMA, documents, prose, with_clashes
from .test_graphs import union_find


def word_set(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1))


def brute(rows, width):
    sets = [(i, word_set(t, width)) for i, t in rows]
    links = [(i, i) for i, _ in rows if i is not None]      # rows of one id are one node
    for (i, a), (j, b) in combinations([x for x in sets if x[0] is not None and x[1]], 2):
        if 100 * len(a & b) >= 80 * len(a | b):
            links.append((i, j))
    comp = union_find(links)
    return sorted(((i, len(s), comp.get(i), i == comp.get(i)) for i, s in sets), key=repr)


def test_against_all_pairs(spark):
    rows = documents()
    for width in (4, 5):
        got = neardup.near_duplicates(with_clashes(spark, rows, DOC_SCHEMA), width).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute(rows, width)


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], DOC_SCHEMA)).collect() == []


def test_sequential_test_keeps_similar_pairs_and_prunes_others():
    rng = np.random.default_rng(1)
    n = 4000
    left = rng.integers(0, 1 << 16, (n, neardup.HASHES)).astype(np.uint16)
    own = np.arange(n)
    steps = neardup.least_matches(0.8, neardup.HASHES, 16)
    for similarity, most, least in ((0.8, n, n), (0.9, n, n), (0.3, 0, 0)):
        same = rng.random(left.shape) < similarity
        right = np.where(same, left, left + 1).astype(np.uint16)
        kept = len(neardup.survivors(left, right, own, own, steps))
        assert least <= kept <= most


def test_large_bucket_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = documents()
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOC_SCHEMA), 4).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 4)


def test_rows_that_share_an_id_but_not_the_text(spark):
    a, c = prose(50, 200), prose(51, 220)
    rows = [(5, a), (5, c), (1, a + " more"), (2, c + " more"), (7, ""), (7, a), (8, None),
            (8, prose(52, 90)), (9, prose(52, 90) + " end"), (None, a), (11, prose(53, 50))]
    for parts in (1, 4):
        got = neardup.near_duplicates(
            spark.createDataFrame(rows, DOC_SCHEMA).repartition(parts), 4).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 4)
    by = {(r["doc_id"], r["component_id"]) for r in got}
    assert {(1, 1), (2, 1), (5, 1), (7, 1), (8, 8), (9, 8)} <= by


def test_links_of_a_block_join_what_all_its_pairs_join():
    rng = np.random.default_rng(4)
    base = rng.permutation(400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    # sets around the threshold of 0.8, several components to begin with
    sets = [np.sort(base[rng.random(400) < q]) for q in rng.choice([0.86, 0.89, 0.93], 60)]
    sizes = np.array([len(x) for x in sets])
    sig = neardup.signatures(np.concatenate(sets), sizes, neardup.LONG).astype(np.uint8)
    rep = rng.permutation(1000)[:60]
    comp = rep.copy()
    comp[30:45] = 2000                      # the main component: right members only
    left = np.arange(60) < 30
    bands = np.zeros((60, neardup.BANDS), np.int64)
    band = np.zeros(60, np.int64)
    steps = neardup.least_matches(0.8, neardup.LONG, 8)
    found = neardup._links_of_block(left, rep, comp, band, bands, sig, sets, steps, 80, 100)
    ok = {(i, j): 100 * len(set(p.tolist()) & set(q.tolist()))
          >= 80 * len(set(p.tolist()) | set(q.tolist()))
          for i, p in enumerate(sets) for j, q in enumerate(sets)}
    at = {int(r): k for k, r in enumerate(rep)}
    assert found and all(ok[at[a], at[b]] for a, b in found)
    all_pairs = [(int(comp[i]), int(comp[j])) for i in range(30) for j in range(30, 60) if ok[i, j]]
    told = [(int(comp[at[a]]), int(comp[at[b]])) for a, b in found]
    nodes = [(int(c), int(c)) for c in comp]
    assert union_find(nodes + all_pairs) == union_find(nodes + told)
    # a forest: no link more than joins
    assert len(told) < len(set(comp.tolist())) <= len(all_pairs)
    # pairs that met in an earlier bucket are left to it
    assert not neardup._links_of_block(left, rep, comp, band + 1, bands, sig, sets, steps, 80, 100)


def test_pairs_of_a_block_unless_they_are_many(monkeypatch):
    sig = np.zeros((6, neardup.LONG), np.uint8)
    sig[5] = 1
    left, rep = np.arange(6) < 3, np.array([7, 3, 9, 1, 8, 2])
    bands, band = np.zeros((6, neardup.BANDS), np.int64), np.zeros(6, np.int64)
    steps = neardup.least_matches(0.8, neardup.LONG, 8)
    comp = np.array([7, 3, 9, 1, 9, 2])
    a, b = neardup._pairs_of_block(left, rep, comp, band, bands, sig, steps)
    assert sorted(zip(a.tolist(), b.tolist())) == [(3, 1), (7, 1), (8, 3), (8, 7), (9, 1)]
    monkeypatch.setattr(neardup, "PAIRS", 0.5)
    assert neardup._pairs_of_block(left, rep, comp, band, bands, sig, steps) is None
    a, b = neardup._pairs_of_block(left, rep, comp, band + 1, bands, sig, steps)
    assert not len(a) and not len(b)


def test_blocks_are_bounded_by_shingles_and_verify_themselves(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHINGLES", 300)
    monkeypatch.setattr(neardup, "PAIRS", 0)
    rows = documents()
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOC_SCHEMA), 4).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 4)


def test_templates_around_the_threshold(spark):
    """A large group of filled-in templates, many pairs just over and many just below 0.8."""
    rng = np.random.default_rng(12)
    words = prose(77, 120).split()
    rows = []
    for i in range(150):
        own = list(words)
        for k in rng.choice(len(own), int(rng.integers(1, 5)), replace=False):
            own[k] = f"w{rng.integers(1 << 30)}"
        rows.append((int(rng.integers(1 << 40)), " ".join(own)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOC_SCHEMA), 4).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 4)
    assert 1 < sum(r["kept"] for r in got) < 150
