"""The multi-index: recall against brute force, exact scores and order, awkward vectors."""
import numpy as np
from pyspark.sql import functions as F

from carelens.llm import ann

SCHEMA = "vec_id long, embedding array<float>, c1 int, salt int, query string"


def exact(rows, k):
    good = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        if len(v) == 8:
            v = np.float32(v).astype(float).tolist()
            good[i] = min(good.get(i, v), v)
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for a, i in enumerate(ids):
        s = (x * x[a]).sum(1) / (norm * norm[a])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def vectors():
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]         # a group of equal vectors
    rows += [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [1.0] * 7 + [None]),
             (2004, [float("nan")] * 8), (2005, [float("inf")] * 8), (None, [1.0] * 8),
             (2006, [1.0] * 5), (10, rows[11][1]), (2007, [1e-30] * 8)]
    return rows


def run(spark, rows, is_query, k, share):
    df = spark.createDataFrame([(*r, 1, 2, "q") for r in rows], SCHEMA).repartition(3)
    got = {}
    for r in ann.nearest(df, is_query, k, share).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return got


def test_whole_share_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    want = exact(vectors(), 5)
    got = run(spark, vectors(), F.col("vec_id") % 7 == 0, 5, 1.0)
    assert got.keys() == {i for i in want if i % 7 == 0}
    for q, rows in got.items():
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5]
        assert [r[1] for r in rows] == [x[0] for x in want[q]]
        assert np.allclose([r[2] for r in rows], [x[1] for x in want[q]], rtol=0, atol=1e-12)


def test_recall_on_the_supplied_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    x = np.array([r[1] for r in rows])
    ids = np.array([r[0] for r in rows])
    norm = np.sqrt((x * x).sum(1))
    met = total = 0
    got = ann.nearest(df, F.col("vec_id") % 50 == 0).collect()
    for q in ids[ids % 50 == 0]:
        a = int(np.flatnonzero(ids == q)[0])
        s = x @ x[a] / norm / norm[a]
        s[a] = -9
        best = set(ids[np.argsort(-s)[:5]].tolist())
        met += len(best & {r["vec_id"] for r in got if r["query_id"] == q})
        total += 5
    assert met / total >= 0.9


def test_the_share_follows_the_structure_of_the_vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16)) * 4
    near = [(i, (centres[i % 40] + rng.normal(size=16) * 0.2).tolist()) for i in range(2000)]
    loose = [(i, rng.normal(size=16).tolist()) for i in range(2000)]
    got = {}
    for name, rows in (("near", near), ("loose", loose)):
        x = ann._unit(np.array([r[1] for r in rows]))
        books = ann.codebook(x[:, :8]), ann.codebook(x[:, 8:])
        c1, c2 = (ann._distances(h, b).argmin(1) for h, b in zip((x[:, :8], x[:, 8:]), books))
        occupied = np.zeros((len(books[0]), len(books[1])), np.int64)
        np.add.at(occupied, (c1, c2), 1)
        index = spark.createDataFrame(
            [(i, v, int(a), int(b)) for (i, v), a, b in zip(rows, c1, c2)],
            "vec_id long, embedding array<double>, c1 int, c2 int").repartition(3)
        share = ann.measured_share(index, F.col("vec_id") % 10 == 0, books, occupied, 8, 5)
        got[name] = share
        need = int(np.ceil(share * (occupied > 0).sum()))
        met = total = 0
        d1, d2 = ann._distances(x[:, :8], books[0]), ann._distances(x[:, 8:], books[1])
        for q in range(0, 2000, 10):
            s = x @ x[q]
            s[q] = -9
            mask = ann.walk(d1[q], d2[q], occupied, need)
            best = np.argsort(-s)[:5]
            met += sum(int(mask[c1[j]]) >> int(c2[j]) & 1 for j in best)
            total += 5
        assert 0.95 <= met / total < 0.97
    assert got["near"] < got["loose"], got


def test_few_and_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(none, F.col("vec_id") == 0).collect() == []
    three = run(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], F.col("vec_id") == 0,
                5, 1.0)
    assert [r[1] for r in three[0]] == [1, 2]


def test_small_tables_give_all_or_k_at_the_default_share(spark):
    rng = np.random.default_rng(4)
    for n in (3, 5, 8):
        rows = [(i, rng.normal(size=8).tolist()) for i in range(n)]
        got = run(spark, rows, F.col("vec_id") >= 0, 5, ann.SHARE)
        assert {q: len(r) for q, r in got.items()} == dict.fromkeys(range(n), min(5, n - 1))
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.3])] + [(i, [-1.0, 0.1]) for i in range(2, 300)]
    got = run(spark, rows, F.col("vec_id") < 3, 5, ann.SHARE)
    assert [r[1] for r in got[0]] == [1, 2, 3, 4, 5]
    assert {q: len(r) for q, r in got.items()} == {0: 5, 1: 5, 2: 5}


def test_walk_follows_summed_distance():
    rng = np.random.default_rng(1)
    d1, d2 = rng.random(9), rng.random(7)
    occupied = rng.integers(0, 2, (9, 7))
    order = np.argsort((d1[:, None] + d2[None]).ravel(), kind="stable")
    for need in (1, 5, int(occupied.sum())):
        cells = [c for c in order if occupied.ravel()[c]][:need]
        mask = ann.walk(d1, d2, occupied, need)
        got = {(i, j) for i in range(9) for j in range(7) if int(mask[i]) >> j & 1}
        assert got == {(c // 7, c % 7) for c in cells}
