"""Approximate nearest neighbours by an inverted multi-index.

Each half of the (normalised) vectors has its own codebook; a vector's cell is the pair of its
nearest centroids. A query walks the centroid pairs in order of summed distance, with a heap over
the two sorted distance lists, until it has visited its share of the occupied cells and ``k`` vectors
besides itself, and the vectors of these cells are reranked by exact cosine in double precision.

The share is measured, not set: ``PROBES`` of the queries (the first by hash order) are compared
with every vector, and the share is the smallest that visits the cells of ``RECALL`` of their true
neighbours. It falls with the structure of the vectors and, as neighbours draw nearer, with their
number; a table without structure needs a large one.

The codebooks are fitted on at most ``SAMPLE`` vectors (the first by hash order); every vector is
indexed. The occupied cells (at most ``CENTROIDS``^2, whatever the input) are the only corpus
statistic on the driver. Index rows meet queries in blocks: a first-half centroid's vectors are
dealt over as many salted blocks of about ``BLOCK`` vectors as their count asks for, queries over
blocks of about ``BLOCK`` too, so a cell that holds any share of all vectors is split.

Defined results: vectors that are null, empty, zero, hold null or non-finite components or have
another length than the commonest take no part, nor do rows without vec_id; rows that repeat a
vec_id are one vector (the smallest); equal scores rank the smaller vec_id first; with fewer than
``k`` candidates all are returned; other columns take no part.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CENTROIDS = 64
SAMPLE = 20_000
ROUNDS = 15
SHARE = None                    # of the occupied cells; None: measured on the probes
PROBES = 400
RECALL = 0.95
BLOCK = 8_192
TIE = 1e-9                      # slack within which BLAS scores are recomputed row by row


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the vectors that take part."""
    v = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                        F.col("embedding").cast("array<double>").alias("embedding"))
         .filter("vec_id is not null and embedding is not null and size(embedding) > 0")
         .filter("forall(embedding, x -> x is not null and not isnan(x) "
                 "and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"))
    return materialize(v.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T


def codebook(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """k-means centroids; seeds are spread rows of the hash-ordered sample, empty cells keep
    theirs."""
    x0 = np.unique(x, axis=0)
    k = min(k, len(x0))
    c = x0[np.random.default_rng(7).permutation(len(x0))[:k]].copy()
    for _ in range(rounds):
        near = _distances(x, c).argmin(1)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def walk(d1: np.ndarray, d2: np.ndarray, occupied: np.ndarray, need: int,
         rows: int = 0) -> np.ndarray:
    """Per first-half centroid the bits of the second-half centroids visited: pairs in order of
    summed distance until ``need`` occupied cells that hold ``rows`` vectors have been met."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    o1, o2 = o1.tolist(), o2.tolist()
    filled = occupied.tolist()
    mask = [0] * len(s1)
    heap, depth, met, held = [(s1[0] + s2[0], 0, 0)], 0, 0, 0
    while heap and (met < need or held < rows):
        _, i, j = heapq.heappop(heap)
        if filled[o1[i]][o2[j]]:
            mask[o1[i]] |= 1 << o2[j]
            met += 1
            held += filled[o1[i]][o2[j]]
        if j + 1 < len(s2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i == depth and i + 1 < len(s1):
            depth += 1
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return np.array([m - (1 << 64) if m >= 1 << 63 else m for m in mask], np.int64)


def _cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors get equal scores wherever they are stored."""
    return (q * v).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1)))


def measured_share(index: DataFrame, is_query: Column, books, occupied: np.ndarray, half: int,
                   k: int, recall: float = RECALL) -> float:
    """The smallest share of the occupied cells, in the order of a walk, that holds ``recall`` of
    the ``k`` true neighbours of the probes. A task keeps ``k`` vectors a probe."""
    probes = (index.filter(is_query).orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id")
              .limit(PROBES).select("vec_id", "embedding").collect())
    if not probes:
        return 1.0
    ids = np.array([r["vec_id"] for r in probes])
    unit = _unit(np.array([r["embedding"] for r in probes]))
    sent = index.sparkSession.sparkContext.broadcast((ids, unit))

    def best(batches):
        own, x = sent.value
        score = np.full((len(own), k), -np.inf)
        cell = np.full((len(own), k), -1)
        for pdf in batches:
            if not len(pdf):
                continue
            near = x @ _unit(np.stack(pdf["embedding"].to_numpy())).T
            near[own[:, None] == pdf["vec_id"].to_numpy()[None]] = -np.inf
            at = pdf["c1"].to_numpy().astype(np.int64) * occupied.shape[1] + pdf["c2"].to_numpy()
            score = np.concatenate([score, near], 1)
            cell = np.concatenate([cell, np.broadcast_to(at, near.shape)], 1)
            top = np.argpartition(-score, k - 1, axis=1)[:, :k]
            score, cell = np.take_along_axis(score, top, 1), np.take_along_axis(cell, top, 1)
        probe, j = np.nonzero(np.isfinite(score))
        yield pd.DataFrame({"probe": probe, "score": score[probe, j], "cell": cell[probe, j]})

    order = Window.partitionBy("probe").orderBy(F.desc("score"), "cell")
    true = (index.select("vec_id", "embedding", "c1", "c2")
            .mapInPandas(best, "probe long, score double, cell long")
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("probe", "cell").collect())                 # PROBES x k rows at most
    if not true:
        return 1.0
    filled = np.flatnonzero(occupied.ravel())
    d1, d2 = _distances(unit[:, :half], books[0]), _distances(unit[:, half:], books[1])
    place = np.empty((len(probes), occupied.size), np.int64)
    for i in range(len(probes)):
        far = (d1[i][:, None] + d2[i][None]).ravel()[filled]
        place[i, filled[np.argsort(far, kind="stable")]] = np.arange(len(filled))
    met = np.sort([place[r["probe"], r["cell"]] + 1 for r in true])
    return float(met[int(np.ceil(recall * len(met))) - 1] / len(filled))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5,
            share: float | None = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` nearest vectors found, in ``share`` of
    the occupied cells or, without it, in the measured share."""
    spark = vectors.sparkSession
    result = "query_id long, vec_id long, score double"
    v = clean(vectors)
    widths = v.groupBy(F.size("embedding").alias("w")).count().orderBy(
        F.desc("count"), "w").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = widths[0]["w"]
    v = v.filter(F.size("embedding") == width)
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
    x = _unit(np.array([r[0] for r in sample]))
    half = max(1, width // 2)
    books = spark.sparkContext.broadcast(
        (codebook(x[:, :half]), codebook(x[:, half:]) if width > 1 else np.zeros((1, 0))))

    def encode(batches):
        c1, c2 = books.value
        for pdf in batches:
            if len(pdf):
                u = _unit(np.stack(pdf["embedding"].to_numpy()))
                pdf = pdf.assign(c1=_distances(u[:, :half], c1).argmin(1).astype(np.int32),
                                 c2=_distances(u[:, half:], c2).argmin(1).astype(np.int32))
                yield pdf

    kinds = "vec_id long, embedding array<double>, c1 int, c2 int"
    index = materialize(v.mapInPandas(encode, kinds), "multi-index")
    cells = index.groupBy("c1", "c2").count().collect()         # CENTROIDS^2 rows at most
    occupied = np.zeros((len(books.value[0]), len(books.value[1])), np.int64)
    for r in cells:
        occupied[r["c1"], r["c2"]] = r["count"]
    if share is None:
        share = measured_share(index, is_query, books.value, occupied, half, k)
    need = max(1, int(np.ceil(share * len(cells))))
    blocks = np.maximum(1, -(-occupied.sum(1) // BLOCK))
    asked = index.filter(is_query)
    q_blocks = max(1, -(-asked.count() // BLOCK))
    table = spark.sparkContext.broadcast((occupied, blocks))

    def visit(batches):
        c1, c2 = books.value
        occ, salts = table.value
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["embedding"].to_numpy())
            u = _unit(x)
            d1, d2 = _distances(u[:, :half], c1), _distances(u[:, half:], c2)
            out = []
            for i, (qid, vec) in enumerate(zip(pdf["vec_id"], pdf["embedding"])):
                for a, m in enumerate(walk(d1[i], d2[i], occ, need, k + 1).tolist()):
                    if m:
                        out.extend((qid, vec, a, s, m) for s in range(salts[a]))
            yield pd.DataFrame(out, columns=["query_id", "query", "c1", "salt", "mask"])

    visits = (asked.select("vec_id", "embedding").mapInPandas(
        visit, "query_id long, query array<double>, c1 int, salt int, mask long")
        .withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")))
    salts = F.array(*[F.lit(int(b)) for b in blocks])
    stored = (index.withColumn("salt", F.pmod(F.xxhash64("vec_id"),
                                              F.element_at(salts, F.col("c1") + 1)).cast("int"))
              .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))

    def rerank(key, q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(s):
            s = s.sort_values("vec_id")
            mat, ids, c2 = np.stack(s["embedding"].to_numpy()), s["vec_id"].to_numpy(), \
                s["c2"].to_numpy()
            unit = _unit(mat)
            step = max(1, (1 << 22) // len(s))
            for lo in range(0, len(q), step):
                part = q.iloc[lo:lo + step]
                qm = np.stack(part["query"].to_numpy())
                rough = _unit(qm) @ unit.T
                mask = part["mask"].to_numpy().astype(np.uint64)
                seen = (mask[:, None] >> c2.astype(np.uint64)[None]) & np.uint64(1)
                qid = part["query_id"].to_numpy()
                rough[(seen == 0) | (ids[None] == qid[:, None])] = -np.inf
                kth = (np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k
                       else np.full(len(part), -np.inf))
                i, j = np.nonzero((rough >= kth[:, None] - TIE) & np.isfinite(rough))
                found.append(pd.DataFrame({"query_id": qid[i], "vec_id": ids[j],
                                           "score": _cosines(qm[i], mat[j])}))
        if not found:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64"})
        f = pd.concat(found).sort_values(["query_id", "score", "vec_id"],
                                         ascending=[True, False, True])
        return f.groupby("query_id", sort=False).head(k)

    near = (visits.groupBy("c1", "salt", "part")
            .cogroup(stored.groupBy("c1", "salt", "part")).applyInPandas(rerank, result))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
