"""Ranked lexical search by presence-mask grouping.

Items are queries against all documents. Per block of items:

1. One scan of the documents writes an index of one row a document: its number of terms and the
   block's terms it holds with their counts. Document counts, lengths and document frequencies are
   grouped sums over it.
2. Tasks read the index in chunks of documents. A chunk's presence bitmaps (one a term) are turned
   into one mask a document and item, the set of the item's terms that the document holds, and
   documents of equal mask are one group. The score of a mask is at most the sum of its terms'
   largest contributions in the chunk. Masks are taken by descending maximum, the documents of each
   scored exactly, until the next maximum lies below the k-th best score so far; a task carries that
   score from chunk to chunk. Equal maxima are still scored, for ties go to smaller ids.
3. Each task leaves k documents an item at most, and a ranked window with a limit before its
   shuffle keeps the best k.

The vocabulary of a block is at most VOCABULARY_BYTES (one item may be larger), which is what is
sent to the tasks; more items take further scans. Nothing of size items x documents is moved.

Defined results: null and termless texts have no terms and are no documents of the collection; rows
with equal doc_id are documents of their own; rows without doc_id count in all statistics but are
not returned; items that share an item_id are one item with the terms of all; items without id or
terms have no results; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, ragged_arange

VOCABULARY_BYTES = 16 << 20     # most terms of a block of items, in bytes
TERMS = 16_384                  # most terms of the items that one pass over a chunk serves
CELLS = 16 << 20                # terms x documents of a chunk
# bytes of terms: digits, letters (A-Z lowered) and all of multi-byte characters
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127
                   else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms) with the distinct terms of every item."""

    def run(batches):
        for batch in batches:
            found = [list(set(terms_of(t or b""))) for t in batch.column(1).to_pylist()]
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner)),
                 pa.array([t for f in found for t in f], pa.binary())], ["item_id", "term"])

    own = items.select("item_id", F.col("text").cast("string").cast("binary").alias("text"))
    schema = T.StructType([T.StructField("item_id", own.schema["item_id"].dataType),
                           T.StructField("term", T.BinaryType())])
    return (own.filter("item_id is not null").mapInArrow(run, schema).distinct()
            .groupBy("item_id").agg(F.collect_list("term").alias("terms")))


def _blocks(items: DataFrame):
    """Lists of (item_id, terms) with a bounded vocabulary, fetched one after the other."""
    block, seen, size = [], set(), 0
    for row in items.toLocalIterator():
        terms = [bytes(t) for t in row["terms"]]
        more = set(terms) - seen
        if block and size + sum(map(len, more)) > VOCABULARY_BYTES:
            yield block
            block, seen, size, more = [], set(), 0, set(terms)
        block.append((row["item_id"], terms))
        seen |= more
        size += sum(map(len, more))
    if block:
        yield block


def build_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with terms: n counts all of them, the lists hold
    those of the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        number = sent.value
        for batch in batches:
            ns, at, tf, size = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = terms_of(text or b"")
                counts: dict[int, int] = {}
                for k in map(number.get, words):
                    if k is not None:
                        counts[k] = counts.get(k, 0) + 1
                ns.append(len(words))
                at += counts
                tf += counts.values()
                size.append(len(counts))
            ends = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
            full = pa.array([n > 0 for n in ns], pa.bool_())
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))],
                ["doc_id", "n", "terms", "tfs"])
            yield out.filter(full)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.col("text").cast("string").cast("binary").alias("text"))
    return materialize(own.mapInArrow(
        run, "doc_id long, n long, terms array<int>, tfs array<long>"), "term-index")


def _masks(present: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a (terms, documents) bitmap: the distinct masks (masks, terms), the documents grouped by
    mask, and where each group starts."""
    packed = np.packbits(present, axis=0)
    if len(packed) <= 8:
        wide = np.zeros((present.shape[1], 8), np.uint8)
        wide[:, :len(packed)] = packed.T
        names = wide.view(np.uint64).ravel()
    else:
        names = np.ascontiguousarray(packed.T).view(f"V{len(packed)}").ravel()
    _, first, group = np.unique(names, return_index=True, return_inverse=True)
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(len(first) + 1))
    return present[:, first].T, order, starts


class Best:
    """The k best (score, id) so far: highest score, then smallest id."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.append(self.score, score), np.append(self.id, ids)
        order = np.lexsort((ids, -score))[:self.k]
        self.score, self.id = score[order], ids[order]

    def least(self) -> int:
        """What a further document needs at least."""
        return int(self.score[-1]) if len(self.score) == self.k else 1


def search_chunk(ids, length, size, at, tf, items, weight, total, words, best) -> None:
    """Bring the documents of one chunk into ``best``, by item. ids, length: of the documents;
    size, at, tf: their postings; items: (number, terms); weight: by term."""
    owner = np.repeat(np.arange(len(ids)), size)
    start = np.cumsum(size) - size
    m = 50 + (50 * length * total) // words
    gain = weight[at] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[owner]))
    most = np.zeros(len(weight), np.int64)
    np.maximum.at(most, at, gain)
    used = np.unique(np.concatenate([t for _, t in items]))
    row = np.full(len(weight), -1)
    row[used] = np.arange(len(used))
    here = row[at] >= 0
    bitmap = np.zeros((len(used), len(ids)), np.uint8)
    bitmap[row[at[here]], owner[here]] = 1
    for item, terms in items:
        found, own = best[item], np.zeros(len(weight), bool)
        own[terms] = True
        masks, docs, starts = _masks(bitmap[row[terms]])
        limit = masks.astype(np.int64) @ most[terms]
        order = np.argsort(-limit, kind="stable")
        order = order[limit[order] >= found.least()]
        done, wanted = 0, found.k
        while done < len(order) and limit[order[done]] >= found.least():
            counts = np.cumsum(starts[order[done:] + 1] - starts[order[done:]])
            stop = done + int(np.searchsorted(counts, wanted)) + 1
            taken = order[done:stop]
            taken = taken[limit[taken] >= found.least()]
            span = starts[taken + 1] - starts[taken]
            doc = docs[np.repeat(starts[taken], span) + ragged_arange(span)]
            post = np.repeat(start[doc], size[doc]) + ragged_arange(size[doc])
            held = own[at[post]]
            score = np.zeros(len(doc), np.int64)
            np.add.at(score, np.repeat(np.arange(len(doc)), size[doc])[held], gain[post[held]])
            enough = score >= found.least()
            found.add(score[enough], ids[doc[enough]])
            done, wanted = stop, 2 * wanted


def _passes(items: list[tuple[int, np.ndarray]]):
    """Items in lists of TERMS terms at most, one item at least."""
    held, n = [], 0
    for item in items:
        if held and n + len(item[1]) > TERMS:
            yield held
            held, n = [], 0
        held.append(item)
        n += len(item[1])
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 of every item,
    equal scores by ascending doc_id."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    found = None
    for block in _blocks(materialize(_item_terms(items), "item-terms")):
        ranked = _search_block(docs, block, kind, k)
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        found = spark.createDataFrame([], T.StructType([T.StructField("item_id", kind)]))
        found = found.selectExpr("item_id", "0L as doc_id", "0L as score")
    by_score = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return (found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def _search_block(docs: DataFrame, block: list, kind: T.DataType, k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    index = build_index(docs, vocabulary)
    total, words = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    # one row a term of the block
    for term, n in (index.select(F.explode("terms").alias("term")).groupBy("term")
                    .agg(F.count("*").alias("n")).collect()):
        df[term] = n
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(n) + 1))) if n else 0
                       for n in df], np.int64)
    # terms without weight add nothing to any score
    items = [(i, np.array(sorted(vocabulary[t] for t in terms if weight[vocabulary[t]] > 0),
                          np.int64)) for i, (_, terms) in enumerate(block)]
    sent = spark.sparkContext.broadcast(([x for x in items if len(x[1])], weight, total, words))

    def run(batches):
        items, weight, total, words = sent.value
        best = {i: Best(k) for i, _ in items}
        groups = [(g, max(64, CELLS // max(1, sum(len(t) for _, t in g)))) for g in _passes(items)]
        for batch in batches:
            ids, length = (batch.column(c).to_numpy() for c in (0, 1))
            ends = batch.column(2).offsets.to_numpy().astype(np.int64)
            at = batch.column(2).values.to_numpy()
            tf = batch.column(3).values.to_numpy()
            for group, width in groups:
                for lo in range(0, len(ids), width):
                    hi = min(lo + width, len(ids))
                    a, b = ends[lo], ends[hi]
                    search_chunk(ids[lo:hi], length[lo:hi], np.diff(ends[lo:hi + 1]), at[a:b],
                                 tf[a:b], group, weight, total, words, best)
        size = [len(b.score) for b in best.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(list(best), np.int64), size), pa.int64()),
             pa.array(np.concatenate([np.zeros(0, np.int64), *(b.id for b in best.values())])),
             pa.array(np.concatenate([np.zeros(0, np.int64), *(b.score for b in best.values())]))],
            ["item", "doc_id", "score"])

    found = materialize(index.filter("doc_id is not null").mapInArrow(
        run, "item long, doc_id long, score long"), "found")
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], T.StructType(
        [T.StructField("item", T.LongType()), T.StructField("item_id", kind)]))
    # as many rows as the block has items
    return found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")
