"""MinHash near-duplicate detection with sequential Bayesian verification.

1. A document's set is its distinct word shingles as 64-bit hashes. Documents with equal sets form
   a class; the class's smallest id stands for it in all that follows, so copies are never paired.
2. Every class gets a MinHash signature; bands of it hash to buckets.
3. In each bucket all members are compared with the bucket's smallest id, not with each other:
   a large group of near copies costs one comparison a member.
4. Links found join classes to components. Buckets that still hold several components are compared
   again, every member outside the bucket's main component with all members of other components,
   in blocks bounded in members and in shingles. The signatures of a block tell its pairs; where
   they would be more than ``PAIRS`` a member, the block's full sets are sent instead, and it
   verifies its pairs itself, until two components are one, and tells only the links that joined
   some. So pairs never leave a block all together, and no link between different components is
   lost: links inside a component cannot change it.
5. A comparison reads the signatures in batches and stops as soon as the posterior probability of
   a similarity at or over the threshold (uniform prior) falls below ``MISS``; what survives is
   verified on the full sets. Members of open buckets have longer signatures, so that the test
   tells more of their many pairs apart before the full sets are needed.

With 32 bands of 4 rows a pair at similarity 0.8 shares no bucket with probability
(1 - 0.8^4)^32 < 5e-8.

Defined results: null, empty and wordless texts have the empty set and are linked with nothing;
a text with fewer words than a shingle has one shingle, the whole sequence; rows without id get a
row that is kept, linked with nothing; rows that share an id are linked with each other, whatever
their texts, and each has a row; other columns take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (chunks, hint_small, materialize, mix64, ragged_arange, utf8_buffers)
from .graphs import connected_components

HASHES = 128
BANDS = 32
ROWS = HASHES // BANDS
LONG = 1024                     # entries of the signatures compared inside buckets
BATCH = 16                      # signature entries read between two looks at the posterior
MISS = 1e-6
BLOCK = 512                     # members of a bucket that meet in one group
SHINGLES = 1 << 20              # and shingles in all, unless one set has more
PAIRS = 4                       # pairs a member that a block tells without verifying them
BASE = np.uint64(0x9E3779B97F4A7C15)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(20)
SEEDS = (_RNG.integers(0, 1 << 63, LONG, np.uint64) * np.uint64(2) + np.uint64(1),
         _RNG.integers(0, 1 << 63, LONG, np.uint64))


def shingle_sets(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of the texts between ``off``, one after the other,
    and the set sizes. Words are runs of bytes other than white space, A-Z lowered."""
    n_docs = len(off) - 1
    low = LOWER[raw]
    space = (low == 32) | ((low >= 9) & (low <= 13))
    new_doc = np.zeros(len(raw) + 1, bool)
    new_doc[off] = True
    new_doc = new_doc[:len(raw)]
    word = ~space
    begin = word.copy()
    begin[1:] &= space[:-1] | new_doc[1:]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    owner = np.searchsorted(off, starts, "right") - 1
    # spaces count as 0, so a sum up to the next start is the word's polynomial hash
    span = np.diff(np.append(starts, len(raw)))
    inner = ragged_arange(span)
    longest = int(span.max())
    power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(
        longest, BASE, np.uint64))))
    value = np.where(space, 0, low.astype(np.uint64) + np.uint64(1))[starts[0]:]
    value *= power[inner]
    h = mix64(np.add.reduceat(value, starts - starts[0]))
    counts = np.bincount(owner, minlength=n_docs)
    first = np.cumsum(counts) - counts
    n_sh = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.repeat(first, n_sh) + ragged_arange(n_sh)
    doc = np.repeat(np.arange(n_docs), n_sh)
    take = np.minimum(counts, width)[doc]
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        part = h[np.minimum(at + k, len(h) - 1)]
        out = np.where(k < take, mix64(out * BASE + part + np.uint64(k + 1)), out)
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out, doc = out[keep], doc[keep]
    return out, np.bincount(doc, minlength=n_docs)


def signatures(sets: np.ndarray, sizes: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """(documents, hashes) 32-bit minima; multiply-shift hashing of the mixed shingle hashes."""
    a, b = SEEDS
    out = np.zeros((len(sizes), hashes), np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        ends = np.cumsum(sizes)
        begin = (ends - sizes)[full]
        for k in range(hashes):
            out[full, k] = np.minimum.reduceat(
                ((sets * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), begin)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """A 2-d array as a binary column, one value a row."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    off = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows),
                                 [None, pa.py_buffer(off), pa.py_buffer(rows.tobytes())])


def sign(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, sig, bands): set size, 128-bit digest of the set, the
    signature's low 16 bits a hash, and the band hashes."""

    def run(batches):
        for batch in batches:
            raw, off = utf8_buffers(batch.column(1))
            for lo, hi in chunks(off):
                sets, sizes = shingle_sets(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], width)
                sig = signatures(sets, sizes)
                total = np.concatenate(([np.uint64(0)], np.cumsum(sets)))
                again = np.concatenate(([np.uint64(0)], np.cumsum(mix64(sets ^ BASE))))
                ends = np.concatenate(([0], np.cumsum(sizes)))
                band = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
                key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), band.shape[:2])
                for k in range(ROWS):
                    key = mix64(key * BASE + band[:, :, k] + np.uint64(1))
                flat = pa.array(np.ascontiguousarray(key).view(np.int64).reshape(-1))
                step = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * np.int32(BANDS))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()),
                     pa.array((total[ends[1:]] - total[ends[:-1]]).view(np.int64)),
                     pa.array((again[ends[1:]] - again[ends[:-1]]).view(np.int64)),
                     _binary(sig.astype(np.uint16)), pa.ListArray.from_arrays(step, flat)],
                    ["doc_id", "n_shingles", "set_a", "set_b", "sig", "bands"])

    return _texts(docs).mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, sig binary, "
             "bands array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))


def least_matches(threshold: float, hashes: int, bits: int,
                  miss: float = MISS) -> list[tuple[int, int]]:
    """(entries read, fewest matches to go on) after each batch: below that the posterior
    P(similarity >= threshold | matches), a Beta tail for a uniform prior, is under ``miss``.
    Entries cut to ``bits`` match by chance as well."""
    t = threshold + (1 - threshold) / 2 ** bits
    out = []
    for n in range(BATCH, hashes + 1, BATCH):
        tail, least = 0.0, n + 1
        for m in range(n + 1):
            # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
            tail += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                least = m
                break
        out.append((n, least))
    return out


def survivors(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray,
              steps: list[tuple[int, int]]) -> np.ndarray:
    """Which of the pairs (row i of left, row j of right) pass every batch of the sequential
    test, given ``least_matches``."""
    live = np.arange(len(i))
    met = np.zeros(len(i), np.int32)
    for n, least in steps:
        if not len(live):
            break
        met = met + (left[i[live], n - BATCH:n] == right[j[live], n - BATCH:n]).sum(
            1, dtype=np.int32)
        go = met >= least
        live, met = live[go], met[go]
    return live


def _stack(col: pa.Array, kind, width: int) -> np.ndarray:
    raw, _ = utf8_buffers(col)
    return raw.view(kind).reshape(-1, width)


def _pass_pairs(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) that survive the sequential test, as (a, b)."""
    steps = least_matches(threshold, HASHES, 16)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                own = np.arange(batch.num_rows)
                live = pa.array(survivors(_stack(batch.column(2), np.uint16, HASHES),
                                          _stack(batch.column(3), np.uint16, HASHES),
                                          own, own, steps))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(live),
                                                  batch.column(1).take(live)], ["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _similar(p: np.ndarray, q: np.ndarray, num: int, den: int) -> bool:
    """den * |p and q| >= num * |p or q| for two sets without repeats."""
    if num * max(len(p), len(q)) > den * min(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return den * both >= num * (len(p) + len(q) - both)


def _roots(comp: np.ndarray, parent: dict) -> np.ndarray:
    """The component that each of ``comp`` has become part of."""
    def root(c):
        while c in parent:
            c = parent[c]
        return c
    names, at = np.unique(comp, return_inverse=True)
    return np.array([root(c) for c in names.tolist()], np.int64)[at]


def _links_of_block(left, rep, comp, band, bands, sig, sets, steps, num, den):
    """Links (a, b) between left and other members of a block that join components which no earlier
    link of the block has joined. A pair that shares several buckets is looked at in the first of
    them only."""
    a, b = np.flatnonzero(left), np.flatnonzero(~left)
    parent, found = {}, []
    for lo in range(0, len(a) if len(b) else 0, 128):
        comp = _roots(comp, parent)
        i, j = np.nonzero(comp[a[lo:lo + 128]][:, None] != comp[b][None])
        i, j = a[lo + i], b[j]
        live = survivors(sig, sig, i, j, steps)
        i, j = i[live], j[live]
        told = (bands[i] == bands[j]).argmax(1) == band[i]
        for x, y in zip(i[told].tolist(), j[told].tolist()):
            u, v = int(comp[x]), int(comp[y])
            while u in parent:
                u = parent[u]
            while v in parent:
                v = parent[v]
            if u != v and _similar(sets[x], sets[y], num, den):
                parent[max(u, v)] = min(u, v)
                found.append((max(rep[x], rep[y]), min(rep[x], rep[y])))
    return found


def _pairs_of_block(left, rep, comp, band, bands, sig, steps):
    """Pairs (a, b) of left and other members of a block, of different components, that survive;
    None where they are more than PAIRS a member. A pair that shares several buckets is told in
    the first of them only."""
    a, b = np.flatnonzero(left), np.flatnonzero(~left)
    found, count = [], 0
    for lo in range(0, len(a) if len(b) else 0, 128):
        i, j = np.nonzero(comp[a[lo:lo + 128]][:, None] != comp[b][None])
        i, j = a[lo + i], b[j]
        live = survivors(sig, sig, i, j, steps)
        i, j = i[live], j[live]
        told = (bands[i] == bands[j]).argmax(1) == band[i]
        found.append((rep[i[told]], rep[j[told]]))
        count += int(told.sum())
        if count > PAIRS * len(rep):
            return None
    if not count:
        return rep[:0], rep[:0]
    i, j = (np.concatenate(x) for x in zip(*found))
    return np.maximum(i, j), np.minimum(i, j)


def _per_block(rows: DataFrame, work, schema: str, *more: str) -> DataFrame:
    """``work(grp, columns, sets)`` on the rows of each block (grp); columns are left, rep, comp,
    band, bands and sig, sets the members where they are among the columns."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cur = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            cur.append(batch.column(5).flatten().to_numpy().reshape(-1, BANDS))
            cur.append(_stack(batch.column(6), np.uint8, LONG))
            sets = [np.frombuffer(x.as_buffer(), np.uint64)
                    for c in batch.columns[7:] for x in c]
            if held is not None:
                cur = [np.concatenate(x) for x in zip(held[0], cur)]
                sets = held[1] + sets
            cuts = np.concatenate(([0], np.flatnonzero(cur[0][1:] != cur[0][:-1]) + 1))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                yield from work(int(cur[0][lo]), [x[lo:hi] for x in cur[1:]], sets[lo:hi])
            last = cuts[-1]
            held = [x[last:] for x in cur], sets[last:]
        if held is not None:
            yield from work(int(held[0][0][0]), held[0][1:], held[1])

    return (rows.select("grp", "left", "rep", "comp", "band", "bands", "sig", *more)
            .repartition("grp").sortWithinPartitions("grp", "rep", "left")
            .mapInArrow(run, schema))


def _pass_blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, full) of blocks: pairs that survive the sequential test, or the block (full) that has
    too many to tell."""
    steps = least_matches(threshold, LONG, 8)

    def work(grp, cols, _):
        found = _pairs_of_block(*cols, steps)
        if found is None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                                              pa.array([grp])], ["a", "b", "full"])
        elif len(found[0]):
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, found), pa.nulls(len(found[0]), pa.int64())], ["a", "b", "full"])

    return _per_block(rows, work, "a long, b long, full long")


def _link_blocks(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of blocks with their full sets (members): see ``_links_of_block``."""
    steps = least_matches(num / den, LONG, 8)

    def work(_, cols, sets):
        found = _links_of_block(*cols, sets, steps, num, den)
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                             ["a", "b"])

    return _per_block(rows, work, "a long, b long", "members")


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, members): the sorted shingle hashes of each document as 8-byte values."""

    def run(batches):
        for batch in batches:
            raw, off = utf8_buffers(batch.column(1))
            for lo, hi in chunks(off):
                sets, sizes = shingle_sets(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], width)
                ends = np.concatenate(([0], np.cumsum(sizes))) * 8
                members = pa.Array.from_buffers(
                    pa.large_binary(), hi - lo,
                    [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(sets.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo),
                                                  members.cast(pa.binary())],
                                                 ["doc_id", "members"])

    return docs.mapInArrow(run, "doc_id long, members binary")


def _long_signatures(sets: DataFrame) -> DataFrame:
    """(rep, sig): LONG entries of 8 bits of the documents in ``sets``."""

    def run(batches):
        for batch in batches:
            raw, off = utf8_buffers(batch.column(1))
            for lo, hi in chunks(off):
                sig = signatures(raw[off[lo]:off[hi]].view(np.uint64),
                                 np.diff(off[lo:hi + 1]) // 8, LONG)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), _binary(sig.astype(np.uint8))],
                    ["rep", "sig"])

    return sets.select("doc_id", "members").mapInArrow(run, "rep long, sig binary")


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) with den * |A and B| >= num * |A or B| on the full sets. The smaller id, the
    hub of a star, is joined last, so its set is sent once however many pairs name it."""
    one = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("set_a")), "a")
    two = one.join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("set_b")), "b")

    def run(batches):
        for batch in batches:
            keep = pa.array([_similar(np.frombuffer(x.as_buffer(), np.uint64),
                                      np.frombuffer(y.as_buffer(), np.uint64), num, den)
                             for x, y in zip(batch.column(2), batch.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep),
                                              batch.column(1).filter(keep)], ["a", "b"])

    return two.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document: documents are linked whose
    shingle sets (``width`` words) have den * intersection >= num * union; component_id is the
    smallest id reachable."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    again = (base.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
             .limit(1).collect())
    if not again:
        found = _unique_ids(base, width, num, den)
    else:
        # rows are numbered, and the numbers of one id are linked
        rows = materialize(base.select(F.monotonically_increasing_id().alias("key"), "doc_id",
                                       "text"), "numbered")
        named = rows.filter("doc_id is not null")
        first = named.groupBy("doc_id").agg(F.min("key").alias("b"))
        same = named.join(first, "doc_id").select(F.col("key").alias("a"), "b")
        got = materialize(_unique_ids(named.select(F.col("key").alias("doc_id"), "text"), width,
                                      num, den, same), "numbered-components")
        got = got.select(F.col("doc_id").alias("key"), "n_shingles",
                         F.col("component_id").alias("part")).join(
            named.select("key", "doc_id"), "key")
        least = got.groupBy("part").agg(F.min("doc_id").alias("component_id"))
        lost = sign(rows.filter("doc_id is null").select("doc_id", "text"), width)
        found = (got.join(least, "part").select("doc_id", "n_shingles", "component_id")
                 .unionByName(lost.select("doc_id", "n_shingles",
                                          F.col("doc_id").alias("component_id"))))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _unique_ids(docs: DataFrame, width: int, num: int, den: int,
                known: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents whose ids do not repeat; ``known`` are
    links (a, b) that hold anyway."""
    threshold = num / den
    signed = materialize(sign(docs, width), "signed")
    usable = signed.filter("doc_id is not null and n_shingles > 0")
    classes = materialize(
        usable.groupBy("set_a", "set_b", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"),
             F.first("bands").alias("bands")), "classes")
    buckets = classes.select("rep", "n_shingles", F.posexplode("bands").alias("band", "key"))
    shared = (buckets.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last"))
              .filter("hub < last").select("key", "hub"))
    member = materialize(buckets.join(shared, "key"), "buckets")

    sigs = classes.select("rep", "sig")
    ids = materialize(member.select(F.col("rep").alias("doc_id")).distinct(), "candidates")
    sets = materialize(_full_sets(_texts(docs).join(hint_small(ids, 16), "doc_id", "left_semi"),
                                  width), "sets")

    star = (member.filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
            .distinct())
    star = (star.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
            .join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b"))
    links = materialize(_verify(_pass_pairs(star, threshold), sets, num, den), "star-links")
    if known is not None:
        # links hold between classes, so both ends are named by their class
        of = (signed.select("doc_id", "set_a", "set_b", "n_shingles")
              .join(classes.select("set_a", "set_b", "n_shingles", "rep"),
                    ["set_a", "set_b", "n_shingles"], "left")
              .select("doc_id", F.coalesce("rep", "doc_id").alias("rep")))
        known = (known.join(of.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra")), "a")
                 .join(of.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb")), "b")
                 .select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        links = materialize(links.unionByName(known), "all-links")
    comps = materialize(connected_components(links), "star-components")

    # buckets with several components: members outside the main one against all others
    placed = (member.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
              .select("key", "band", "rep", "n_shingles",
                      F.coalesce("component", "rep").alias("comp")))
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("n"),
                                              F.sum("n_shingles").alias("size"))

    def blocks(n, size):
        return F.ceil(F.greatest(n / BLOCK, size / SHINGLES)).cast("int")

    mixed = (parts.groupBy("key").agg(F.max(F.struct("n", "comp", "size")).alias("main"),
                                      F.count("*").alias("k"), F.sum("n").alias("n"),
                                      F.sum("size").alias("size"))
             .filter("k > 1")
             .select("key", F.col("main.comp").alias("main"),
                     blocks(F.col("n"), F.col("size")).alias("rights"),
                     blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size"))
                     .alias("lefts")))
    open_rows = materialize(placed.join(mixed, "key"), "open-rows")
    open_ids = materialize(open_rows.select(F.col("rep").alias("doc_id")).distinct(), "open-ids")
    longer = materialize(_long_signatures(
        sets.join(hint_small(open_ids, 16), "doc_id", "left_semi")), "long-signatures")
    salt = F.xxhash64("rep", "key")
    right = open_rows.select(
        "key", "band", "rep", "comp", F.lit(False).alias("left"),
        F.pmod(salt, F.col("rights")).alias("r"),
        F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("l"))
    left = open_rows.filter("comp <> main").select(
        "key", "band", "rep", "comp", F.lit(True).alias("left"),
        F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("r"),
        F.pmod(salt, F.col("lefts")).alias("l"))
    names = ["key", "band", "rep", "comp", "left", F.col("r").cast("long"),
             F.col("l").cast("long")]
    dealt = left.select(*names).unionByName(right.select(*names)).select(
        F.xxhash64("key", "r", "l").alias("grp"), "left", "rep", "comp", "band")
    told = materialize(_pass_blocks(
        dealt.join(longer, "rep").join(classes.select("rep", "bands"), "rep"), threshold),
        "open-pairs")
    full = hint_small(told.filter("full is not null").select(F.col("full").alias("grp")), 16)
    dense = (dealt.join(full, "grp", "left_semi").join(longer, "rep")
             .join(classes.select("rep", "bands"), "rep")
             .join(sets.select(F.col("doc_id").alias("rep"), "members"), "rep"))
    more = materialize(_verify(told.filter("full is null").select("a", "b").distinct(), sets, num,
                               den).unionByName(_link_blocks(dense, num, den)), "open-links")
    final = connected_components(
        comps.select(F.col("node").alias("a"), F.col("component").alias("b"))
        .unionByName(more))

    by_class = classes.select("set_a", "set_b", "n_shingles", "rep").join(
        final.select(F.col("node").alias("rep"), "component"), "rep", "left")
    by_class = by_class.select("set_a", "set_b", "n_shingles",
                               F.coalesce("component", "rep").alias("component"))
    out = (signed.select("doc_id", "n_shingles", "set_a", "set_b")
           .join(by_class, ["set_a", "set_b", "n_shingles"], "left"))
    if known is not None:
        # documents without words are in no class, but may be linked
        own = final.select(F.col("node").alias("doc_id"), F.col("component").alias("own"))
        out = out.join(own, "doc_id", "left").withColumn(
            "component", F.when(F.col("n_shingles") > 0, F.col("component"))
            .otherwise(F.col("own")))
    return out.select("doc_id", "n_shingles",
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
                      .alias("component_id"))
