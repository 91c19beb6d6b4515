"""User- and item-based collaborative filtering.

Over all members, exact and without pairs of members (``item_based``, ``user_based``): with binary member x condition data A (members as rows):
  item-based  score(m, i) = sum_{j in m} cos(i, j),      cos from G = A'A
  user-based  score(m, i) = sum_{u != m} cos(m, u) a_ui = (a_m' G~)_i / |a_m|,  G~ = A' D^-1 A,
              D = diag(|a_u|), i.e. every member votes with its cosine similarity.
Both need only the conditions x conditions table G, a grouped sum over the pairs inside each
member (combined map-side, so it ships at most one row per condition pair and task). Scoring
multiplies Arrow batches of members with that table and emits k rows a member; a table of more than
``DENSE_ITEMS`` conditions is joined instead.

Over each member's nearest members only (``nearest_based``): a set-similarity join finds, for every
member, the others with a cosine of at least ``least``, exactly.
  * Members with equal condition sets form a class and are compared once.
  * Prefix filter: conditions are ordered by frequency, rarest first. Two sets of cosine t share at
    least t^2 |x| conditions, so they share one of the first |x| - ceil(t^2 |x|) + 1 of both; only
    classes that share such a condition meet.
  * Classes that share one are dealt by blocks of at most ``BLOCK`` per side, so a common condition
    is spread over many tasks; tasks compare a block pair as one matrix product and emit the pairs
    over the threshold, each under the rarest condition of both prefixes.
  * Where the conditions are few and common the prefixes leave nothing out: more pairs meet under
    them than there are. Then blocks of classes meet all classes instead (``nearest_classes``): a
    task holds a block, streams the others past it and keeps the nearest of each only, so that
    neither the pairs nor a copy of a class per prefix condition is ever written. Sets travel as
    packed bits, a blob of ``PACKED`` classes a row, and are compared as matrix products of
    normalised floats; the few that reach the worst place kept so far are counted again from bits.
The k nearest then vote with their cosine for conditions the member lacks; up to ``DENSE_ITEMS``
conditions the votes of a class are added in one task from its neighbours' sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.operators.ids import contiguous_ids
from carelens.operators.util import MAX_CELLS, rank_top, small_side
from carelens.session import written

ITEM_KEYS = ["condition_name", "chronic_flag"]
DENSE_ITEMS = 2_000           # conditions whose table is sent to every task (32 MB of doubles)
BLOCK = 512                   # classes of one side that meet under a condition
HELD = (1_024, 131_072)       # classes of a block that all classes are streamed past
BLOCKS = 96                   # of them (more where they would be too large): tasks and copies
PACKED = 4_096                # classes of a blob
TILE = 1_024                  # classes of a block that are compared together


def _indexed(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conditions numbered in key order, and each member's set of numbers (written once: the
    pair sums and the scoring both read it)."""
    items = small_side(contiguous_ids(known.select(*ITEM_KEYS), ITEM_KEYS, "_item"), "conditions")
    per_member = (known.select("member_id", *ITEM_KEYS).join(items, ITEM_KEYS)
                  .groupBy("member_id").agg(F.collect_set("_item").alias("items")))
    return written(per_member, "member-conditions"), items


def gram(per_member: DataFrame, user_weighted: bool) -> DataFrame:
    """A'A (or A'D^-1 A) as (i, j, v)."""
    weight = 1 / F.sqrt(F.size("items")) if user_weighted else F.lit(1.0)
    return (per_member.select(weight.alias("w"), "items", F.explode("items").alias("i"))
            .select("w", "i", F.explode("items").alias("j"))
            .groupBy("i", "j").agg(F.sum("w").alias("v")))


def _score_topk(per_member: DataFrame, similar: DataFrame, items: DataFrame, k: int,
                normalize_member: bool, digits: int = 6) -> DataFrame:
    """The ``k`` best-scored conditions a member does not have, scores above zero, ties by
    condition and class (the order of the numbers). Ranks use nine places, so that the order in
    which doubles are added cannot reorder ties."""
    n = items.count()
    if n <= DENSE_ITEMS:
        best = _dense_topk(per_member, similar, n, k, normalize_member)
    else:
        best = _joined_topk(per_member, similar, k, normalize_member)
    return (best.join(items, F.col("i") == F.col("_item"))
            .select("member_id", *ITEM_KEYS, F.round("score", digits).alias("score"),
                    "pred_rank"))


def _dense_topk(per_member: DataFrame, similar: DataFrame, n: int, k: int | None,
                normalize_member: bool) -> DataFrame:
    """(member_id, i, score, pred_rank): batches of members times the table, k rows a member."""
    got = similar.select("i", "j", "v").toArrow()       # n x n rows at most
    table = np.zeros((n + 1, n + 1))
    table[got.column("j").to_numpy(), got.column("i").to_numpy()] = got.column("v").to_numpy()
    sent = per_member.sparkSession.sparkContext.broadcast(table)
    kept = n if k is None else min(k, n)
    own = per_member.select("member_id", "items")

    def run(batches):
        table = sent.value
        step = max(1, MAX_CELLS // (n + 1))
        for batch in batches:
            off = batch.column(1).offsets.to_numpy()
            every = batch.column(1).values.to_numpy()
            for lo in range(0, batch.num_rows, step):
                hi = min(lo + step, batch.num_rows)
                size = np.diff(off[lo:hi + 1])
                row, col = np.repeat(np.arange(hi - lo), size), every[off[lo]:off[hi]]
                held = np.zeros((hi - lo, n + 1))
                held[row, col] = 1.0
                score = held @ table
                if normalize_member:
                    score /= np.sqrt(np.maximum(size, 1))[:, None]
                score[row, col] = 0.0
                key = np.round(score, 9)
                order = np.argsort(-key, axis=1, kind="stable")[:, :kept]
                good = np.take_along_axis(key, order, 1) > 0
                r, c = np.nonzero(good)
                item = order[r, c]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lo + r)), pa.array(item.astype(np.int64)),
                     pa.array(score[r, item]), pa.array((c + 1).astype(np.int32))],
                    ["member_id", "i", "score", "pred_rank"])

    kind = own.schema["member_id"].dataType.simpleString()
    return own.mapInArrow(run, f"member_id {kind}, i long, score double, pred_rank int")


def _joined_topk(per_member: DataFrame, similar: DataFrame, k: int | None,
                 normalize_member: bool) -> DataFrame:
    """The same by a join of each member's conditions with the table, for any number of them."""
    votes = small_side(similar.filter("v > 0").select(F.col("j").alias("item"), "i", "v",
                                                      (F.col("i") == F.col("j")).alias("own")),
                       "similar")
    held = (per_member.repartition("member_id")
            .select("member_id", F.size("items").alias("n"), F.explode("items").alias("item")))
    total = F.sum("v") / F.sqrt(F.max("n")) if normalize_member else F.sum("v")
    scored = (held.join(votes, "item").groupBy("member_id", "i")
              .agg(total.alias("score"), F.max("own").alias("own"))
              .filter("not own").withColumn("_key", F.round("score", 9)).filter("_key > 0"))
    return rank_top(scored, ["member_id"], [F.desc("_key"), F.asc("i")], k).select(
        "member_id", F.col("i").cast("long").alias("i"), "score", "pred_rank")


def item_based(known: DataFrame, k: int = 10) -> DataFrame:
    """Conditions most similar (cosine over members) to those the member has."""
    per_member, items = _indexed(known)
    g = written(gram(per_member, user_weighted=False), "gram")
    norm = g.filter("i = j").select(F.col("i").alias("_of"), F.sqrt("v").alias("_norm"))
    left = norm.select(F.col("_of").alias("i"), F.col("_norm").alias("_i"))
    right = norm.select(F.col("_of").alias("j"), F.col("_norm").alias("_j"))
    cosine = g.join(left, "i").join(right, "j").select(
        "i", "j", (F.col("v") / (F.col("_i") * F.col("_j"))).alias("v"))
    return _score_topk(per_member, cosine, items, k, normalize_member=False)


def user_based(known: DataFrame, k: int = 10) -> DataFrame:
    """Conditions held by similar members, every member voting with its cosine
    similarity to the target member."""
    per_member, items = _indexed(known)
    return _score_topk(per_member, gram(per_member, user_weighted=True), items, k,
                       normalize_member=True)


def _classes(known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(class, member_id) of every member, (class, size, members, items) of the distinct sets and
    (item, condition keys). Items are numbered by rising frequency, the class is the smallest
    member, members counts them."""
    often = known.select("member_id", *ITEM_KEYS).distinct().groupBy(*ITEM_KEYS).agg(
        F.count("*").alias("_n"))
    items = small_side(contiguous_ids(often, ["_n", *ITEM_KEYS], "_item").select(
        "_item", *ITEM_KEYS), "conditions")
    sets = written(known.select("member_id", *ITEM_KEYS).join(items, ITEM_KEYS)
                   .groupBy("member_id").agg(F.array_sort(F.collect_set("_item")).alias("items")),
                   "member-sets")
    classes = written(sets.groupBy("items").agg(F.min("member_id").alias("class"),
                                                F.count("*").alias("members"))
                      .withColumn("size", F.size("items")), "set-classes")
    of = sets.join(classes.select("items", "class"), "items").select("class", "member_id")
    return of, classes, items


def _prefixes(classes: DataFrame, least: float) -> DataFrame:
    length = F.col("size") - F.ceil(F.col("size") * (least * least) - 1e-9) + 1
    return classes.withColumn("prefix", F.slice("items", 1, length.cast("int")))


def _prefixes_help(classes: DataFrame, items: DataFrame, least: float) -> bool:
    """Whether fewer pairs meet under prefix conditions than there are pairs of classes."""
    if items.count() > DENSE_ITEMS:
        return True
    n = classes.count()
    meet = (_prefixes(classes, least).select(F.explode("prefix").alias("token"))
            .groupBy("token").agg(F.count("*").alias("n"))
            .agg(F.sum(F.col("n").cast("double") * F.col("n")))).first()[0]
    return n < 2 or meet < float(n) * n


def _packed(classes: DataFrame, width: int, blocks: int) -> DataFrame:
    """(own, name, bits): the classes dealt to ``blocks`` blocks, a row for up to ``PACKED`` of one;
    the sets follow each other as bits of items up to ``width``."""
    own = F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int")
    rows = classes.select(own.alias("own"), F.col("class").cast("long").alias("class"), "items"
                          ).filter("class is not null")

    def run(batches):
        for batch in batches:
            own = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:]):
                for lo in range(start, end, PACKED):
                    part = batch.slice(lo, min(PACKED, end - lo))
                    size = np.diff(part.column(2).offsets.to_numpy())
                    held = np.zeros((part.num_rows, width + 1), bool)
                    held[np.repeat(np.arange(part.num_rows), size),
                         part.column(2).flatten().to_numpy()] = True
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(0, 1),
                         pa.array([part.column(1).to_numpy()], pa.list_(pa.int64())),
                         pa.array([np.packbits(held, axis=1).tobytes()], pa.binary())],
                        ["own", "name", "bits"])

    return (rows.repartitionById(blocks, "own").sortWithinPartitions("own", "class")
            .mapInArrow(run, "own int, name array<long>, bits binary"))


def nearest_classes(classes: DataFrame, width: int, least: float, neighbours: int) -> DataFrame:
    """(a, b, cosine): of every class a its ``neighbours`` nearest other classes b of a cosine of at
    least ``least``, ties (at nine places) to the smaller b; ``width`` is the largest item. All
    pairs are compared: a block of classes stays in its task, all classes pass it, and only the
    best so far are kept."""
    n = classes.count()
    block = min(max(HELD[0], -(-n // BLOCKS)), HELD[1])
    blocks = max(1, -(-n // block))
    packed = written(_packed(classes, width, blocks), "packed-classes")
    # a blob comes to its own block first, where it is the block, and to all others
    dealt = packed.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("grp"), "own",
                          "name", "bits").withColumn("side", (F.col("grp") != F.col("own")).cast("int"))
    slack = 1e-6 + 1.2e-7 * (width + 8)          # what sums of ``width`` floats may be off

    def floats(bits, size):
        held = np.unpackbits(bits, axis=1, count=width + 1).astype(np.float32)
        held /= np.sqrt(size).astype(np.float32)[:, None]
        return held

    class Block:
        def __init__(self, blobs):
            self.name, self.bits, self.size = (np.concatenate(x) for x in zip(*blobs))
            best = (len(self.name), neighbours)
            self.key, self.cos = np.full(best, -2.0), np.zeros(best)
            self.b, self.step = np.zeros(best, np.int64), 64

        def meet(self, name, bits, size):
            """All classes of a blob pass the block."""
            right = floats(bits, size)
            cuts = [0]
            while cuts[-1] < len(name):
                cuts.append(min(cuts[-1] + self.step, len(name)))
                self.step = min(BLOCK, 2 * self.step)
            for lo in range(0, len(self.name), TILE):
                tile = slice(lo, lo + TILE)
                left = floats(self.bits[tile], self.size[tile])
                for at, to in zip(cuts[:-1], cuts[1:]):
                    near = left @ right[at:to].T
                    low = np.maximum(self.key[tile, -1], least) - slack
                    found = np.flatnonzero(near >= low.astype(np.float32)[:, None])
                    if len(found):
                        i, j = np.divmod(found, to - at)
                        self.take(i + lo, name, bits, size, j + at)

        def take(self, i, name, bits, size, j):
            both = np.bitwise_count(self.bits[i] & bits[j]).sum(axis=1, dtype=np.int64).astype(float)
            full = self.size[i] * size[j]
            cos = both / np.sqrt(full)
            key, worst = np.round(cos, 9), self.key[i, -1]
            keep = (self.name[i] != name[j]) & (both * both >= least * least * full - 1e-9) & (
                (key > worst) | ((key == worst) & (name[j] < self.b[i, -1])))
            i, j, cos, key = i[keep], j[keep], cos[keep], key[keep]
            if not len(i):
                return
            rows = np.unique(i)
            every = np.concatenate([np.repeat(rows, neighbours), i])
            key = np.concatenate([self.key[rows].ravel(), key])
            b = np.concatenate([self.b[rows].ravel(), name[j]])
            full = np.concatenate([self.cos[rows].ravel(), cos])
            order = np.lexsort((b, -key, every))
            first = np.searchsorted(every[order], rows)
            pick = order[first[:, None] + np.arange(neighbours)]
            self.key[rows], self.b[rows], self.cos[rows] = key[pick], b[pick], full[pick]

        def told(self):
            at, place = np.nonzero(self.key > -1)
            return pa.RecordBatch.from_arrays(
                [pa.array(self.name[at]), pa.array(self.b[at, place]),
                 pa.array(self.cos[at, place])], ["a", "b", "cosine"])

    def run(batches):
        block, blobs = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                name = batch.column(2).slice(r, 1).flatten().to_numpy()
                bits = np.frombuffer(batch.column(3)[r].as_buffer(), np.uint8).reshape(len(name), -1)
                size = np.bitwise_count(bits).sum(axis=1, dtype=np.int64).astype(float)
                if batch.column(1)[r].as_py() == 0:
                    if block is not None:                 # a task may hold several blocks
                        yield block.told()
                        block = None
                    blobs.append((name, bits, size))
                    continue
                if block is None:
                    block, own = Block(blobs), blobs
                    blobs = []
                    for blob in own:
                        block.meet(*blob)
                block.meet(name, bits, size)
        if block is None and blobs:                       # the only block
            block, own = Block(blobs), blobs
            for blob in own:
                block.meet(*blob)
        if block is not None:
            yield block.told()

    return (dealt.repartitionById(blocks, "grp").sortWithinPartitions("grp", "side")
            .select("grp", "side", "name", "bits").mapInArrow(run, "a long, b long, cosine double"))


def similar_classes(classes: DataFrame, least: float) -> DataFrame:
    """(a, b, cosine) of all ordered pairs of different sets with a cosine of at least ``least``,
    by prefix filter and block pairs."""
    share = least * least
    rows = written(_prefixes(classes, least).select(
        "class", "items", "prefix", F.explode("prefix").alias("token")), "prefixes")
    blocks = (rows.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"),
                                        F.count("*").alias("n")).filter("n > 1").drop("n"))
    own = F.pmod(F.xxhash64("class", "token"), F.col("blocks"))
    # block pairs (x <= y): a class stands in its own block on one side, against every other
    dealt = (rows.join(small_side(blocks, "token-blocks"), "token").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("token", "class", "items", "prefix", F.least("own", "other").alias("x"),
                     F.greatest("own", "other").alias("y"),
                     (F.col("own") <= F.col("other")).alias("left"),
                     (F.col("own") >= F.col("other")).alias("right")))
    dealt = dealt.withColumn("grp", F.xxhash64("token", "x", "y"))

    def meet(token, name, items, prefix, left, right):
        """Pairs of one block pair."""
        off, every = items
        codes, col = np.unique(every, return_inverse=True)
        held = np.zeros((len(name), len(codes)), np.float32)
        held[np.repeat(np.arange(len(name)), np.diff(off)), col] = 1
        size = np.diff(off).astype(float)
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        both = (held[a] @ held[b].T).astype(float)
        good = both * both >= share * size[a][:, None] * size[b][None] - 1e-9
        # a block with itself names each pair twice
        good &= name[a][:, None] < name[b][None] if (left & right).all() else \
            name[a][:, None] != name[b][None]
        i, j = np.nonzero(good)
        poff, pre = prefix
        out = []
        for p, q, n in zip(a[i], b[j], both[i, j]):
            # told under the rarest condition of both prefixes
            first = np.intersect1d(pre[poff[p]:poff[p + 1]], pre[poff[q]:poff[q + 1]])[0]
            if first == token:
                out.append((name[p], name[q], n / np.sqrt(size[p] * size[q])))
        return out

    def run(batches):
        held = []

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            cols = [t.column(c).combine_chunks() for c in range(t.num_columns)]
            grp, token, name = (cols[c].to_numpy() for c in (0, 1, 2))
            left, right = (cols[c].to_numpy(zero_copy_only=False) for c in (5, 6))
            found = []
            cuts = np.flatnonzero((grp[1:] != grp[:-1]) | (token[1:] != token[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(grp)]):
                lists = []
                for c in (3, 4):
                    off = cols[c].offsets.to_numpy()[lo:hi + 1]
                    lists.append((off - off[0], cols[c].values.to_numpy()[off[0]:off[-1]]))
                found += meet(token[lo], name[lo:hi], *lists, left[lo:hi], right[lo:hi])
            a, b, c = (list(x) for x in zip(*found)) if found else ([], [], [])
            return pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())],
                ["a", "b", "cosine"])

        for batch in batches:
            if not batch.num_rows:
                continue
            grp = batch.column(0).to_numpy()
            cut = int(np.searchsorted(grp, grp[-1], "left"))
            # a group may go on in the next batch
            if cut:
                held.append(batch.slice(0, cut))
                yield flush()
                held = []
            elif held and held[-1].column(0)[0].as_py() != grp[0]:
                yield flush()
                held = []
            held.append(batch.slice(cut))
        if held:
            yield flush()

    pairs = (dealt.select("grp", "token", F.col("class").cast("long").alias("class"), "items",
                          "prefix", "left", "right")
             .repartition("grp").sortWithinPartitions("grp", "token")
             .mapInArrow(run, "a long, b long, cosine double"))
    return pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(
        F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "cosine").select(
            "p.a", "p.b", "cosine")


def _dense_votes(votes: DataFrame, classes: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(a, _item, score, pred_rank): the ``k`` best voted items that class a lacks, from (a, b, v,
    items of b), a row a neighbour; a batch of classes times items is added at once."""
    order = np.array([r[0] for r in items.orderBy(*ITEM_KEYS).select("_item").collect()], np.int64)
    n = int(order.max(initial=0)) + 1
    per_class = votes.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("b", "v", "items")))
                                       .alias("votes"))
    rows = per_class.join(classes.select(F.col("class").alias("a"), "items"), "a").select(
        "a", "items", "votes")

    def run(batches):
        step = max(1, MAX_CELLS // n)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                rows = np.arange(part.num_rows)
                own, each = part.column(1), part.column(2)
                given = each.flatten()
                v, sets = given.field(1).to_numpy(), given.field(2)
                size = np.diff(sets.offsets.to_numpy())
                cell = np.repeat(np.repeat(rows, np.diff(each.offsets.to_numpy())), size) * n \
                    + sets.flatten().to_numpy()
                shape = (len(rows), n)
                score = np.bincount(cell, np.repeat(v, size), len(rows) * n).reshape(shape)
                voted = np.bincount(cell, minlength=len(rows) * n).reshape(shape) > 0
                voted[np.repeat(rows, np.diff(own.offsets.to_numpy())),
                      own.flatten().to_numpy()] = False
                key = np.where(voted, np.round(score, 9), -np.inf)[:, order]
                top = np.argsort(-key, axis=1, kind="stable")[:, :k]
                r, c = np.nonzero(np.take_along_axis(key, top, 1) > -np.inf)
                item = order[top[r, c]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(r)), pa.array(item.astype(np.int32)),
                     pa.array(score[r, item]), pa.array((c + 1).astype(np.int32))],
                    ["a", "_item", "score", "pred_rank"])

    kind = rows.schema["a"].dataType.simpleString()
    return rows.mapInArrow(run, f"a {kind}, _item int, score double, pred_rank int")


def _joined_votes(votes: DataFrame, classes: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The same by joins, for any number of items."""
    every = (votes.select("a", "v", F.explode("items").alias("_item"))
             .groupBy("a", "_item").agg(F.sum("v").alias("score")))
    own = classes.select(F.col("class").alias("a"), F.explode("items").alias("_item"))
    fresh = every.join(own, ["a", "_item"], "left_anti").join(items, "_item")
    return rank_top(fresh.withColumn("_key", F.round("score", 9)), ["a"],
                    [F.desc("_key"), *map(F.asc, ITEM_KEYS)], k)


def nearest_based(known: DataFrame, least: float = 0.5, neighbours: int = 10, k: int = 10,
                  digits: int = 6) -> DataFrame:
    """T9 with a neighbour cut: every member's ``neighbours`` nearest members (cosine of at least
    ``least``; ties to the smaller member id) vote with their cosine; the ``k`` best conditions the
    member lacks, ties by condition and class. Members of equal sets have equal results: the others
    of their set come first and vote for nothing new."""
    of, classes, items = _classes(known)
    if _prefixes_help(classes, items, least):
        pairs = written(similar_classes(classes, least), "similar-classes")
    else:
        width = items.agg(F.max("_item")).first()[0]
        pairs = written(nearest_classes(classes, width, least, neighbours), "similar-classes")
    size = classes.select("class", "members")
    # of equal cosines the smaller ids come first, so the first classes hold the nearest members
    close = rank_top(pairs.withColumn("_c", F.round("cosine", 9)), ["a"],
                     [F.desc("_c"), F.asc("b")], neighbours, "_nr")
    firsts = rank_top(of.join(close.select(F.col("b").alias("class")).distinct(), "class",
                              "left_semi"), ["class"], [F.asc("member_id")], neighbours, "_at")
    voters = close.join(firsts.withColumnRenamed("class", "b"), "b").join(
        size.withColumnRenamed("class", "a"), "a")
    near = rank_top(voters, ["a"], [F.desc("_c"), F.asc("member_id")], neighbours, "_place")
    # the other members of the own set take the first places
    near = near.filter(F.col("_place") <= neighbours + 1 - F.col("members"))
    votes = (near.groupBy("a", "b").agg(F.sum("cosine").alias("v"))
             .join(classes.select(F.col("class").alias("b"), "items"), "b"))
    if items.count() <= DENSE_ITEMS:
        best = _dense_votes(votes, classes, items, k).join(items, "_item")
    else:
        best = _joined_votes(votes, classes, items, k)
    return (of.join(best.withColumnRenamed("a", "class"), "class")
            .select("member_id", *ITEM_KEYS, F.round("score", digits).alias("score"),
                    "pred_rank"))
