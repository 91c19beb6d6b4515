"""Best-two-fit packing of tokenized documents into fixed-length sequences.

``tokenize`` cuts every document into pieces of at most ``max_len`` tokens, ``best_two_fit``
places the pieces. Only the histogram of piece lengths (at most ``max_len`` numbers, whatever the
input) reaches the driver: equal lengths are interchangeable, so the packing is planned as bin
patterns with a repeat count, and each piece finds its place from its rank among the pieces of
its length. Ranks are counted inside each task and shifted by per-task prefix sums, so a length
shared by any share of all rows never meets in one task.

Defined results: null text is the empty text (one piece holding the end token alone); null ids
and repeated rows are kept, a piece per row; an empty table gives an empty result; other columns
of the input take no part.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, materialize, ragged_arange, utf8_buffers

MAX_TOKENS = 1024
END_ID = 2
CACHE_PIECES = 200_000          # pre-tokens a Python worker remembers before it starts anew
LATIN = 0x240                   # code points split by the table (lead byte below 0xC9)
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins for bytes that byte-level vocabulary files use."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_encoding(path: str):
    """A byte-level BPE vocabulary file (``tokenizers`` JSON) as a rank encoder with equal ids."""
    import tiktoken
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    sym = _byte_symbols()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(sym[c] for c in t): i for t, i in spec["model"]["vocab"].items()
             if t not in special}
    return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def added_tokens(path: str) -> dict[bytes, int]:
    """The added tokens of a vocabulary file, which are cut out of a text before it is split."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that look at their surroundings are not supported")
    return {t["content"].encode(): t["id"] for t in added}


def _char_classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space for the code points below LATIN."""
    import unicodedata
    cls = np.zeros(LATIN, np.uint8)
    for c in range(LATIN):
        kind = unicodedata.category(chr(c))[0]
        cls[c] = 1 if kind == "L" else 2 if kind == "N" else 0
    cls[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = 3
    return cls


class PieceEncoder:
    """Token ids of many texts at once. Pre-token borders are found by class changes over the code
    points of a whole chunk, equal pre-tokens are encoded once (64-bit hash of the code points),
    and ids are gathered. Texts with an apostrophe or a code point beyond the table take the
    encoder's own splitter; the ids are the same. With ``added`` the vocabulary's added tokens get
    their own ids, the texts around them are encoded apart (the library's default); without it
    they are plain text."""

    def __init__(self, path: str, added: bool = False):
        self.enc = load_encoding(path)
        self.added = added_tokens(path) if added else {}
        # at the same place the longest token wins
        self.marks = re.compile(b"(" + b"|".join(
            re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + b")")
        self.cls = _char_classes()
        self.cache: dict[int, list[int]] = {}
        self.powers = np.ones(1, np.uint64)

    def _powers(self, n: int) -> np.ndarray:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers), 256)
            p = np.full(size, 0x9E3779B97F4A7C15, np.uint64)
            p[0] = 1
            self.powers = np.multiply.accumulate(p)
        return self.powers

    def _fast(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n = len(cps)
        cls = self.cls[cps]
        first = np.zeros(n + 1, bool)
        first[np.concatenate(([0], np.cumsum(lens)))] = True
        first = first[:n]
        start = first.copy()
        space = cls == 3
        change = cls[1:] != cls[:-1]
        start[1:] |= change & (space[1:] | (cps[:-1] != 32))
        # a nonspace run after ' ' starts at that ' '; the last space of a run always starts
        start[:-1] |= space[:-1] & ~space[1:] & ~first[1:]
        at = np.flatnonzero(start)
        size = np.diff(np.append(at, n))
        inner = np.arange(n, dtype=np.int32) - np.repeat(at.astype(np.int32), size)
        h = self._powers(int(size.max()))[inner]
        h *= cps + np.uint32(1)
        h = np.add.reduceat(h, at)
        inv, uniq = pd.factorize(h)
        where = np.empty(len(uniq), np.int64)
        where[inv[::-1]] = np.arange(len(h))[::-1]
        cache, encode = self.cache, self.enc._encode_single_piece
        if len(cache) > CACHE_PIECES:
            cache.clear()
        found = []
        for key, a, s in zip(uniq.tolist(), at[where].tolist(), size[where].tolist()):
            ids = cache.get(key)
            if ids is None:
                ids = cache[key] = encode(joined[a:a + s])
            found.append(ids)
        count = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(count.sum()))
        begin = np.cumsum(count) - count
        per = count[inv]
        ids = flat[np.repeat(begin[inv], per) + ragged_arange(per)]
        total = np.concatenate(([0], np.cumsum(per)))
        cut = np.searchsorted(at, np.concatenate(([0], np.cumsum(lens))))
        return ids, np.diff(total[cut])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.added or not any(map(self.marks.search, texts)):
            return self._encode(texts)
        parts = [self.marks.split(t) for t in texts]        # text, token, text, ..., text
        around = iter(self._encode([t for p in parts for t in p[::2]]))
        return [np.concatenate([np.array([self.added[t]], np.uint32) if k % 2 else next(around)
                                for k, t in enumerate(p)]) for p in parts]

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        plain = [b"'" not in t and not (np.frombuffer(t, np.uint8) >= 0xC9).any() for t in texts]
        texts = [t.decode("utf-8", "replace") for t in texts]
        ids, counts = self._fast([t for t, p in zip(texts, plain) if p])
        ends = np.cumsum(counts).tolist()
        out, k, lo = [], 0, 0
        for t, p in zip(texts, plain):
            if p:
                out.append(ids[lo:ends[k]])
                lo, k = ends[k], k + 1
            else:
                out.append(np.array(self.enc.encode_ordinary(t), np.uint32))
        return out


def tokenize(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_TOKENS,
             end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
             keep_ids: bool = True) -> DataFrame:
    """Pieces of every document: (doc_id, piece, start, length, ids_crc32, task, task_rank[, ids]).
    A document's ids are its text's ids, then ``end_id``; only a longer one is cut, into pieces
    of ``max_len``, of which the first may be shorter. ``task_rank`` numbers the pieces of a
    length inside a task."""

    def run(batches):
        coder = PieceEncoder(tokenizer_path, added=True)
        seen = np.zeros(max_len + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            raw, off = utf8_buffers(batch.column(1))
            for lo, hi in chunks(off):
                texts = [raw[off[i]:off[i + 1]].tobytes() for i in range(lo, hi)]
                row, piece, start, length, crc, rank, kept = [], [], [], [], [], [], []
                for i, ids in enumerate(coder.encode(texts)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    a, k = 0, 0
                    b = len(ids) - max_len * ((len(ids) - 1) // max_len)
                    while a < len(ids):
                        row.append(lo + i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].tobytes()))
                        rank.append(int(seen[b - a]))
                        seen[b - a] += 1
                        if keep_ids:
                            kept.append(ids[a:b].astype(np.int32))
                        a, b, k = b, b + max_len, k + 1
                cols = [batch.column(0).take(pa.array(row, pa.int64())),
                        pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                        pa.array([task] * len(row), pa.int32()), pa.array(rank, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank"]
                if keep_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = ("doc_id long, piece int, start long, length long, ids_crc32 long, task int, "
              "task_rank long" + (", ids array<int>" if keep_ids else ""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def plan_bins(counts: np.ndarray, cap: int) -> list[tuple[list[int], int]]:
    """Bin patterns (lengths, repeats) for ``counts[l]`` pieces of length l.

    A bin takes the longest piece that fits until none does; then, while it holds more than one
    piece, its smallest gives way to two unpacked ones whose sum fills the widened gap more
    tightly. A pattern is repeated as long as every length it uses lasts: until then each new bin
    would make the same choices."""
    left = np.array(counts, np.int64)
    out = []
    index = np.arange(cap + 1)

    def last_free(free):
        return np.maximum.accumulate(np.where(free > 0, index, 0))

    while left.any():
        free, content, gap = left.copy(), [], cap
        below = last_free(free)
        while gap and (pick := int(below[gap])):
            content.append(pick)
            free[pick] -= 1
            gap -= pick
            if not free[pick]:
                below = last_free(free)
        while gap and len(content) > 1:
            small = content[-1]
            room = gap + small
            below = last_free(free)
            a = np.flatnonzero(free[:room] > 0)
            if not len(a):
                break
            b = below[np.minimum(a, room - a)]
            twice = (b == a) & (free[a] < 2)
            b = np.where(twice, below[np.maximum(a - 1, 0)], b)
            total = np.where(b > 0, a + b, 0)
            best = int(total.argmax())
            if total[best] <= small:
                break
            content.pop()
            free[small] += 1
            for x in (int(a[best]), int(b[best])):
                content.append(x)
                free[x] -= 1
            content.sort(reverse=True)
            gap = room - int(total[best])
        used = left - free
        repeat = int((left[used > 0] // used[used > 0]).min())
        left -= used * repeat
        out.append((content, repeat))
    return out


def slot_table(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Slots by (length, first rank): where the pieces of a length go, rank after rank."""
    taken: dict[int, int] = {}
    rows, seq = [], 0
    for content, repeat in patterns:
        place = 0
        for length in content:
            first = taken.get(length, 0)
            rows.append((length, first, seq, place))
            taken[length] = first + repeat
            place += length
        seq += repeat
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "first": a[:, 1], "seq": a[:, 2], "place": a[:, 3]}


def best_two_fit(pieces: DataFrame, max_len: int = MAX_TOKENS) -> DataFrame:
    """``pieces`` (from ``tokenize``, materialized) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    counts = materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "hist")
    hist = np.zeros(max_len + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # max_len rows at most
        hist[length] = n
    slots = spark.sparkContext.broadcast(slot_table(plan_bins(hist, max_len)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1)
    base = counts.select("task", "length",
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["task", "length"])
    keep = [c for c in pieces.columns if c not in ("task", "task_rank")]

    def place(batches):
        s = slots.value
        lo = np.searchsorted(s["length"], np.arange(max_len + 2))
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = (batch.column("base").to_numpy() + batch.column("task_rank").to_numpy())
            order = np.argsort(length, kind="stable")
            at = np.empty(len(length), np.int64)
            for l in np.unique(length):
                rows = order[np.searchsorted(length[order], l):
                             np.searchsorted(length[order], l, "right")]
                at[rows] = lo[l] + np.searchsorted(s["first"][lo[l]:lo[l + 1]], rank[rows],
                                                   "right") - 1
            seq = s["seq"][at] + rank - s["first"][at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(seq), pa.array(s["place"][at])],
                [*keep, "sequence_id", "offset"])

    kinds = dict(pieces.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_TOKENS,
                   keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack ``docs``: (doc_id, piece, start, length, ids_crc32[, ids],
    sequence_id, offset)."""
    return best_two_fit(materialize(tokenize(docs, tokenizer_path, max_len, keep_ids=keep_ids),
                                    "pieces"), max_len)
