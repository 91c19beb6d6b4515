"""Language identification of mixed-language text.

* Script ranges narrow the candidates: of a word's script (that of its first letter) only those
  languages are candidates whose training text has at least MIN_SHARE of its letters in it.
* Per-word scores: the log probability of a word's character strings (two to four letters with
  the word's borders, and the whole word) in each language, learned from labelled documents, as the
  distance to the best candidate, at most CAP.
* Viterbi over the words of a text with a penalty for every switch of language labels spans; of the
  languages that have spans, that with the best total score over the text is the text's.

``fit`` learns from at most FIT_DOCS labelled documents a language (first by id hash), none of them
held out; its tables are BUCKETS counts a language. ``identify`` reads every whole text, in batches
whose Viterbi steps run over all texts of a batch at once.

Defined results: null texts and texts without letters have no spans, language ``und`` and score 0;
so has everything where no language was learned; words in a script of no learned language say nothing
and take the language around them; rows that repeat or lack an id are rows of their own, and those
without id are neither held out nor learned from; equal totals go to the first name; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix64, ragged_arange

FIT_DOCS = 2_000                # documents a language that the model is fitted on
FOLDS, HELD_OUT = 3, 1
BUCKETS = 1 << 17
ORDERS = (2, 3, 4)              # lengths of character strings, borders counted
SMOOTH = 0.2
MIN_SHARE = 0.01
CAP = 6.0                       # most that one word says against a language
SWITCH = 9.0                    # penalty of a switch
CELLS = 2 << 20                 # words x languages of a batch
NONE = "und"
WORD = re.compile(r"[^\W\d_]+")
# The first code points of blocks and their scripts (Unicode block ranges); a block
# ends where the next begins.
SCRIPTS = [(0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"),
           (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x750, "arabic"),
           (0x780, "other"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"),
           (0xA80, "gujarati"), (0xB00, "oriya"), (0xB80, "tamil"), (0xC00, "telugu"),
           (0xC80, "kannada"), (0xD00, "malayalam"), (0xD80, "sinhala"), (0xE00, "thai"),
           (0xE80, "lao"), (0xF00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
           (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
           (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
           (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"),
           (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"),
           (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"),
           (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"),
           (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"),
           (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"),
           (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
           (0x30000, "other")]
NAMES = sorted({name for _, name in SCRIPTS})
FIRSTS = np.array([first for first, _ in SCRIPTS])
SCRIPT_OF = np.array([NAMES.index(name) for _, name in SCRIPTS])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, starts): the buckets of the words' character strings, grouped by word from
    starts; (script, letters) of every word."""
    code = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
    code = code.astype(np.uint64)
    border = code == 0
    word = np.cumsum(border) - 1            # a border belongs to the word after it
    first = np.flatnonzero(border)[:-1] + 1
    length = np.diff(np.flatnonzero(border)) - 1
    script = SCRIPT_OF[np.searchsorted(FIRSTS, code[first].astype(np.int64), "right") - 1]
    owners, values = [], []
    for n in ORDERS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        inside = np.ones(m, bool)
        for i in range(1, n - 1):
            inside &= ~border[i:m + i]
        value = np.full(m, n, np.uint64)
        for i in range(n):
            value = value * np.uint64(0x100000001B3) + code[i:m + i]
        at = np.flatnonzero(inside)
        owners.append(word[at])
        values.append(value[at])
    place = ragged_arange(length).astype(np.uint64)
    letters = np.repeat(first, length) + ragged_arange(length)
    whole = np.add.reduceat(mix64((code[letters] << np.uint64(32)) + place),
                            np.cumsum(length) - length)
    owners.append(np.arange(len(words)))
    values.append(whole)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    bucket = (mix64(np.concatenate(values)) & np.uint64(BUCKETS - 1)).astype(np.int64)[order]
    return bucket, np.searchsorted(owner[order], np.arange(len(words))), script, length


def _count(batches):
    """(lang, bucket, n) of the words of a task's documents; the scripts' letters stand in the
    buckets from BUCKETS on."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts = Counter(WORD.findall((text or "").lower()))
            if not counts:
                continue
            bucket, starts, script, length = features(list(counts))
            times = np.fromiter(counts.values(), np.int64, len(counts))
            total = held.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
            size = np.diff(np.append(starts, len(bucket)))
            np.add.at(total, bucket, np.repeat(times, size))
            np.add.at(total, BUCKETS + script, times * length)
    for lang, total in held.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])],
            ["lang", "bucket", "n"])


def fit(docs: DataFrame) -> dict:
    """The model: languages, their log shares, tables of log probabilities and candidates by
    script. Learned from the labelled documents that are not held out."""
    known = docs.select(F.col("doc_id").cast("long").alias("k"),
                        F.col("lang").cast("string").alias("lang"),
                        F.col("text").cast("string").alias("text")).filter(
        "k is not null and lang is not null").filter(~held_out(F.col("k")))
    totals = materialize(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    # ids first: the texts of the sample alone are moved; of every language about twice the rows
    # that are wanted reach the task that takes the first
    draw = F.pmod(F.xxhash64("k"), F.lit(1 << 30))
    some = (known.select("lang", "k").join(F.broadcast(totals), "lang")
            .filter(draw * F.col("n") < 2 * FIT_DOCS * (1 << 30)))
    by_hash = Window.partitionBy("lang").orderBy(draw, "k")
    ids = (some.withColumn("nr", F.row_number().over(by_hash)).filter(F.col("nr") <= FIT_DOCS)
           .select(F.col("lang").alias("of"), F.col("k").alias("id")))
    # a row a language, and FIT_DOCS a language
    sample = materialize(known.join(F.broadcast(ids), (F.col("k") == F.col("id"))
                                    & (F.col("lang") == F.col("of")), "left_semi")
                         .select("lang", "text"), "language-sample")
    counts = (sample.repartition(16).mapInArrow(_count, "lang string, bucket long, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    share = {r["lang"]: r["n"] for r in totals.collect()}
    names = sorted(set(counts.column("lang").to_pylist()))
    if not names:
        return {"names": []}
    table = np.zeros((BUCKETS + len(NAMES), len(names)))
    number = {x: i for i, x in enumerate(names)}
    table[counts.column("bucket").to_numpy(),
          [number[x] for x in counts.column("lang").to_pylist()]] = counts.column("n").to_numpy()
    letters, table = table[BUCKETS:], table[:BUCKETS]
    logs = np.log(table + SMOOTH) - np.log(table.sum(0) + SMOOTH * BUCKETS)
    start = np.log([share[x] for x in names])
    return {"names": names, "logs": logs.astype(np.float32),
            "candidate": letters >= MIN_SHARE * letters.sum(0),
            "start": start - np.log(np.exp(start - start.max()).sum()) - start.max()}


def word_scores(words: list[str], model: dict) -> np.ndarray:
    """(words, languages): how far each language lies below the best candidate, down to -CAP."""
    if not words:
        return np.zeros((0, len(model["names"])), np.float32)
    out = np.empty((len(words), len(model["names"])), np.float32)
    for lo in range(0, len(words), 1 << 16):
        bucket, starts, script, _ = features(words[lo:lo + (1 << 16)])
        size = np.diff(np.append(starts, len(bucket)))
        score = np.add.reduceat(model["logs"][bucket], starts, axis=0)
        score *= (len(ORDERS) + 1) / np.maximum(size, len(ORDERS) + 1)[:, None]
        open_to = model["candidate"][script]
        some = open_to.any(1)
        score = np.where(open_to, score, -np.inf)
        best = score.max(1, keepdims=True)
        score = np.maximum(np.where(np.isfinite(score), score - np.where(some[:, None], best, 0),
                                    -CAP), -CAP)
        out[lo:lo + len(score)] = np.where(some[:, None], score, 0)
    return out


def viterbi(score: np.ndarray, off: np.ndarray, start: np.ndarray, switch: float) -> np.ndarray:
    """The language of every word: row ranges ``off`` of ``score`` are texts. Staying is preferred
    to a switch of equal value, an earlier language to a later one."""
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    label = np.zeros(len(score), np.int16)
    if not len(order):
        return label
    begin, steps = off[:-1][order], int(size[order[0]])
    active = np.searchsorted(-size[order], -np.arange(steps), "left")   # texts longer than t
    stay = np.ones(score.shape, bool)
    source = np.zeros(len(score), np.int16)
    state = np.zeros(len(order), np.int16)
    value = start + score[begin].astype(float)
    for t in range(1, steps + 1):
        n = active[t] if t < steps else 0
        if n < len(value):
            state[n:len(value)] = value[n:].argmax(1)
            value = value[:n]
        if not n:
            break
        at = begin[:n] + t
        top = value.argmax(1)
        jump = value[np.arange(n), top] - switch
        keep = value >= jump[:, None]
        stay[at], source[at] = keep, top
        value = np.where(keep, value, jump[:, None]) + score[at]
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at, now = begin[:n] + t, state[:n]
        label[at] = now
        if t:
            state[:n] = np.where(stay[at, now], now, source[at])
    return label


def _spans(text: str, words: list[str], label: np.ndarray, names: list[str]) -> list[dict]:
    """Runs of equal labels as code point ranges, from the first word's start to the last's end."""
    cuts = np.flatnonzero(np.diff(label)) + 1
    if not len(cuts):
        return [{"start": text.find(words[0]), "stop": text.rfind(words[-1]) + len(words[-1]),
                 "lang": names[label[0]]}]
    wanted, bounds = set(cuts.tolist()), []
    for i, m in enumerate(WORD.finditer(text)):
        if i == 0:
            begin = m.start()
        elif i in wanted:
            bounds.append((begin, end))
            begin = m.start()
        end = m.end()
    bounds.append((begin, end))
    return [{"start": a, "stop": b, "lang": names[label[i]]}
            for (a, b), i in zip(bounds, [0, *cuts])]


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())]))


def label_texts(texts: list[list[str]], model: dict) -> list[tuple[np.ndarray, int, float]]:
    """Per text (its words): the words' languages, the text's and the score."""
    known: dict[str, int] = {}
    index = [np.fromiter((known.setdefault(w.lower(), len(known)) for w in words), np.int64,
                         len(words)) for words in texts]
    own = word_scores(list(known), model)
    size = np.array([len(i) for i in index])
    off = np.concatenate(([0], np.cumsum(size)))
    score = own[np.concatenate(index)] if len(index) else own
    label = viterbi(score, off, model["start"], SWITCH)
    letters = np.fromiter((len(w) for words in texts for w in words), np.int64, int(off[-1]))
    out = []
    for k in range(len(texts)):
        a, b = off[k], off[k + 1]
        weight = np.bincount(label[a:b], letters[a:b], len(model["names"]))
        total = model["start"] + score[a:b].sum(0, dtype=float)
        lang = int(np.where(weight > 0, total, -np.inf).argmax())
        sure = 1 / np.exp(np.minimum(total - total[lang], 700)).sum()
        out.append((label[a:b], lang, float(weight[lang] / weight.sum() * sure)))
    return out


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every document. spans: (start, stop, lang) of the
    labelled stretches in code points; score: the share of letters in spans of lang_pred times its
    posterior over the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.col("text").cast("string").alias("text"))

    def run(batches):
        model = sent.value
        names = model["names"]
        most = CELLS // max(1, len(names))
        for batch in batches:
            ids, held, n = [], [], 0
            out = []

            def settle():
                some = [k for k, (_, words) in enumerate(held) if words and names]
                found = dict(zip(some, label_texts([held[k][1] for k in some], model)
                                 if some else []))
                for k, (text, words) in enumerate(held):
                    if k in found:
                        label, lang, score = found[k]
                        out.append((ids[k], names[lang], score,
                                    _spans(text, words, label, names)))
                    else:
                        out.append((ids[k], NONE, 0.0, []))

            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORD.findall(text or "")
                ids.append(doc_id)
                held.append((text, words))
                n += len(words)
                if n >= most:
                    settle()
                    ids, held, n = [], [], 0
            settle()
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()),
                 pa.array(cols[2], pa.float64()), pa.array(cols[3], SPAN)],
                ["doc_id", "lang_pred", "score", "spans"])

    return own.mapInArrow(run, "doc_id long, lang_pred string, score double, "
                               "spans array<struct<start:long,stop:long,lang:string>>")
