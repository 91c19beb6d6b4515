"""Toxicity: a learned lexicon of words and word stems, matched fuzzily and judged in context.

* The lexicon is learned from labelled documents: whole words and word beginnings that are far
  more frequent in documents labelled toxic, chosen so that toxic documents are covered a few
  times each.
* Misspellings are caught by the intersection of Levenshtein automata with the lexicon's trie,
  determinised lazily: a state is the set of (trie node, edits) a word prefix can stand for, so a
  word costs a dictionary step per character.
* A hit inside quotation marks or near a reporting word counts as quotation, apart from abuse.
* The score is a logistic model over those counts.

``fit`` uses at most ``FIT_TOXIC`` + ``FIT_CLEAN`` labelled documents (the first by hash order);
everything else reads all rows and whole texts. Only the text is an input of a score.

Defined results: null and empty texts have no hits and get the model's base score; rows with null
or repeated ids get a row each; labels that are null or without a document are not used; with no
usable labels every score is ``BASE`` below one half; other columns take no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

FIT_TOXIC = 2_000               # most toxic labelled documents used for fitting
FIT_CLEAN = 6_000               # most other labelled documents used for fitting
FOLDS = 5                       # documents whose id hash is 0 modulo this are held out
STEMS = range(3, 11)            # lengths of word beginnings that may become lexicon stems
MIN_DOCS = 3
MIN_ODDS = 8.0
COVER = 3                       # times each toxic document is to be covered by the lexicon
WINDOW = 6                      # tokens to either side that decide on quotation
CACHE_WORDS = 400_000
BASE = 0.1
QUOTES = "\"'“”„«»‘’`"
REPORTING = frozenset("said says called calls quote quoted quotes word term insult slur insulted "
                      "wrote".split())
_INNER = re.compile(r"[^\W_]+(?:[0-9@$!*]+[^\W_]+)*")


def tokens(text: str) -> list[str]:
    return text.lower().split()


def words_of(token: str) -> list[str]:
    return _INNER.findall(token)


def edits_for(term: str) -> int:
    """Edits a term of this length may differ by."""
    n = len(term.rstrip("$"))
    return 0 if n < 5 else 1 if n < 9 else 2


class FuzzyTrie:
    """Terms ('word$' whole words, 'stem' word beginnings) and the lazily built automaton."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.slack = [0]            # most edits of any term below the node
        self.ends: list[list[int]] = [[]]
        self.terms = terms
        for k, term in enumerate(terms):
            allowed, node = edits_for(term), 0
            self.slack[0] = max(self.slack[0], allowed)
            for ch in term.rstrip("$"):
                nxt = self.children[node].get(ch)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][ch] = nxt
                    self.children.append({})
                    self.slack.append(0)
                    self.ends.append([])
                node = nxt
                self.slack[node] = max(self.slack[node], allowed)
            self.ends[node].append(k)
        self.states: list[dict[int, int]] = []
        self.ids: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.prefix_hits: list[dict[int, int]] = []
        self.word_hits: list[dict[int, int]] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a state, closed under skipped term characters."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                e = nodes[node] + 1
                if e <= self.slack[child] and e < nodes.get(child, 99):
                    nodes[child] = e
                    todo.append(child)
        key = frozenset(nodes.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(nodes)
            self.steps.append({})
            pre, whole = {}, {}
            for node, e in nodes.items():
                for k in self.ends[node]:
                    if e <= edits_for(self.terms[k]):
                        (whole if self.terms[k].endswith("$") else pre)[k] = e
            self.prefix_hits.append(pre)
            self.word_hits.append(whole)
        return self.ids[key]

    def _step(self, state: int, ch: str) -> int:
        nodes: dict[int, int] = {}
        for node, e in self.states[state].items():
            for c, child in self.children[node].items():
                cost = e + (c != ch)
                if cost <= self.slack[child] and cost < nodes.get(child, 99):
                    nodes[child] = cost
            if e + 1 <= self.slack[node] and e + 1 < nodes.get(node, 99):
                nodes[node] = e + 1
        nxt = self._state(nodes)
        self.steps[state][ch] = nxt
        return nxt

    def match(self, word: str) -> dict[int, int]:
        """Terms that ``word`` is or begins with, within their edits: term -> fewest edits."""
        state, found = self.start, {}
        for ch in word:
            nxt = self.steps[state].get(ch)
            state = self._step(state, ch) if nxt is None else nxt
            for k, e in self.prefix_hits[state].items():
                if e < found.get(k, 99):
                    found[k] = e
            if not self.states[state]:
                return found
        for k, e in self.word_hits[state].items():
            if e < found.get(k, 99):
                found[k] = e
        return found


class Matcher:
    """Counts of a text's hits: ({term: exact hits outside quotation}, fuzzy, quoted)."""

    def __init__(self, terms: list[str]):
        self.trie = FuzzyTrie(terms)
        self.cache: dict[str, tuple] = {}

    def _token(self, token: str) -> tuple:
        best: dict[int, int] = {}
        for w in words_of(token):
            for k, e in self.trie.match(w).items():
                if e < best.get(k, 99):
                    best[k] = e
        if not best:
            return ()
        least = min(best.values())
        return tuple((k, e) for k, e in best.items() if e == least)

    def hits(self, text: str) -> tuple[Counter, int, int]:
        toks = tokens(text)
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for t in set(toks).difference(cache):
            cache[t] = self._token(t)
        exact, fuzzy, quoted = Counter(), 0, 0
        for i, t in enumerate(toks):
            found = cache[t]
            if not found:
                continue
            if self.in_quotation(toks, i):
                quoted += 1
            elif found[0][1]:
                fuzzy += 1
            else:
                exact.update(k for k, _ in found)
        return exact, fuzzy, quoted

    @staticmethod
    def in_quotation(toks: list[str], i: int) -> bool:
        """Quotation marks open before and close after within the window, or a reporting word
        stands there."""
        lo, hi = max(0, i - WINDOW), min(len(toks), i + WINDOW + 1)
        opened = any(t[0] in QUOTES for t in toks[lo:i + 1])
        closed = any(t.rstrip(".,;:!?")[-1:] in tuple(QUOTES) for t in toks[i:hi])
        return opened and closed or any(t.strip(".,;:!?" + QUOTES) in REPORTING
                                        for t in toks[lo:hi])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded labelled sample: (toxic, weight-free text) of training-fold documents."""
    known = (labels.select(F.col("doc_id").cast("long").alias("k"),
                           F.col("toxic").cast("int").alias("y"))
             .filter("k is not null and y in (0, 1)").filter(~held_out(F.col("k"))))
    order = [F.xxhash64("k"), F.col("k")]
    ids = (known.filter("y = 1").orderBy(*order).limit(FIT_TOXIC)
           .unionByName(known.filter("y = 0").orderBy(*order).limit(FIT_CLEAN)))
    texts = docs.select(F.col("doc_id").cast("long").alias("k"),
                        F.col("text").cast("string").alias("text"))
    # at most FIT_TOXIC + FIT_CLEAN rows of 12 bytes are broadcast
    return materialize(texts.join(F.broadcast(ids), "k").select("y", "text"), "toxic-sample")


def _count_terms(batches):
    for batch in batches:
        bad, good = Counter(), Counter()
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = {w for t in set(tokens(text or "")) for w in words_of(t)}
            terms = {w[:n] for w in words for n in STEMS if len(w) >= n}
            terms.update(w + "$" for w in words if len(w) >= STEMS[0])
            (bad if y else good).update(terms)
        names = list(bad.keys() | good.keys())     # clean here may be toxic in another batch
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([bad[t] for t in names], pa.int64()),
             pa.array([good[t] for t in names], pa.int64())], ["term", "bad", "good"])


def choose_terms(rows: list[tuple[str, int, int]]) -> list[str]:
    """Drop a beginning that a longer term replaces at (nearly) the same coverage, and a longer
    term whose beginning was kept and is as pure."""
    bad = {t: (b, g) for t, b, g in rows}
    kept: list[str] = []
    longer: dict[str, int] = {}
    for t, (b, _) in bad.items():
        if len(t) > STEMS[0]:
            longer[t[:-1]] = max(longer.get(t[:-1], 0), b)
    pure = {t: (g + 0.5) / (b + 0.5) for t, (b, g) in bad.items()}
    chosen: set[str] = set()
    for t in sorted(bad, key=lambda t: (len(t), t)):
        if longer.get(t, 0) >= 0.97 * bad[t][0]:
            continue
        own = t.rstrip("$")
        if any(own[:n] in chosen and pure[own[:n]] <= 1.5 * pure[t] for n in STEMS
               if n <= len(own) and own[:n] != t):
            continue
        chosen.add(t)
        kept.append(t)
    return kept


def cover(rows: list[list[int]], terms: list[str]) -> list[str]:
    """Greedy choice of terms until every toxic document is covered COVER times where it can."""
    need = np.full(len(rows), COVER)
    member = np.zeros((len(rows), len(terms)), bool)
    for i, r in enumerate(rows):
        member[i, r] = True
    picked: list[int] = []
    while len(picked) < len(terms):
        gain = (member & (need > 0)[:, None]).sum(0)
        gain[picked] = 0
        best = int(gain.argmax())
        if gain[best] < 2:
            break
        picked.append(best)
        need[member[:, best]] -= 1
    return [terms[k] for k in picked]


def design(exact: Counter, fuzzy: int, quoted: int) -> dict[int, float]:
    """Sparse features: 0 any hit, 1 exact, 2 fuzzy, 3 quoted, 4.. the terms."""
    f = {4 + k: 1.0 for k in exact}
    n = sum(exact.values())
    if n:
        f[0], f[1] = 1.0, math.log1p(n)
    if fuzzy:
        f[2] = math.log1p(fuzzy)
    if quoted:
        f[3] = math.log1p(quoted)
    return f


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 0.5,
             rounds: int = 30) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the last column is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model: {"terms": [...], "weights": [...]} learned from the bounded sample."""
    sample = _sample(docs, labels)
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    none = {"terms": [], "weights": [0.0] * 4 + [math.log(BASE / (1 - BASE))]}
    if not sizes.get(1) or not sizes.get(0):
        return none
    # both classes enter with the weight their sample stands for
    total = (labels.filter("toxic in (0, 1) and doc_id is not null")
             .filter(~held_out(F.col("doc_id").cast("long")))
             .groupBy(F.col("toxic").cast("int").alias("y")).agg(F.count("*").alias("n")).collect())
    stands = {r["y"]: r["n"] for r in total}
    odds = ((F.col("bad") + 0.5) / (sizes[1] + 1)) / ((F.col("good") + 0.5) / (sizes[0] + 1))
    counted = (sample.repartition(16).mapInArrow(_count_terms, "term string, bad long, good long")
               .groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
               .filter((F.col("bad") >= MIN_DOCS) & (odds >= MIN_ODDS))
               .orderBy(F.desc("bad"), "good", "term").collect())
    terms = choose_terms([tuple(r) for r in counted])
    if not terms:
        return none

    def covered(batches):
        m = Matcher(terms)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([sorted(k for k in m.hits(t or "")[0])
                           for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))],
                ["terms"])

    rows = [r[0] for r in sample.filter("y = 1").mapInArrow(covered, "terms array<int>").collect()]
    terms = cover(rows, terms)
    if not terms:
        return none

    def designed(batches):
        m = Matcher(terms)
        for batch in batches:
            fs = [design(*m.hits(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([list(f) for f in fs], pa.list_(pa.int32())),
                 pa.array([list(f.values()) for f in fs], pa.list_(pa.float64()))],
                ["y", "at", "value"])

    got = sample.mapInArrow(designed, "y int, at array<int>, value array<double>").collect()
    x = np.zeros((len(got), 4 + len(terms)))
    y = np.array([r[0] for r in got], float)
    for i, r in enumerate(got):
        x[i, r[1]] = r[2]
    scale = np.where(y == 1, stands[1] / sizes[1], stands[0] / sizes[0])
    order = np.lexsort(np.vstack([x.T, y]))     # rows come in any order; sums must not depend on it
    w = logistic(x[order], y[order], (scale / scale.mean())[order])
    return {"terms": terms, "weights": w.tolist()}


def with_scores(docs: DataFrame, model: dict, column: str = "score") -> DataFrame:
    """``docs``, every column as it is, with the score of its ``text`` as ``column``."""
    if column in docs.columns:
        raise ValueError(f"{column} is a column of the input")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [*docs.columns, column]
    at = docs.columns.index("text")

    def run(batches):
        m, w = Matcher(sent.value["terms"]), sent.value["weights"]
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                z = w[-1] + sum(w[k] * v for k, v in design(*m.hits(text or "")).items())
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields,
                                              T.StructField(column, T.DoubleType())]))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.col("text").cast("string").alias("text"))
    return with_scores(own, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
