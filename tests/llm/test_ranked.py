"""Ranked search against scores of every item and document."""
import math
import random
import re
from collections import Counter

import numpy as np

from carelens.llm import ranked

from .samples import DOC_SCHEMA, documents, prose, with_clashes

ITEM_SCHEMA = "item_id long, text string"
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items, k):
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    total, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(words(t))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, c, n in held:
            m = 50 + (50 * n * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                    * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def items():
    rng = random.Random(8)
    docs = [t for _, t in documents() if t]
    out = [(i, " ".join(words(rng.choice(docs))[:rng.randint(1, 45)])) for i in range(25)]
    return out + [(40, prose(2, 260)), (41, prose(90, 400)), (42, None), (43, ""), (44, "?!"),
                  (45, "nowhere-to-be-found 0000"), (None, "lost words"), (46, "one"), (46, "TWO")]


def result(df):
    return sorted(tuple(r[c] for c in ("item_id", "rank", "doc_id", "score"))
                  for r in df.collect())


def test_against_all_scores(spark):
    docs, asked = documents(), items()
    for k in (1, 50):
        got = result(ranked.search(with_clashes(spark, docs, DOC_SCHEMA),
                                   with_clashes(spark, asked, ITEM_SCHEMA), k))
        assert got == brute(docs, asked, k)


def test_blocks_passes_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(ranked, "VOCABULARY_BYTES", 900)
    monkeypatch.setattr(ranked, "TERMS", 60)
    monkeypatch.setattr(ranked, "CELLS", 1)
    docs, asked = documents(), items()
    got = result(ranked.search(spark.createDataFrame(docs, DOC_SCHEMA).repartition(5),
                               spark.createDataFrame(asked, ITEM_SCHEMA), 7))
    assert got == brute(docs, asked, 7)


def test_equal_scores_go_to_smaller_ids(spark):
    docs = [(i, "same words here") for i in range(300, 0, -1)] + [(0, "other")]
    got = result(ranked.search(spark.createDataFrame(docs, DOC_SCHEMA).repartition(9),
                               spark.createDataFrame([(1, "words and more")], ITEM_SCHEMA), 50))
    assert [r[2] for r in got] == (list(range(1, 51)) if got else [])
    assert got == brute(docs, [(1, "words and more")], 50)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOC_SCHEMA), spark.createDataFrame([(1, "a")],
                                                                              ITEM_SCHEMA)
    assert result(ranked.search(none, some)) == []
    assert result(ranked.search(spark.createDataFrame([(1, "a")], DOC_SCHEMA),
                                spark.createDataFrame([], ITEM_SCHEMA))) == []


def test_masks_group_documents():
    present = np.array([[1, 0, 1, 1], [0, 0, 0, 1], [1, 1, 1, 0]], np.uint8)
    masks, docs, starts = ranked._masks(present)
    got = {tuple(m): sorted(docs[starts[i]:starts[i + 1]]) for i, m in enumerate(masks.tolist())}
    assert got == {(1, 0, 1): [0, 2], (0, 0, 1): [1], (1, 1, 0): [3]}
