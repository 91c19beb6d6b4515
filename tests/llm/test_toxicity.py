"""Toxicity: automata against edit distance, context, held-out accuracy, awkward rows."""
import random
import zlib

import pyarrow as pa

from carelens.llm import toxicity as X

from .samples import DOC_SCHEMA, documents, with_clashes

LABELS = "doc_id long, quality int, toxic int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automata_equal_edit_distance():
    terms = ["idiot$", "moron$", "worthless$", "scum$", "loweit", "veq", "pathet", "disgustingly$"]
    trie = X.FuzzyTrie(terms)
    rng = random.Random(6)
    words = [t.rstrip("$") for t in terms] + ["", "a", "idoit", "idiott", "worthles", "w0rthl3ss"]
    for _ in range(1500):
        w = list(rng.choice(words))
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(w))
            w[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "o", "t", "e"])
        words.append("".join(w))
    for word in words:
        want = {}
        for k, t in enumerate(terms):
            stem, allowed = t.rstrip("$"), X.edits_for(t)
            d = distance(word, stem) if t.endswith("$") else min(
                distance(word[:n], stem) for n in range(len(word) + 1))
            if d <= allowed:
                want[k] = d
        assert trie.match(word) == want, word


def test_quotation_is_told_apart():
    m = X.Matcher(["moron$"])
    assert m.hits("you are a moron truly")[0] == {0: 1}
    assert m.hits('he wrote "moron" there')[2] == 1
    assert m.hits("they used the word moron there")[2] == 1
    assert m.hits("you m0ron!!")[1] == 1
    exact, fuzzy, quoted = m.hits("")
    assert not exact and not fuzzy and not quoted


def corpus(n=600):
    rng = random.Random(9)
    bad = ["blarg", "snoffle", "quizzer"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + rng.choice("abcdef")
                 for _ in range(rng.randint(5, 40))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d, l = spark.createDataFrame(docs, DOC_SCHEMA), spark.createDataFrame(labels, LABELS)
    truth = {i: t for i, _, t in labels}
    for r in X.score(d, X.fit(d, l)).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5)
        assert r["predicted"] == truth[r["doc_id"]]


def test_held_out_labels_are_not_read(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, DOC_SCHEMA)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    one = X.fit(d, spark.createDataFrame(labels, LABELS))
    two = X.fit(d, spark.createDataFrame(turned, LABELS))
    assert one["terms"] == two["terms"]


def test_held_out_labels_do_not_move_the_weights(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, DOC_SCHEMA)
    turned = [(i, q, 1 if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    one = X.fit(d, spark.createDataFrame(labels, LABELS))
    two = X.fit(d, spark.createDataFrame(turned, LABELS))
    assert one["terms"] and one == two


def test_term_counts_do_not_depend_on_batches():
    rows = [(1, "blarg alpha"), (1, "blarg snoffle"), (0, "alpha omega"), (0, "omega blarg"),
            (0, "alpha snoffle")]

    def counts(batches):
        total = {}
        for r in X._count_terms(pa.RecordBatch.from_arrays(
                [pa.array([y for y, _ in b]), pa.array([t for _, t in b])], ["y", "text"])
                for b in batches):
            for t, b, g in zip(*(c.to_pylist() for c in r.columns)):
                one = total.setdefault(t, [0, 0])
                one[0] += b
                one[1] += g
        return total

    whole = counts([rows])
    assert whole["alpha$"] == [1, 2] and whole["omega$"] == [0, 2]
    assert counts([[r] for r in rows]) == whole


def test_awkward_rows(spark):
    docs, labels = corpus(300)
    docs, labels = [(1000 + i, t) for i, t in docs], [(1000 + i, *r) for i, *r in labels]
    rows = docs + documents()
    strange = labels + [(None, 1, 1), (1005, None, None), (99999, 0, 1), (1006, 1, 7)]
    d = with_clashes(spark, rows, DOC_SCHEMA)
    model = X.fit(d, spark.createDataFrame(strange, LABELS))
    got = X.score(d, model).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    empty = [r["score"] for r in got if r["doc_id"] in (17, 18, 19)]
    assert max(empty) < 0.5
    none = X.fit(d, spark.createDataFrame([], LABELS))
    assert {r["predicted"] for r in X.score(d, none).collect()} == {0}
    assert X.score(spark.createDataFrame([], DOC_SCHEMA), model).collect() == []
