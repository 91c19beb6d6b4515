"""Decontamination against a scan of all windows; proximity against a scan of all places."""
import re

from pyspark.sql import functions as F

from carelens.llm import decontaminate as D

from .samples import DOC_SCHEMA, documents, prose, with_clashes

ITEM_SCHEMA = "item_id long, text string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def items():
    other = prose(2, 260)
    return [(1, " ".join(other.split()[5:40])), (2, "One"), (3, "one two"), (4, None), (5, "--"),
            (6, "absent words here"), (10, " ".join(other.split()[30:52])), (7, "ab " * 12),
            (None, "one"), (2, "one"), (8, prose(10, 9)), (9, "É" * 49)]


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        if i is not None:
            for k in range(max(1, len(w) - 9) if w else 0):
                wins.setdefault(tuple(w[k:k + 10]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, named = words(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in wins:
                    hit.update(range(k, k + size))
                    named |= wins[tuple(w[k:k + size])]
        out.append((d, len(w), len(hit), sorted(named)))
    return sorted(out, key=repr)


def test_against_all_windows(spark):
    docs = documents()
    found = D.contamination(with_clashes(spark, docs, DOC_SCHEMA),
                            with_clashes(spark, items(), ITEM_SCHEMA))
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()),
                 key=repr)
    assert got == brute(docs, items())


def test_empty_tables(spark):
    none_docs = spark.createDataFrame([], DOC_SCHEMA)
    none_items = spark.createDataFrame([], ITEM_SCHEMA)
    some = spark.createDataFrame(documents()[:6], DOC_SCHEMA)
    assert D.contamination(none_docs, spark.createDataFrame(items(), ITEM_SCHEMA)).collect() == []
    assert {r["n_hit"] for r in D.contamination(some, none_items).collect()} == {0}


def test_proximity(spark):
    text = "red apple then a green pear and red big apple so green then the pear"
    docs = spark.createDataFrame([(1, text)], DOC_SCHEMA)
    wins, _ = D.test_windows(spark.createDataFrame([(1, "red apple")], ITEM_SCHEMA))
    index, vocabulary = D.build_index(docs, wins)

    def count(slack):
        return D.matches(index, vocabulary, wins, slack).select("row", "start").distinct().count()

    assert count(0) == 1
    assert count(1) == 2


def test_no_python_on_the_main_path(spark):
    wins, _ = D.test_windows(spark.createDataFrame(items(), ITEM_SCHEMA))
    plan = (spark.createDataFrame(documents(), DOC_SCHEMA)
            .select(D.words(F.col("text")))._jdf.queryExecution().toString())
    assert "Python" not in plan and "Arrow" not in plan
