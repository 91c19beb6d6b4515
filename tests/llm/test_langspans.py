"""Language spans: Viterbi against all labellings, planted mixed texts, held-out accuracy."""
import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from carelens.llm import langspans as ls

from .samples import DOC_SCHEMA, documents, with_clashes

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, label string, n string, spans string"


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(4)
    size = [0, 1, 6, 3, 5, 0, 2]
    off = np.concatenate(([0], np.cumsum(size)))
    score, start = -6 * rng.random((off[-1], 3)), np.log([0.5, 0.3, 0.2])
    got = ls.viterbi(score, off, start, 2.5)
    for a, b in zip(off[:-1], off[1:]):
        def value(path):
            return (start[path[0]] + sum(score[a + i, x] for i, x in enumerate(path))
                    - 2.5 * sum(x != y for x, y in zip(path, path[1:])))
        if b > a:
            best = max(value(p) for p in itertools.product(range(3), repeat=b - a))
            assert abs(value(got[a:b].tolist()) - best) < 1e-9


def test_features_of_a_word_do_not_depend_on_others():
    words = ["a", "der", "über", "Wörter", "中文", "x" * 70]
    bucket, starts, script, length = ls.features(words)
    ends = [*starts[1:], len(bucket)]
    for k, w in enumerate(words):
        one, _, s, n = ls.features([w])
        assert sorted(one) == sorted(bucket[starts[k]:ends[k]])
        assert s[0] == script[k] and n[0] == length[k] == len(w)
        # strings of two to four letters with both borders, and the word
        assert len(one) == sum(max(0, len(w) + 3 - m) for m in ls.ORDERS) + 1
    assert [ls.NAMES[s] for s in script[:5]] == ["latin"] * 4 + ["han"]


def labelled(n=240):
    rng = random.Random(6)
    parts = {"aa": "the of and ing tion er", "bb": "der die und ung schen", "cc": "привет мир как"}
    def text(lang, words):
        p = parts[lang].split()
        return " ".join(rng.choice(p) + rng.choice(p) for _ in range(words))
    rows = [(i, text(x, rng.randint(5, 60)), x) for i in range(n) for x in [list(parts)[i % 3]]]
    return rows, text


def test_spans_of_mixed_texts_and_scripts(spark):
    rows, text = labelled()
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    model = ls.fit(docs)
    assert model["names"] == ["aa", "bb", "cc"]
    latin, cyrillic = ls.NAMES.index("latin"), ls.NAMES.index("cyrillic")
    assert model["candidate"][latin].tolist() == [True, True, False]
    assert model["candidate"][cyrillic].tolist() == [False, False, True]
    a, b, c = (" ".join(text(x, 12).split()) for x in ("aa", "bb", "cc"))
    mixed = [(1, f"1. {a}! {b}\n {c}"), (2, f"{b} 12 {a}"), (3, "中文 中文"), (4, "12 ?!"),
             (5, None), (6, ""), (7, f"{a} 中文 {a}"), (None, b), (1, c)]
    got = ls.identify(with_clashes(spark, mixed, DOC_SCHEMA), model).collect()
    assert len(got) == len(mixed)
    by = {(r["doc_id"], len(r["spans"])): r for r in got}
    first = by[1, 3]
    whole = mixed[0][1]
    assert [(s["lang"], whole[s["start"]:s["stop"]]) for s in first["spans"]] == \
        [("aa", a), ("bb", b), ("cc", c)]
    assert [s["lang"] for s in by[2, 2]["spans"]] == ["bb", "aa"]
    assert by[4, 0]["lang_pred"] == by[5, 0]["lang_pred"] == by[6, 0]["lang_pred"] == "und"
    assert by[3, 1]["lang_pred"] in model["names"] and by[7, 1]["lang_pred"] == "aa"
    assert by[None, 1]["lang_pred"] == "bb" and by[1, 1]["lang_pred"] == "cc"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_nothing_to_learn_from_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(1, "word", None), (None, "word", "en")], schema)
    model = ls.fit(docs)
    got = ls.identify(docs, model).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2
    assert ls.identify(spark.createDataFrame([], schema), model).collect() == []
    assert ls.fit(spark.createDataFrame([], schema))["names"] == []


def test_awkward_texts_and_small_batches(spark, monkeypatch):
    rows, _ = labelled()
    model = ls.fit(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA))
    docs = with_clashes(spark, documents(), DOC_SCHEMA)
    def result():
        return sorted(((r["doc_id"], r["lang_pred"], round(r["score"], 9), str(r["spans"]))
                       for r in ls.identify(docs, model).collect()), key=repr)
    want = result()
    monkeypatch.setattr(ls, "CELLS", 30)
    assert result() == want and len(want) == len(documents())


def test_held_out_accuracy_and_folds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = ls.fit(docs)
    out = ls.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").select(
        "doc_id", "lang", "lang_pred", ls.held_out(F.col("doc_id")).alias("h")).collect()
    held = [r for r in out if r["h"]]
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.995 * len(held)
    # labels of the held-out fold change nothing
    wrong = docs.withColumn("lang", F.when(ls.held_out(F.col("doc_id")), F.lit("zz"))
                            .otherwise(F.col("lang")))
    other = ls.fit(wrong)
    assert other["names"] == model["names"] and (other["logs"] == model["logs"]).all()
