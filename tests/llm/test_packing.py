"""Tokens against the tokenizers library; packing by its invariants."""
import zlib

import numpy as np
import pytest

from carelens.llm import packing
from carelens.llm.catalog import tokenizer_file

from .samples import DOC_SCHEMA, documents, with_clashes


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_file())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(library):
    texts = [t or "" for _, t in documents()]
    texts += ["", " ", "  a", "a  b \n\n c\t d\n", "it's ''s x'll", "\n", " x   x\x85", "a \n",
              "a 1b2 ,,x !! \t", "<|endoftext|> x", "  a", "ÀÉ ñ12 ß!"]
    got = packing.PieceEncoder(tokenizer_file()).encode([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [library(t) for t in texts]


def test_added_tokens_equal_the_library_as_it_is(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_file())
    texts = [x or "" for _, x in documents()]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "", "it's a ",
              "  <|endoftext|>\n\n <|endoftext", "é'll  <|endoftext|>  中文 ", "a <|ENDOFTEXT|>"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert want[texts.index("a <|endoftext|> b")] == [64, 220, 50256, 275]
    coder = packing.PieceEncoder(tokenizer_file(), added=True)
    assert [g.tolist() for g in coder.encode([x.encode() for x in texts])] == want
    df = spark.createDataFrame([(1, "a <|endoftext|> b")], DOC_SCHEMA)
    assert [r["ids"] for r in packing.pack_documents(df, tokenizer_file(), keep_ids=True).collect()
            ] == [[64, 220, 50256, 275, 2]]


def test_pieces_and_places(spark, library):
    rows = documents()
    df = with_clashes(spark, rows, DOC_SCHEMA)
    got = packing.pack_documents(df, tokenizer_file(), keep_ids=True).collect()
    want = []
    for i, text in rows:
        ids = [*library(text), 2]
        first = len(ids) - 1024 * ((len(ids) - 1) // 1024)
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), ids[a:b])
                 for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], r["ids"])
                   for r in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty_table(spark):
    df = spark.createDataFrame([], DOC_SCHEMA)
    assert packing.pack_documents(df, tokenizer_file()).collect() == []


def test_two_replace_the_smallest():
    # 60 leaves a gap of 40 that 30 fills to 90; 22 + 18 fill it better
    counts = np.zeros(101, np.int64)
    counts[[60, 30, 22, 18]] = 1
    first = packing.plan_bins(counts, 100)[0]
    assert first == ([60, 22, 18], 1)


def test_plans_are_near_the_bound():
    rng = np.random.default_rng(5)
    counts = np.bincount(rng.integers(1, 1025, 50_000), minlength=1025)
    plan = packing.plan_bins(counts, 1024)
    used = np.zeros(1025, np.int64)
    for content, repeat in plan:
        assert sum(content) <= 1024
        np.add.at(used, content, repeat)
    assert (used == counts).all()
    bound = -(-int((counts * np.arange(1025)).sum()) // 1024)
    assert sum(r for _, r in plan) <= 1.01 * bound
