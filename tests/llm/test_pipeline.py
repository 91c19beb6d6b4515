"""The pipeline: columns, each stage's decisions against brute force, packing of what is left."""
import pytest

import corpus_pipeline as P
from carelens.llm import toxicity
from carelens.llm.common import materialize

from . import test_decontaminate, test_neardup, test_secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What every stage made of its predecessor's rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs))
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_stay(steps):
    assert [n for n, _ in steps[1:]] == ["toxicity", "near_dedup", "decontamination",
                                         "secret_scan", "packing"]
    for _, df in steps[1:-1]:
        assert df.columns == steps[0][1].columns


def test_decisions_take_effect(spark, steps):
    docs, clean, single, fresh, masked, packed = (df for _, df in steps)
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["predicted"]}
    assert rows(clean) == {i: t for i, t in rows(docs).items() if i not in toxic} and toxic
    groups = test_neardup.brute(list(rows(clean).items()), P.SHINGLE_WORDS)
    assert set(rows(single)) == {i for i, _, _, kept in groups if kept}
    items = [(r["item_id"], r["text"]) for r in
             spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {i for i, _, n, _ in test_decontaminate.brute(list(rows(single).items()), items) if n}
    assert set(rows(fresh)) == set(rows(single)) - hit
    for i, text in rows(fresh).items():
        assert (rows(masked)[i] == text) == (not test_secrets.scan(text)) if i % 10 == 0 else True
    assert {r["doc_id"] for r in packed.collect()} == set(rows(masked))
    sums = {}
    for r in packed.collect():
        sums[r["sequence_id"]] = sums.get(r["sequence_id"], 0) + r["length"]
    assert max(sums.values()) <= 1024


def test_run_equals_the_stages(spark, steps):
    got = P.run(spark, SF)
    assert got.columns == steps[-1][1].columns
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, got.collect())) == sorted(map(key, steps[-1][1].collect()))


def test_clashing_columns_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for name in ("dropped_id", "Dropped_Id_", "toxicity_score", "text_key", "__text_key",
                 "found_spans", "__spans"):
        docs = docs.withColumn(name, docs["source"])
    docs = materialize(docs, "clashing")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert all(r["dropped_id"] == r["__text_key"] == r["__spans"] == r["source"]
                   for r in out.collect())
