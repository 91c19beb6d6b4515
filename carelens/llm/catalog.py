"""Registered queries of the subpackage: each applies one operator, with production parameters,
to its whole table and derives the digest columns of its contract from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, chat, convrepair, decontaminate, htmltext, langspans, neardup, packing,
               ranked, repeats, secrets, sql, toxicity, warc)
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed package of public vocabularies keeps ``name``."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op4_best_two_fit_packing")
def best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces of at most 1024, packed by best-two-fit."""
    packed = packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_file())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
                         "offset")


@query("op5_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return htmltext.extract(read_table(spark, sf_dir, "pages"))


@query("op7_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from the labels of the training folds."""
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


@query("op1_minhash_near_dedup")
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, similarity 0.8 (the query's contract)."""
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), width=4)


@query("op9_approximate_neighbours")
def approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every fiftieth vec_id."""
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op10_warc")
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, normalised and read back."""
    return warc.archive_round_trip(read_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_secret_scans", sql.SECRETS)
def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of the secrets of every document."""
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"),
        number(2).alias("n_hex"), F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"))


@query("op2_benchmark_decontamination", sql.DECONTAMINATION)
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside occurrences of ten-word benchmark windows."""
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"),
                                        read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query("op8_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat 50-byte strings of documents with smaller ids."""
    found = repeats.remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_chat_formatting")
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation repaired to legal turns at least cost, as rendered pieces."""
    return chat.repair(read_table(spark, sf_dir, "conversations"))


@query("op11_ranked_search", sql.RANKED)
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return ranked.search(read_table(spark, sf_dir, "documents"),
                         read_table(spark, sf_dir, "benchmark"), k=50)


@query("op12_conversation_repair", sql.CONVERSATIONS)
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by a checksum of its rows and repaired at least cost."""
    return convrepair.damage_and_repair(read_table(spark, sf_dir, "conversations"))


@query("op13_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labels outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents")
    found = langspans.identify(docs, langspans.fit(docs))
    return found.select("doc_id", langspans.held_out(F.col("doc_id")).alias("held_out"),
                        "lang_pred", "score")
