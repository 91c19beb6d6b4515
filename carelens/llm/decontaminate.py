"""Benchmark decontamination through a distributed positional inverted index, with DataFrame
functions alone.

* ``test_windows`` cuts test items into windows of consecutive words and keeps each once.
* ``build_index`` stores the training side's postings (term, row, pos) of the terms that windows
  hold; a document's length is the posting of the end mark. One scan of the documents, one write,
  no shuffle: the vocabulary of the test side is sent to the tasks when its counted size allows.
* ``matches`` intersects offset-adjusted lists from each window's rarest term on: the rarest list
  proposes places, the second list thins them out by an equi-join on (row, position), and the
  others are looked up only in rows that still have a place. ``slack`` 0 gives exact phrases, more
  allows every term to stand so many words off its offset (proximity).

All joins after the first are on (row, position), which no frequent word, line or passage makes
hot; the first is a broadcast, or a join that AQE splits.

Defined results: null and wordless texts have no words, no windows and no hits; an item of fewer
words than a window is one window; rows with null or repeated ids get a row each; items with null
ids take no part; items that repeat an id are one item; an empty benchmark hits nothing; other
columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hint_small, materialize

WINDOW = 10
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = ""                        # no word is empty
END_TERM = -1


def words(text: Column) -> Column:
    """Words of a text with A-Z lowered and no other letter changed; [] for null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.length(text) == F.octet_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def test_windows(items: DataFrame, width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(win, terms) of the distinct windows of ``items`` and (win, item_id) of their items."""
    w = items.select(F.col("item_id").alias("item_id"), words(F.col("text")).alias("w")).filter(
        "item_id is not null and size(w) > 0")
    each = w.select("item_id", F.explode(F.when(
        F.size("w") <= width, F.array(F.col("w"))).otherwise(F.transform(
            F.sequence(F.lit(0), F.size("w") - width),
            lambda i: F.slice(F.col("w"), i + 1, width)))).alias("terms"))
    each = materialize(each.distinct(), "test-windows")
    wins = materialize(each.select("terms").distinct().select(
        F.monotonically_increasing_id().alias("win"), "terms"), "windows")
    return wins, each.join(wins, "terms").select("win", "item_id")


def build_index(docs: DataFrame, wins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings (term, row, pos, doc_id) of the windows' terms and the vocabulary (word, term).
    doc_id stands only in the posting of the end mark, whose pos is the number of words."""
    vocabulary = materialize(
        wins.select(F.explode("terms").alias("word")).distinct()
        .select("word", F.monotonically_increasing_id().alias("term"))
        .unionByName(wins.sparkSession.createDataFrame([(END, END_TERM)],
                                                       "word string, term long")), "vocabulary")
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .select(F.monotonically_increasing_id().alias("row"), "doc_id",
                    F.concat(words(F.col("text")), F.array(F.lit(END))).alias("w"))
            .select("row", "doc_id", F.posexplode("w").alias("pos", "word")))
    found = rows.join(hint_small(vocabulary, 96), "word").select(
        "term", "row", "pos",
        F.when(F.col("term") == END_TERM, F.col("doc_id")).alias("doc_id"))
    return materialize(found, "postings"), vocabulary


def matches(index: DataFrame, vocabulary: DataFrame, wins: DataFrame,
            slack: int = 0) -> DataFrame:
    """(win, row, start, size): places where every term of the window stands at its offset, or at
    most ``slack`` words off it. start is set by the window's rarest term."""
    lists = index.filter(F.col("term") != END_TERM).select("term", "row", "pos")
    often = lists.groupBy("term").agg(F.count("*").alias("n"))
    terms = (wins.select("win", F.size("terms").alias("size"),
                         F.posexplode("terms").alias("off", "word"))
             .join(vocabulary, "word").join(often, "term", "left"))
    by_rarity = Window.partitionBy("win").orderBy("n", "off")
    whole = Window.partitionBy("win")
    terms = materialize(
        terms.withColumn("rank", F.row_number().over(by_rarity))
        .withColumn("absent", F.max(F.col("n").isNull()).over(whole))
        .filter("not absent").select("win", "size", "off", "term", "rank"), "window-terms")

    def at(rank):
        return terms.filter(F.col("rank") == rank)

    def near(pos):
        return F.explode(F.sequence(pos - slack, pos + slack)) if slack else pos

    place = ["win", "row", "start", "size"]
    found = (lists.join(hint_small(at(1), 48), "term")
             .select("win", "row", (F.col("pos") - F.col("off")).alias("start"), "size")
             .filter("start >= 0" if not slack else "true"))
    second = at(2).select("win", "off", "term")
    wanted = (found.filter("size > 1").join(hint_small(second, 48), "win")
              .select(*place, "term", near(F.col("start") + F.col("off")).alias("pos")))
    thinned = wanted.join(lists.join(hint_small(second.select("term").distinct(), 24), "term",
                                     "left_semi"), ["row", "pos", "term"])
    thinned = materialize(thinned.select(*place).distinct()
                          .unionByName(found.filter("size = 1")), "places")
    rows = materialize(thinned.filter("size > 2").select("row").distinct(), "place-rows")
    rest = terms.filter("rank > 2").select("win", "off", "term")
    wanted = (thinned.filter("size > 2").join(hint_small(rest, 48), "win")
              .select(*place, "off", "term", near(F.col("start") + F.col("off")).alias("pos")))
    met = (wanted.join(lists.join(hint_small(rows, 24), "row", "left_semi"),
                       ["row", "pos", "term"])
           .select(*place, "off").distinct() if slack else
           wanted.join(lists.join(hint_small(rows, 24), "row", "left_semi"),
                       ["row", "pos", "term"]).select(*place, "off"))
    full = (met.groupBy(*place).agg(F.count("*").alias("n"))
            .filter("n = size - 2").select(*place))
    return thinned.filter("size <= 2").unionByName(full)


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(row, doc_id, n_words, n_hit, items) of every document: its words, those inside any
    occurrence of a window, and the sorted ids of the items with occurring windows."""
    wins, owners = test_windows(items, width)
    index, vocabulary = build_index(docs, wins)
    hits = materialize(matches(index, vocabulary, wins), "hits")
    # words covered: every match adds what lies beyond all earlier ends
    before = (Window.partitionBy("row").orderBy("start", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    stop = F.col("start") + F.col("size")
    past = F.greatest("start", F.coalesce(F.max(stop).over(before), F.lit(0)))
    covered = (hits.select("row", "start", "size").distinct()
               .withColumn("fresh", F.greatest(stop - past, F.lit(0)))
               .groupBy("row").agg(F.sum("fresh").alias("n_hit")))
    named = (hits.select("win", "row").distinct().join(owners, "win")
             .groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string")))
                                 .alias("items")))
    return (index.filter(F.col("term") == END_TERM)
            .select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
            .join(covered, "row", "left").join(named, "row", "left")
            .select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))
