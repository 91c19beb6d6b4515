"""Secret scans with DataFrame functions alone: key patterns, and sliding-window entropy over
candidate strings.

Matches of a pattern get their places from the lengths of the texts between them (split and
extract find the same matches), summed per document. A candidate string is a maximal run of a
character class; over its characters window functions keep incremental counts: with g(n) =
n log2 n in fixed point, a window's sum of g over its character counts changes by g(k+1) - g(k)
where a character enters that already stands k times and by g(m) - g(m-1) where one of m leaves,
so running sums of both give every window's Shannon entropy, exactly and without recounting.
Windows at or over the class's entropy, with enough digits and letters, merge to spans. The
allow-list suppresses candidates that are identifiers or integrity values as a whole, and windows
that hold a stock word, not what stands next to it. Spans of the key patterns always stay.

Nothing but match rows is shuffled, by the document's row number; a document's matches are the
largest group.

Defined results: null is the empty text (no spans); ids may be null or repeated, each row gets a
row; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# ---- fixed values: key patterns --------------------------------------------------------
ASSIGN = ("(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
          "([A-Za-z0-9+/_.=-]+)")
ASSIGN_LEAST = 12               # characters of group 2
ACCESS = "AKIA[A-Z0-9]{14,}"    # runs of 18 characters or more
HEX = "[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_base64"]     # in order of listing

# class: (kind, candidate, window, least bits, digits and letters in the window)
CLASSES = [
    ("entropy_hex", "[0-9A-Fa-f]{20,}", 20, 3.05, 2, 2),
    ("entropy_base64", "[A-Za-z0-9+/_=-]{24,}", 24, 3.9, 1, 3),
]
# allowed: whole candidates (identifiers, integrity values), and windows that hold a stock word
ALLOWED = "(?i)(^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|^sha(256|384|512)-)"
ALLOWED_PART = "(?i)(example|sample|placeholder|dummy|changeme|xxxx|abcdefgh|01234567|12345678)"
SCALE = 1 << 20


def _matches(text: Column, kind: str, pattern: str, keep: bool) -> Column:
    """Array of (kind, gap before, length, good, string) of all matches of ``pattern``."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rank = F.lit(KINDS.index(kind))

    def mark(gap, x, good):
        return F.struct(rank.alias("kind"), F.length(gap).alias("gap"), F.length(x).alias("size"),
                        good.alias("good"),
                        (x if keep else F.lit(None).cast("string")).alias("string"))

    if kind == "assign":
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        pairs = F.zip_with(found, values, lambda x, v: F.struct(
            x.alias("x"), (F.length(v) >= ASSIGN_LEAST).alias("good")))
        marks = F.zip_with(gaps, pairs, lambda g, p: mark(g, p["x"], p["good"]))
    else:
        marks = F.zip_with(gaps, found, lambda g, x: mark(g, x, F.lit(True)))
    none = F.array().cast("array<struct<kind:int,gap:int,size:int,good:boolean,string:string>>")
    return F.when(text.rlike(pattern),
                  F.filter(marks, lambda m: m["size"].isNotNull())).otherwise(none)


def _places(docs: DataFrame, id_col: str, id_type: str) -> DataFrame:
    """A row per match and, for documents without any, one without kind: (row, doc_id, kind,
    start, end, good, string). Written once; everything after reads it."""
    patterns = [("assign", ASSIGN, False), ("access", ACCESS, False), ("hex", HEX, False),
                *((kind, p, True) for kind, p, *_ in CLASSES)]
    text = F.coalesce(F.col("text"), F.lit(""))
    marks = F.concat(*[_matches(text, k, p, keep) for k, p, keep in patterns])
    rows = (docs.select(F.col(id_col).cast(id_type).alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
            .select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
            .select("row", "doc_id", F.posexplode_outer(marks).alias("nr", "m"))
            .select("row", "doc_id", "nr", "m.*"))
    rows = materialize(rows, "secret-matches")
    upto = Window.partitionBy("row", "kind").orderBy("nr")
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(upto)
    return rows.select("row", "doc_id", "nr", "kind", (end - F.col("size")).alias("start"),
                       end.alias("end"), "good", "string")


def fixed_point(n: Column) -> Column:
    """g(n) = n log2 n in units of 1 / SCALE."""
    return F.when(n > 1, F.round(n * F.log2(n.cast("double")) * SCALE)).otherwise(0).cast("long")


def fixed_limit(window: int, bits: float) -> int:
    """Largest sum of g at which a window's entropy is at or over ``bits``."""
    return math.floor(window * (math.log2(window) - bits) * SCALE)


def _entropy_spans(places: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, end) of merged windows of high entropy."""
    out = None
    for kind, _, window, bits, digits, letters in CLASSES:
        chars = (places.filter((F.col("kind") == KINDS.index(kind))
                               & ~F.col("string").rlike(ALLOWED))
                 .select("row", "doc_id", "nr", "start",
                         F.posexplode(F.split("string", "")).alias("at", "ch"))
                 .filter("ch <> ''"))
        same = Window.partitionBy("row", "nr", "ch").orderBy("at")
        k = F.count("*").over(same.rangeBetween(-(window - 1), -1))
        m = F.count("*").over(same.rangeBetween(0, window - 1))
        chars = chars.select(
            "row", "doc_id", "nr", "start", "at",
            (fixed_point(k + 1) - fixed_point(k)).alias("enters"),
            (fixed_point(m) - fixed_point(m - 1)).alias("leaves"),
            "ch", F.col("ch").between("0", "9").cast("int").alias("digit"),
            F.lower("ch").between("a", "z").cast("int").alias("letter"))
        run = Window.partitionBy("row", "nr").orderBy("at")
        inside = run.rowsBetween(-(window - 1), 0)
        total = (F.sum("enters").over(run.rowsBetween(Window.unboundedPreceding, 0))
                 - F.coalesce(F.sum("leaves").over(
                     run.rowsBetween(Window.unboundedPreceding, -window)), F.lit(0)))
        chars = chars.select("row", "doc_id", "nr", "start", "at", total.alias("total"),
                             F.sum("digit").over(inside).alias("digits"),
                             F.sum("letter").over(inside).alias("letters"),
                             F.collect_list("ch").over(inside).alias("part"))
        hot = chars.filter((F.col("at") >= window - 1)
                           & (F.col("total") <= fixed_limit(window, bits))
                           & (F.col("digits") >= digits) & (F.col("letters") >= letters)
                           & ~F.array_join("part", "").rlike(ALLOWED_PART))
        fresh = (F.col("at") - F.lag("at").over(run) > window).cast("int")
        hot = hot.withColumn("island", F.sum(F.coalesce(fresh, F.lit(1))).over(run))
        spans = (hot.groupBy("row", "doc_id", "nr", "start", "island")
                 .agg(F.min("at").alias("a"), F.max("at").alias("b"))
                 .select("row", "doc_id", F.lit(KINDS.index(kind)).alias("kind"),
                         (F.col("start") + F.col("a") - (window - 1)).alias("start"),
                         (F.col("start") + F.col("b") + 1).alias("end")))
        out = spans if out is None else out.unionByName(spans)
    return out


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row of ``docs``: spans is an array of (start, kind, end) in code
    points, end exclusive, sorted by start, then kind (its place in KINDS), then end."""
    return _find(docs, "doc_id", "long")


def _find(docs: DataFrame, id_col: str, id_type: str) -> DataFrame:
    places = _places(docs, id_col, id_type)
    base = places.filter(F.col("kind") < 3).filter("good")
    rest = _entropy_spans(places)
    every = (base.select("row", "doc_id", "kind", "start", "end").unionByName(rest)
             .unionByName(places.select("row", "doc_id").distinct().select(
                 "row", "doc_id", F.lit(None).cast("int").alias("kind"),
                 F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))))
    span = F.struct("start", "kind", "end")
    return (every.groupBy("row", "doc_id")
            .agg(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), span)))
                 .alias("spans")).select(F.col("doc_id").alias(id_col), "spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of every text replaced by ``mark`` (overlapping or touching spans
    by one), n_chars, where there is one, brought up to date; texts without spans stay as they
    are."""
    taken, names = {c.lower() for c in docs.columns}, []
    for name in ("text_key", "found_spans"):
        while name in taken:
            name += "_"
        names.append(name)
    key, spans = names
    own = docs.withColumn(key, F.md5("text"))
    found = (_find(own, key, "string").filter(F.size("spans") > 0)
             .select(F.col(key), F.col("spans").alias(spans)).dropDuplicates([key]))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        gap = F.col("text").substr(acc["at"].cast("int") + 1, F.greatest(
            s["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = s["start"] > acc["at"]
        first = (acc["at"] == 0) & (s["start"] == 0)
        return F.struct(
            F.when(fresh | first, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
            .alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    spans = F.col(spans)
    clean = F.aggregate(spans, start, step, lambda acc: F.concat(
        acc["out"], F.substring(F.col("text"), acc["at"].cast("int") + 1, F.length("text"))))
    out = own.join(found, key, "left")
    out = out.withColumn("text", F.when(spans.isNotNull(), clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(
            spans.isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
            .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
