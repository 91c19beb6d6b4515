"""Small tables with the awkward cases of every operator: nulls, empty and very long texts, ties,
repeated rows, empty tables, and extra columns whose names operators use inside."""

import random

CLASH = ["row", "key", "rep", "sig", "spans", "p", "score", "component", "n", "h", "kind"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    syll = "an ber Ci dé en fi Ga ho ïl ka lo mi no or pa qu re sa tu ve".split()
    words = ["".join(rng.choice(syll) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for k in range(7, n, 11):
        words[k] += rng.choice([".", ",", ".\n", "!"])
    return " ".join(words)


def edited(text: str, seed: int, share: float) -> str:
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else "Edit%d" % rng.randrange(99)
                    for w in text.split(" "))


def documents() -> list[tuple]:
    base, other = prose(1, 300), prose(2, 260)
    line = "This line of words stands in many of the documents and is long enough to repeat."
    rows = [(10, base), (11, base), (12, edited(base, 3, 0.01)), (13, edited(base, 4, 0.02)),
            (14, edited(base, 5, 0.05)), (15, other), (16, edited(other, 6, 0.01)),
            (17, None), (18, ""), (19, "   \n\t "), (20, "one"), (21, "One"), (22, "one two"),
            (23, prose(7, 6000)), (24, prose(8, 40) + " " + line), (25, line + " " + prose(9, 50)),
            (26, "x" * 3000), (27, "ab " * 800), (28, prose(10, 30) + " " + prose(2, 260)),
            (None, base), (None, None), (15, other), (30, "é" * 49), (31, "é" * 60),
            (32, "it's a token: don't \U0001F600 split 中文")]
    rng = random.Random(11)
    rows += [(100 + i, edited(base, 200 + i, rng.choice([0.0, 0.01, 0.03, 0.08, 0.2])))
             for i in range(60)]
    return rows


def with_clashes(spark, rows, schema):
    """A DataFrame of ``rows`` with extra columns named like the operators' own."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, schema).repartition(3)
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("extra"))
    return df


DOC_SCHEMA = "doc_id long, text string"
