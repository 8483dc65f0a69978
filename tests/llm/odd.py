"""Documents that operators must take: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(WORDS[i * 7 % 400] + str(i % 97) for i in range(20_000))
BASE = " ".join(WORDS[:120])
NEAR = BASE.replace("w60 ", "changed ")

ROWS = [
    (1, BASE, "en", "a", len(BASE)),
    (2, NEAR, "en", "a", len(NEAR)),
    (3, BASE, None, "b", None),
    (3, BASE, None, "b", None),
    (4, None, "en", None, 0),
    (5, "", "", "", 0),
    (6, "  \n\t ", "en", "b", 5),
    (7, "one two", "en", "c", 7),
    (8, "one two", "en", "c", 7),
    (None, BASE, "en", "a", 1),
    (None, None, None, None, None),
    (9, LONG, "en", "a", len(LONG)),
    (10, "Ünï çode x 日本語 " * 3, "ja", "é", 5),
    (2**53 + 1, " ".join(WORDS[200:300]) + ".", "en", "z", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ["node", "digest", "size", "mark", "rank", "tie", "next", "key", "band", "shard", "rep", "copies", "lists", "__k", "part", "start", "length", "doc_tokens", "n_words", "page_id"]


def documents(spark, rows=None, clashes=False):
    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    if clashes:
        from pyspark.sql import functions as F

        for name in CLASHES:
            df = df.withColumn(name, F.lit(7))
    return df
