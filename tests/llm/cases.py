"""Small awkward tables that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; they must not clash.
CLASHES = ("row", "mark", "spans", "id", "digest", "part", "group", "score", "bin", "w", "start", "length", "new")

#: Ids beside a null that a double cannot hold.
BIG = 1 << 60
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))


def rows():
    texts = [
        (1, "Plain words, nothing else."), (2, None), (3, ""), (4, " \t\n\r "), (5, LONG), (6, LONG), (6, LONG),
        (7, "same same same same same"), (None, "no id here"), (8, "é 你好 😀  x y\x1cz"), (9, "a" * 5_000),
        (10, f"one {PASSAGE} two"), (11, f"three {PASSAGE} four"), (11, f"three {PASSAGE} four"), (12, "<|endoftext|> as text"),
        (13, "tie"), (14, "TIE"), (BIG + 1, "id one"), (BIG + 3, "id three"), (BIG + 5, "id five"),
    ]
    return [(i, t, "en", "src", None if t is None else len(t)) for i, t in texts]


def awkward(spark):
    """All rows, with extra columns of clashing names."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows(), DOCS).select("*", *[F.lit("clash").alias(c) for c in CLASHES])


def empty(spark):
    return awkward(spark).limit(0)


def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(1, 15)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
