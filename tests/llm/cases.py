"""Small tables with the awkward rows that every operator has to take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak near the river bank and nobody says a word about it"

ROWS = [
    (1, PROSE, "en", "a", 1),
    (2, PROSE.upper() + "!", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n ", "en", "b", 3),
    (6, "one", "en", None, 3),
    (7, PROSE + " mail bob.smith@example.com or call +1 (555) 123-4567 now", "en", "c", 1),
    (7, PROSE + " mail bob.smith@example.com or call +1 (555) 123-4567 now", "en", "c", 1),
    (None, "a text without an id that repeats repeats repeats repeats", "de", "c", 1),
    (9, "çà été où ñandú ünïcode 10.0.0.1 4111 1111 1111 1111 \U0001f600 x@y.zz", "fr", "d", 1),
    (10, "spam spam spam\n" * 3000, "en", "a", 1),
]


def documents(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark):
    """The same rows with columns that are named as an operator might name its own."""
    docs, extra = documents(spark), {}
    from pyspark.sql import functions as F

    for name in ("h", "t", "w", "term", "size", "rank", "score", "key", "n", "row", "fingerprint", "block", "start", "a", "b", "path", "label"):
        extra[name] = F.lit("x")
    return docs.withColumns(extra)
