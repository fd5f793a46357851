"""Small hand-made tables with the awkward cases that every operator must take."""

from pyspark.sql import types as T

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    T.StructField("_row", T.StringType()), T.StructField("_new", T.StringType()),
    T.StructField("_score", T.StringType()), T.StructField("_rate", T.StringType()),
    T.StructField("spans", T.StringType()), T.StructField("fp", T.StringType())])
LABEL_SCHEMA = "doc_id bigint, quality int, toxic int"

LONG = " ".join(f"word{i % 977} and{i % 13}," for i in range(40_000)) + " the end."
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "a"),  # a repeated row
    (3, None, "en", "b"), (4, "", None, None), (5, " \t\n ", "de", "b"),
    (None, "a text without an id", "en", None), (None, None, None, None),
    (6, "Ünïcödé  täxt mit   ümläuten \U0001f600 中文 и кириллица", "de", "b"),
    (7, LONG, "fr", "c"), (8, "tab\tand <|endoftext|> inside", "en", "c"), (9, "one", "es", "c"),
    (10, "!!! $$$ ### *** &&& %%%", "en", "d"),
]


def documents(spark, rows=ROWS):
    full = [(i, t, lang, src, None if t is None else len(t), "r", "n", "s", "q", "x", "f")
            for i, t, lang, src in rows]
    return spark.createDataFrame(full, DOC_SCHEMA).repartition(3)


def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (2, 0, 0), (3, None, None), (None, 1, 1), (7, 1, 0), (10, 0, 1), (999, 1, 0)],
        LABEL_SCHEMA)
