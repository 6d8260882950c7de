"""Rows that every operator has to stand: nulls, empty and long texts, repeated rows and columns of clashing names."""

LONG = "Alpha beta gamma delta. " * 4000
ROWS = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, "Hello wide world, this is a line\nHello wide world, this is a line\n\ttab", "en", "a"),
    (3, "Hello wide world, this is a line\nHello wide world, this is a line\n\ttab", "en", "a"),
    (4, " \t\n ", "en", None),
    (5, LONG, None, "b"),
    (6, LONG + "end", "en", "b"),
    (None, "no id here at all", "fr", "b"),
    (7, "12 34 -- %% !!", "fr", "b"),
    (8, "Straße  naïve café \U0001f600 don't I'LL\r\nx\x1cy   z", "de", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ["n", "score", "lang_pred", "n_lines", "n_dropped", "kept_sha256", "gone", "affected", "gone_id", "ids", "decoded", "n_tokens", "words__", "n_words", "class_id", "component_id", "n_shingles", "quality", "held_out", "token", "a", "b", "uid", "title", "n_chars"]


def docs(spark, rows=None):
    """The rows with a column of every clashing name."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    return df.withColumns({name: F.lit("own") for name in CLASH})
