"""Small tables with the cases that every operator has to take: nulls, empty, blank and very long texts, repeated
rows, an empty table, and extra columns whose names clash with those that operators use."""

from pyspark.sql import functions as F

LONG = " ".join(f"w{i * i % 977}" for i in range(30_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASHES = ("digest", "n_tokens", "h", "pos", "id", "key", "component_id", "kept", "language", "leaks", "drawn", "topic", "weight", "probability", "n_shingles", "part", "file", "lang_pred", "score", "host", "rule", "good")

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away.", "en", "a", 1),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \t\n\x0b ", "en", "b", 5),
    (5, LONG, "en", "b", 9),
    (5, LONG, "en", "b", 9),
    (6, "Él niño juega en la calle con su perro y come pan.", "es", "b", 1),
    (7, "12345 67890", None, "a", 1),
    (8, "one two three", "en", None, 1),
    (9, "ONE two three", "en", "a", 1),
    (None, "The quick brown fox jumps over the lazy dog and runs away.", "en", "a", 1),
]


def documents(spark, rows=ROWS, clash=True):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for name in CLASHES if clash else ():
        df = df.withColumn(name, F.lit("x"))
    return df


def pages(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for name in ("sha1", "n_bytes", "refers_to", "revisit", "host", "path", "rule", "verdict", "offset") if clash else ():
        df = df.withColumn(name, F.lit("x"))
    return df
