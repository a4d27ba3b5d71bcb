"""Small tables with the awkward rows every operator must stand."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu", "ra", "so", "ti") for b in ("n", "rd", "sk", "l", "mp", "st")]


def prose(n, seed, words=WORDS):
    draw = random.Random(seed)
    return " ".join(draw.choice(words) for _ in range(n))


def awkward(spark, extra=()):
    """Nulls, empty, blank, very long, repeated and tied rows, and columns with clashing names."""
    long_text = prose(30_000, 1) + "\n" + "x" * 5000
    rows = [
        (1, None, "en", None, None),
        (2, "", None, "s", 0),
        (3, " \t\n ", "en", "s", 4),
        (4, long_text, "en", "s", 1),
        (5, prose(40, 2), "de", "s", 1),
        (5, prose(40, 2), "de", "s", 1),
        (6, prose(40, 2), None, "s", 1),
        (None, prose(30, 3), "en", "s", 1),
        (7, "naïve Übung 漢字 😀 end", "fr", "s", 1),
        *extra,
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    for name in ("score", "ids", "pii", "found", "failed", "fp", "row", "unit", "bucket", "component"):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
