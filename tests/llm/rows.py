"""Small awkward tables the tests share."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

PROSE = (
    "The committee met on a grey morning and went through the whole agenda without a break, "
    "because nobody wanted to come back after lunch and argue about the budget once more. "
)


def documents(spark, texts, **columns):
    """Documents 1, 2, ... with the given texts; ``columns`` override by list."""
    n = len(texts)
    ids = columns.get("doc_id", list(range(1, n + 1)))
    langs, sources = columns.get("lang", ["en"] * n), columns.get("source", ["s"] * n)
    rows = [(i, t, la, s, None if t is None else len(t)) for i, t, la, s in zip(ids, texts, langs, sources)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Nulls in every column, an empty, a one-word and a very long text, a repeated row, a clashing extra column."""
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [
        (1, "plain words in a row here", "en", "a", 25), (2, None, None, None, None), (3, "", "en", "b", 0), (4, "one", "en", "b", 3),
        (5, long, "en", "a", len(long)), (6, "plain words in a row here", "en", "a", 25), (6, "plain words in a row here", "en", "a", 25),
        (None, "plain words in a row here", "en", None, 25), (7, "  \t\n ", "en", "a", 5),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "score", "size", "h", "a", "b", "u", "component", "secrets", "__note"):
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def write(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
