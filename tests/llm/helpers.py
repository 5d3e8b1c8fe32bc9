"""Small tables with the awkward rows that every operator has to take."""

from pyspark.sql import functions as F

LONG = " ".join(f"w{k % 997}" for k in range(30_000))
TEXTS = [None, "", " \t\n", "one", "The cat sat on the mat and then it went away from the house", "The cat sat on the mat and then it went away from the house", "Ünïcode wörds 中文 \U0001d518 and <|endoftext|> here", "... !!! 123", LONG]


def documents(spark, texts=TEXTS, repeat=True):
    """Texts with ids from 0, one null id, one repeated row, and columns whose names clash with results."""
    rows = [(k, t) for k, t in enumerate(texts)]
    rows = [*rows, (None, "The cat sat on the mat"), *([rows[4]] if repeat and len(rows) > 4 else [])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("x").alias("score"), F.lit(1).alias("labels"), F.lit(2).alias("sequence_id"), F.lit(3).alias("component_id"), F.lit(4).alias("kept"), F.lit("s").alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def rows_of(df):
    return [tuple(r) for r in df.collect()]
