"""Rows that every operator must take: nulls, empty and long texts, repeated rows, columns of clashing names."""

from __future__ import annotations

LONG = " ".join(f"word{i % 997}x{i % 13}" for i in range(40_000))
TEXTS = [
    (1, "One small text about a river and a long road to the sea."),
    (2, "one SMALL text about a river and a long road to the sea."),
    (3, None),
    (4, ""),
    (5, "Zürich, Ærø 😀 naïve — 12 ends"),
    (6, LONG),
    (7, "One small text about a river and a long road to the sea."),
    (7, "One small text about a river and a long road to the sea."),
    (None, "One small text about a river and a long road to the sea."),
    (None, None),
    (8, "!!! ... ---"),
    (9, "word"),
]
CLASHING = ["digest", "row", "terms", "n", "label", "key", "weight", "length", "start", "items", "own_id", "gone_id", "whole_text", "line", "pos", "h"]


def documents(spark, rows=TEXTS):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(i, t, "en" if i and i % 2 else None, "s", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, schema).repartition(3)


def clashing(df):
    """The table with more columns, named like inner columns of the operators."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"x{i}").alias(name) for i, name in enumerate(CLASHING)])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
