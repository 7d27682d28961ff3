"""Small tables with the cases that every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that have the names of operators' results or helpers.
CLASHING = {"keep_id": "lit", "kept": "lit", "score": "lit", "predicted": "lit", "id": "lit", "s": "lit", "shard": "lit", "ids": "lit", "size": "lit", "n_tokens": "lit", "key": "lit", "component_id": "lit", "mix_epoch": "lit", "group_size": "lit", "text_sha256": "lit", "word": "lit", "c1": "lit", "hi": "lit"}


def docs(spark, rows):
    """rows: texts, or tuples (doc_id, text, source); ids count from 0."""
    full = [(i, r, "en", "web", 0) if not isinstance(r, tuple) else (r[0], r[1], "en", r[2] if len(r) > 2 else "web", 0) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def hard(spark):
    """Null and empty texts, nulls in every column, ties, repeated rows, a very long text, odd characters."""
    long = " ".join(f"word{i % 997} and{i % 13}" for i in range(30_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "web", 0), (3, "   \t\n", "en", "web", 4), (None, "a text without an id", "en", "web", 1), (4, "one", None, "web", None),
        (5, "The same words again and again here", "en", "web", 1), (6, "the SAME words again and again here", "en", "books", 1), (6, "the SAME words again and again here", "en", "books", 1),
        (7, long, "en", "web", 1), (8, long, "de", "web", 1), (9, "x" * 70_000, "en", None, 1), (10, "İstanbul ſ K é <|endoftext|> ΑΣ 中文 🙂 \x00 ½²", "tr", "", 1), (None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """df with columns that have the names of results."""
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def prose(seed: int, n: int, words: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def collect(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
