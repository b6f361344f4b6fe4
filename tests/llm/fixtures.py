"""Rows that every operator must bear: nulls in any column, empty and very long texts, ties, repeats, clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, h string, fp string, rank string, shard string"


def docs(spark, texts, sources=None):
    """Documents numbered from 0, with columns whose names clash with the operators' own."""
    rows = [(i, t, "en" if i % 3 else None, (sources[i] if sources else "s"), len(t) if t is not None else None, *["x"] * 6) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def edge_docs(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t ", "en", "a", 5), (4, long, "en", "b", len(long)), (5, long, "en", "b", len(long)), (5, long, "en", "b", len(long)),
        (6, "the same words are here for all of them to see", "en", None, 40), (7, "the same words are here for all of them to see", "de", "c", 40), (None, "a text without number that goes its way", "en", "c", 9), (8, "été 漢字 𝄞 \x1c x", "fr", "c", 9),
    ]
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def words(rng: random.Random, n: int, letters: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))
