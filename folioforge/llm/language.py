"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point. A trigram's vector binds (multiplies) the
letter vectors, permuted (rotated) by their place: rot2(a) * rot(b) * c. A text's vector bundles (adds) its trigrams'
vectors; a language's prototype bundles those of all its training texts. A text gets the language whose prototype has
the largest cosine with its vector. Runs of anything but letters count as one blank, which is a letter here.

Bundling is linear, so a batch counts its trigrams first and multiplies counts by vectors; each task sends one partial
prototype a language, and languages times dimensions numbers reach the driver.

Defined results: a text that is null or has no letter gets `und` and score 0, as all do where nothing was learned. Ties go
to the language that sorts first. The score is the cosine, at least 0. Repeated rows give repeated results; texts of any
length are taken whole; an empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import spread_table, whole

#: Length of the vectors.
DIMENSIONS = 1024
#: Letters of text that are worked on at once, so that memory stays bounded.
PORTION = 150_000
#: Rows of the letter table: the code points' remainders, 0 for the blank. Letters beyond the table share rows.
LETTERS = 4096

#: The code of what has no language.
UNDETERMINED = "und"


class Space:
    """The letter table and what is computed with it; the same on every executor."""

    def __init__(self, dimensions: int):
        self.d = dimensions
        bits = np.random.default_rng(20_240_229).integers(0, 2, (LETTERS, dimensions), dtype=np.int8)
        self.c = (2 * bits - 1).astype(np.int8)
        self.b, self.a = np.roll(self.c, 1, axis=1), np.roll(self.c, 2, axis=1)
        self.code = np.zeros(0x110000, dtype=np.int64)
        letters = np.fromiter((ord(c) for c in map(chr, range(0x110000)) if c.isalpha()), dtype=np.int64)
        self.code[letters] = letters % (LETTERS - 1) + 1

    def grams(self, text: str) -> np.ndarray:
        """The trigrams of a text, one number each; none if it has no letter."""
        x = self.code[np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)]
        if not x.any():
            return np.empty(0, dtype=np.int64)
        x = np.concatenate(([0], x, [0]))
        x = x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]
        return (x[:-2] * LETTERS + x[1:-1]) * LETTERS + x[2:]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        return self.a[grams // LETTERS**2] * self.b[grams // LETTERS % LETTERS] * self.c[grams % LETTERS]

    def bundle(self, owner: np.ndarray, grams: np.ndarray, owners: int) -> np.ndarray:
        """One vector an owner: the sum of its trigrams' vectors."""
        out = np.zeros((owners, self.d), dtype=np.float64)
        for i in range(0, len(grams), 4 * PORTION):
            g, at = np.unique(grams[i : i + 4 * PORTION], return_inverse=True)
            who, own = np.unique(owner[i : i + 4 * PORTION], return_inverse=True)
            counts = np.bincount(own * len(g) + at, minlength=len(who) * len(g)).reshape(len(who), len(g)).astype(np.float32)
            for j in range(0, len(g), 16_384):
                out[who] += counts[:, j : j + 16_384] @ self.vectors(g[j : j + 16_384]).astype(np.float32)
        return out


def portions(texts: list[str], letters: int = PORTION, rows: int = 256) -> Iterator[tuple[int, int]]:
    """Runs of rows of about so many letters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= letters or i - start >= rows - 1:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def learn(labelled: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes from all rows of labelled: text, lang (not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(dimensions), {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in portions(texts, 4 * PORTION, 4096):
                names = sorted(set(langs[i:j]))
                place = {n: k for k, n in enumerate(names)}
                grams = [space.grams(t) for t in texts[i:j]]
                owner = np.repeat([place[n] for n in langs[i:j]], [len(g) for g in grams])
                for n, v in zip(names, space.bundle(owner, np.concatenate(grams), len(names)), strict=True):
                    sums[n] = sums.get(n, 0) + v
        yield pa.RecordBatch.from_pydict({"lang": pa.array(sums, pa.string()), "v": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    parts = labelled.select("text", "lang").mapInArrow(run, "lang string, v array<double>")
    each = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = each.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect()
    return {r["lang"]: np.array([x["x"] for x in r["v"]]) for r in rows}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", dimensions: int = DIMENSIONS, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: id, the columns of `carry`, lang_pred, score."""
    names = sorted(prototypes)
    known = np.array([prototypes[n] / (np.linalg.norm(prototypes[n]) or 1) for n in names]).reshape(len(names), dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(dimensions)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            for i, j in portions(texts) if names else ():
                grams = [space.grams(t) for t in texts[i:j]]
                v = space.bundle(np.repeat(np.arange(j - i), [len(g) for g in grams]), np.concatenate(grams), j - i)
                near = (v @ known.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                for k, g in enumerate(grams):
                    if len(g):
                        best = int(near[k].argmax())
                        langs[i + k], scores[i + k] = names[best], float(min(1.0, max(0.0, near[k, best])))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[1:], "lang_pred", "score"])

    rows = docs.select(whole(docs[text_col]).alias("text"), docs[id_col].alias("id"), *(c.alias(n) for n, c in (carry or {}).items()))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(docs["doc_id"].cast("string")) % 5 == 0, F.lit(False))
    prototypes = learn(docs.where(~held & docs["text"].isNotNull() & docs["lang"].isNotNull()))
    return identify(docs, prototypes, carry={"held_out": held}).withColumnRenamed("id", "doc_id")
