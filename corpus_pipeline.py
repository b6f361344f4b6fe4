"""A pipeline of five training-data operators over the documents table, from raw rows to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

1. toxicity: documents that the ordinal regression rejects go.
2. lines: repeated and nearly repeated lines go; a document that loses all of its text goes with them.
3. near_duplicates: one document, the smallest doc_id, stays of each group that SimHash links.
4. mix: documents are repeated, cut or left out so that the sources' words meet their target weights.
5. tokens: every text becomes token ids.

Defined results, in every stage: a null text counts as empty and stays null where the row stays. An empty table gives an
empty result with the same columns. Extra columns pass through unchanged up to the last stage, whatever their names. Ties
go to the smaller doc_id. Rows that repeat: toxicity judges each alone; lines treats rows equal in doc_id and text as one
document with one result; near_duplicates keeps every row that has the doc_id which stays; mix gives each row a share;
tokens gives a row each. Rows without doc_id stay in near_duplicates, as nothing names them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm import bpe, line_dedup, mixing, simhash, toxicity
from folioforge.llm.common import stored, table

#: Words in a shingle of the near-duplicate stage, and bits by which linked fingerprints may differ.
SHINGLE_WORDS, BITS = 5, 3

#: Words with the white space after them.
WORD_AND_GAP = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of any severity stays below the rejection threshold, unchanged."""
    model = toxicity.learn(docs, toxicity.toxic_labels(table(spark, sf_dir, "labels")))
    return toxicity.without_toxic(docs, model)


def with_n_chars(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that stay; n_chars follows the text."""
    return with_n_chars(line_dedup.dedup_text(docs))


def unused(name: str, docs: DataFrame) -> str:
    """A column name that docs doesn't have, case aside."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: rows whose doc_id is the smallest of theirs."""
    found = simhash.near_duplicates(docs, words=SHINGLE_WORDS, bits=BITS)
    stays = unused("stays", docs)
    stay = found.where("id = component_id").select(F.col("id").alias(stays)).distinct()
    kept = docs.join(stay, docs["doc_id"] == F.col(stays), "left_semi")
    return kept.unionByName(docs.where(docs["doc_id"].isNull()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies of a document, then its first words for what is left of its share; the text of no words stays once."""
    # Rows equal in identifier, source and size lie side by side in the stream, so they take at most a few different amounts.
    amounts = mixing.mix(docs).groupBy("id", "source", "size", "taken").agg(F.count(F.lit(1)).alias("n"))
    shares = amounts.groupBy("id", "source", "size").agg(F.sort_array(F.collect_list(F.struct("taken", "n"))).alias("shares"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").alias("id"), F.col("row.source").cast("string").alias("source"), mixing.word_count(F.col("row.text")).alias("size"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("id", "source", "size").orderBy(F.xxhash64("row"))))
    s = shares.select(F.col("id").alias("s_id"), F.col("source").alias("s_source"), F.col("size").alias("s_size"), "shares")
    joined = rows.join(s, F.col("id").eqNullSafe(F.col("s_id")) & F.col("source").eqNullSafe(F.col("s_source")) & (F.col("size") == F.col("s_size")))
    none = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("taken"))
    reached = F.aggregate("shares", none, lambda at, s: F.when(at["upto"] < F.col("place"), F.struct((at["upto"] + s["n"]).alias("upto"), s["taken"].alias("taken"))).otherwise(at))
    joined = joined.select("row", "size", reached["taken"].alias("taken"))
    taken, size, text = F.col("taken"), F.col("size"), F.col("row.text")
    full, rest = F.when(size > 0, F.floor(taken / size)).otherwise(1), F.when(size > 0, taken % size).otherwise(0)
    words = F.slice(F.regexp_extract_all(text, F.lit(WORD_AND_GAP), F.lit(0)), F.lit(1), rest.cast("int"))
    pieces = F.concat(F.array_repeat(text, full.cast("int")), F.when(rest > 0, F.array(F.rtrim(F.array_join(words, "")))).otherwise(F.array().cast("array<string>")))
    out = joined.select("row", F.explode(pieces).alias("piece"))
    return with_n_chars(out.select(*[F.col("piece").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row for each piece of the mix."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.encode_documents(docs, path, public_tokenizers.PATTERN, digests=True)
    return done.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("tokens", tokenize),
]

#: Learned models and hash functions are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored in the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
