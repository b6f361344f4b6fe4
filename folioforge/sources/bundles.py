"""Bundles: a capture's row with what its artifacts say, which comes first where it says anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import records
from folioforge.functions.strings import strip, text

SECTION = "array<struct<id: string, title: string, kind: string, text: string>>"
REFERENCE = "array<struct<n: string, text: string, doi: string, pubmed: string>>"
#: The artifacts that bundles read, and their columns here.
READ = {"reduced.json": "reduced", "sections.json": "sections_json", "references.json": "references_json", "paper.md": "paper_md"}


def _first(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def bundles(captures: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row a capture (id, url, title, doi, year, container_title, created_at, updated_at): fields, parse summary, sections, references, paper_md.

    artifacts: capture_id, name, text; only the four that count are read, and the reduced record is parsed once. JSON that
    can't be read counts as empty. `year` is the record's wherever it names one, null too.
    """
    read = artifacts.where(F.col("name").isin(*READ)).groupBy("capture_id").agg(*[F.max(F.when(F.col("name") == name, F.col("text"))).alias(c) for name, c in READ.items()])
    keys = ("url", "title", "doi", "year", "container_title", "created_at", "updated_at")
    rows = captures.select("id", *[F.col(c).alias(f"row_{c}") for c in keys]).join(read.withColumnRenamed("capture_id", "id"), "id", "left")
    row = lambda c: text(F.col(f"row_{c}"))
    known = lambda column, kind: F.filter(F.coalesce(F.from_json(column, kind), F.array().cast(kind)), lambda x: x.isNotNull())

    def fields(r: Column) -> Column:
        said = lambda c: records.said(r, f"$.{c}")
        names = F.filter(F.transform(F.coalesce(records.items(r, "$.authors"), F.array().cast("array<variant>")), lambda x: strip(records.said(x, "$"))), lambda x: x != "")
        year = F.when(F.try_variant_get(r, "$.year", "variant").isNotNull(), F.try_variant_get(r, "$.year", "int")).otherwise(F.col("row_year"))
        return F.struct(
            _first(said("title"), row("title")).alias("title"), _first(said("doi"), row("doi")).alias("doi"), _first(said("source_url"), said("canonical_url"), row("url")).alias("url"), year.alias("year"),
            _first(said("container_title"), row("container_title")).alias("container_title"), names.alias("authors"), strip(said("published_date_raw")).alias("published_date_raw"),
            _first(strip(said("captured_at")), strip(row("created_at")), strip(row("updated_at"))).alias("captured_at"), records.parse_summary(r).alias("parse"),
        )

    read = rows.select("id", F.transform(F.array(records.record(F.col("reduced"))), fields)[0].alias("b"), "sections_json", "references_json", "paper_md")
    fields_of = ("title", "doi", "url", "year", "container_title", "authors", "published_date_raw", "captured_at")
    parse = {"parse_parser": "parser", "parse_ok": "ok", "capture_quality": "capture_quality", "blocked_reason": "blocked_reason", "confidence_fulltext": "confidence_fulltext", "used_for_index": "used_for_index"}
    return read.select(
        "id", *[F.col(f"b.{c}").alias(c) for c in fields_of], *[F.col(f"b.parse.{c}").alias(name) for name, c in parse.items()],
        known(F.col("sections_json"), SECTION).alias("sections"), known(F.col("references_json"), REFERENCE).alias("references"), text(F.col("paper_md")).alias("paper_md"),
    )
