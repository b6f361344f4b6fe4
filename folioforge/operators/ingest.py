"""From raw capture payloads to bibliographic rows: validation with quarantine, canonical URLs, metadata, article text.

Payloads are JSON texts: {source_url, dom_html, extraction: {meta, content_html}, client}. Fields of the wrong type count
as absent; only a payload that is no object, or has no source_url, is turned away.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import MapType, StringType, StructField, StructType

from folioforge.functions import metadata, urls
from folioforge.functions.pieces import in_pieces
from folioforge.functions.strings import strip, text
from folioforge.functions.text import standard_text
from folioforge.sources import html

PAYLOAD = "source_url string, dom_html string, extraction struct<meta: map<string, string>, content_html: string>, client struct<ext: string, v: string>"
#: Confidence from which the parsed article is indexed instead of the page's plain text.
INDEX_CONFIDENCE = 0.45


def _values(v: Column) -> Column:
    """A metadata value, a text or a JSON list of texts, as a list without blanks."""
    many = F.when(v.startswith("["), F.from_json(v, "array<string>"))
    return F.filter(F.transform(F.coalesce(many, F.array(v)), lambda x: strip(text(x))), lambda x: x != "")


def validated(raw: DataFrame, column: str = "value") -> DataFrame:
    """raw with `payload` and `error_code` (null, invalid_json or missing_field)."""
    whole = F.try_parse_json(F.col(column))
    is_object = F.coalesce(F.schema_of_variant(whole).startswith("OBJECT"), F.lit(False))
    read = raw.withColumn("payload", F.from_json(F.col(column), PAYLOAD, {"mode": "PERMISSIVE"})).withColumn("is_object", is_object)
    code = F.when(~F.col("is_object"), "invalid_json").when(strip(text(F.col("payload.source_url"))) == "", "missing_field")
    return read.withColumn("error_code", code).drop("is_object")


def index_choice(parsed_text: Column, quality: Column, confidence: Column, base_text: Column) -> tuple[Column, Column]:
    """Whether the parsed article is what is indexed, and the text that is: else the page's plain text."""
    use = (parsed_text != "") & (quality != "blocked") & (confidence >= INDEX_CONFIDENCE)
    return use, F.when(use, parsed_text).otherwise(base_text)


READ = StructType([StructField("p", html.PAGE), StructField("normal", MapType(StringType(), StringType())), StructField("base_text", StringType())])


def _read_payload(page: str | None, content: str | None) -> dict:
    """A page's features, the stripped texts of its blocks that NFKC changes, by hint, and the content's text on one line in NFKC."""
    p = html.features(page)
    normal = [(b["hint"], unicodedata.normalize("NFKC", b["body"].strip())) for b in p["blocks"] if not unicodedata.is_normalized("NFKC", b["body"])]
    return {"p": p, "normal": normal, "base_text": unicodedata.normalize("NFKC", " ".join(html.visible_text(content).split())[: html.TEXT_CHARS])}


def _read_payloads(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    return in_pieces(batches, _read_payload, to_arrow_type(READ))


def parsed(good: DataFrame) -> DataFrame:
    """One row per valid payload (payload, captured_at, seq): identity, bibliographic fields, article and index text."""
    rows = good.select(
        "captured_at", "seq", strip(F.col("payload.source_url")).alias("url"), text(F.col("payload.dom_html")).alias("dom_html"),
        text(F.col("payload.extraction.content_html")).alias("content_html"), F.transform_values(F.coalesce("payload.extraction.meta", F.create_map().cast("map<string,string>")), lambda k, v: _values(v)).alias("client_meta"),
    )
    read = rows.withColumn("url_canon", urls.canonical_url(F.col("url"))).withColumn("r", F.arrow_udf(_read_payloads, READ)("dom_html", "content_html"))
    page = html.judged(read.select("*", "r.p.*", "r.normal", "r.base_text").drop("r", "dom_html", "content_html"))
    meta = metadata.merged_meta(F.col("meta"), F.col("client_meta"))
    standard = lambda c: standard_text(c, lambda x: x)
    # An array of one binds the text; without it each use would standardise it anew.
    parsed_text = F.array(standard(F.coalesce(F.try_element_at("normal", F.col("selected_hint")), F.col("article_text"))))
    choose = lambda t: index_choice(t, F.col("capture_quality"), F.col("confidence"), standard(F.col("base_text")))
    choice = F.transform(parsed_text, lambda t: F.struct(*[c.alias(name) for name, c in zip(("use", "text"), choose(t), strict=True)]))[0]
    fields = page.withColumn("meta", meta).withColumn("choice", choice).withColumn("published_date_raw", metadata.best_date(F.col("meta")))
    return fields.select(
        "captured_at", "seq", "url", "url_canon", urls.url_hash(F.col("url_canon")).alias("url_hash"), urls.site_kind(F.col("url")).alias("site"),
        metadata.best_title(F.col("meta"), F.col("title_tag"), F.col("url")).alias("title"), metadata.best_doi(F.col("meta")).alias("doi"), metadata.year(F.col("published_date_raw")).alias("year"),
        metadata.best_container(F.col("meta")).alias("container_title"), metadata.best_authors(F.col("meta")).alias("authors"), metadata.best_keywords(F.col("meta")).alias("keywords"),
        metadata.best_abstract(F.col("meta")).alias("abstract"), "published_date_raw", "selected_hint", "confidence", "capture_quality", "blocked_reason", F.col("error").alias("parse_error"),
        F.nullif("article_text", F.lit("")).alias("article_text"), F.nullif("references_text", F.lit("")).alias("references_text"), F.col("choice.use").alias("used_for_index"),
        F.col("choice.text").alias("content_text"),
    )
