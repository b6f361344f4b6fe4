"""Open records: JSON objects whose fields come in several shapes, parsed once a row as VARIANT and read with types.

A field may be a text, a number, a list or an object. JSON that can't be read, or is no object, is an empty record. Numbers
and booleans in place of texts count as their JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.metadata import FAMILY_KEYS, GIVEN_KEYS
from folioforge.functions.strings import dedupe, strip, text

#: Lists within lists that are joined; what lies deeper stays JSON text.
NESTED = 3
NO_TEXTS = "array<string>"


def record(json: Column) -> Column:
    """The object in a JSON text as VARIANT, null if there is none."""
    return F.transform(F.array(F.try_parse_json(json)), lambda v: F.when(is_object(v), v))[0]


def is_object(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), F.lit(False))


def items(v: Column, path: str = "$") -> Column:
    """The elements of a list, null if there is none."""
    return F.try_variant_get(v, path, "array<variant>")


def as_text(v: Column, depth: int = NESTED) -> Column:
    """A value as text: null as empty, a list as its texts that aren't empty, joined by "; "."""
    plain = text(F.try_variant_get(v, "$", "string"))
    if not depth:
        return plain
    joined = F.array_join(F.filter(F.transform(items(v), lambda x: as_text(x, depth - 1)), lambda x: x != ""), "; ")
    return F.coalesce(joined, plain)


def said(v: Column, path: str) -> Column:
    """A field as text; empty if it is not there, null, false, zero or empty."""
    found = text(F.try_variant_get(v, path, "string"))
    no_text = F.schema_of_variant(F.try_variant_get(v, path, "variant")) != "STRING"
    return F.when(found.isin("false", "0", "0.0", "[]", "{}") & no_text, "").otherwise(found)


def texts(v: Column, path: str) -> Column:
    """A text as a list of one, or the elements of a list as texts; without blanks and repeats."""
    many = F.transform(items(v, path), lambda x: F.try_variant_get(x, "$", "string"))
    one = F.try_variant_get(v, path, "string")
    return dedupe(F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast(NO_TEXTS)))


def person(v: Column) -> Column:
    """A display name from a text or a person's object: given and family name, else the family name or the name."""
    of = lambda keys: strip(F.coalesce(*[F.nullif(said(v, f"$.{k}"), F.lit("")) for k in keys], F.lit("")))
    family, given, name = of(FAMILY_KEYS), of(GIVEN_KEYS), of(("name",))
    full = F.when((given != "") & (family != ""), F.concat(given, F.lit(" "), family)).when(family != "", family).otherwise(name)
    return F.when(is_object(v), full).otherwise(strip(as_text(v, 0)))


def people(v: Column, path: str) -> Column:
    one = F.try_variant_get(v, path, "string")
    return dedupe(F.coalesce(F.transform(items(v, path), person), F.when(one.isNotNull(), F.array(one)), F.array().cast(NO_TEXTS)))


def meta_record(json: Column) -> Column:
    """meta (texts by key), keywords, authors, abstract, published_date_raw, client (text by key): a record's stable fields."""

    def fields(v: Column) -> Column:
        values = lambda x: F.coalesce(F.transform(items(x), lambda e: as_text(e)), F.array(as_text(x)))
        meta = F.transform_values(F.try_variant_get(v, "$.meta", "map<string,variant>"), lambda k, x: F.filter(values(x), lambda s: s != ""))
        client = F.transform_values(F.try_variant_get(v, "$.client", "map<string,variant>"), lambda k, x: as_text(x))
        plain = lambda path: strip(text(F.try_variant_get(v, path, "string")))
        return F.struct(
            F.coalesce(meta, F.create_map().cast("map<string,array<string>>")).alias("meta"), texts(v, "$.keywords").alias("keywords"), people(v, "$.authors").alias("authors"),
            plain("$.abstract").alias("abstract"), plain("$.published_date_raw").alias("published_date_raw"), F.coalesce(client, F.create_map().cast("map<string,string>")).alias("client"),
        )

    # An array of one binds the record, so that it is parsed once.
    return F.transform(F.array(record(json)), fields)[0]


def parse_summary(v: Column, path: str = "$.parse") -> Column:
    """parser, ok, capture_quality, blocked_reason, confidence_fulltext, used_for_index of a parser's summary."""
    of = lambda c: said(v, f"{path}.{c}")
    return F.struct(
        of("parser").alias("parser"), (of("ok") != "").alias("ok"), of("capture_quality").alias("capture_quality"), of("blocked_reason").alias("blocked_reason"),
        F.coalesce(of("confidence_fulltext").try_cast("double"), F.lit(0.0)).alias("confidence_fulltext"), (of("used_for_index") != "").alias("used_for_index"),
    )
