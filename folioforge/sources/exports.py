"""Exports: BibTeX, RIS, Markdown, sections JSON and papers JSONL, as one text column a capture and as files.

Captures: id, url, title, doi, year, container_title, authors, keywords (arrays), abstract.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from folioforge.functions.strings import collapse, strip, text
from folioforge.functions.text import standard_text
from folioforge.operators import graph
from folioforge.operators.ordering import numbered

#: Section kinds that the papers export leaves out.
NOT_PAPER = ("acknowledgements", "author_contributions", "funding", "conflicts", "keywords")


def _some(parts: list[Column]) -> Column:
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def escaped_bibtex(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("{", "\\{"), ("}", "\\}"), ('"', '\\"')):
        c = F.replace(c, F.lit(a), F.lit(b))
    return collapse(c)


def bibtex_entry() -> Column:
    s = lambda c: strip(text(F.col(c)))
    field = lambda name, value, given: F.when(given, F.concat(F.lit(f"  {name} = {{"), value, F.lit("}")))
    year = F.col("year").isNotNull() & (F.col("year") != 0)
    fields = _some([
        field("title", escaped_bibtex(F.when(s("title") == "", F.lit("Untitled")).otherwise(s("title"))), F.lit(True)),
        field("author", escaped_bibtex(F.array_join("authors", " and ")), F.size("authors") > 0),
        field("journal", escaped_bibtex(s("container_title")), s("container_title") != ""),
        field("year", F.col("year").cast("string"), year),
        field("doi", escaped_bibtex(s("doi")), s("doi") != ""),
        field("url", escaped_bibtex(s("url")), s("url") != ""),
        field("abstract", escaped_bibtex(collapse(text(F.col("abstract")))), collapse(text(F.col("abstract"))) != ""),
        field("keywords", escaped_bibtex(F.array_join("keywords", ", ")), F.size("keywords") > 0),
    ])
    key = F.concat(F.lit("pc"), F.when(year, F.col("year").cast("string")).otherwise("nd"), F.lit("_"), F.substring(text(F.col("id")), 1, 8))
    return F.concat(F.lit("@"), F.when(s("container_title") != "", "article").otherwise("misc"), F.lit("{"), key, F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("\n}"))


def ris_entry() -> Column:
    s = lambda c: strip(text(F.col(c)))
    line = lambda tag, value, given: F.when(given, F.concat(F.lit(f"{tag}  - "), value))
    many = lambda tag, items: F.transform(items, lambda x: F.concat(F.lit(f"{tag}  - "), x))
    year = F.col("year").isNotNull() & (F.col("year") != 0)
    abstract = collapse(text(F.col("abstract")))
    words = F.filter(F.transform("keywords", strip), lambda k: k != "")
    lines = F.concat(
        _some([line("TY", F.when(s("container_title") != "", "JOUR").otherwise("GEN"), F.lit(True)), line("TI", s("title"), s("title") != "")]),
        many("AU", F.col("authors")),
        _some([line("JO", s("container_title"), s("container_title") != ""), line("PY", F.col("year").cast("string"), year), line("DO", s("doi"), s("doi") != ""), line("UR", s("url"), s("url") != ""), line("AB", abstract, abstract != "")]),
        many("KW", words),
        F.array(F.lit("ER  -")),
    )
    return F.array_join(lines, "\n")


def paper_sections(sections: Column) -> Column:
    """Sections (id, kind, title, text) without the kinds that papers leave out, texts standardised, blank ones dropped."""
    clean = F.transform(sections, lambda s: F.struct(text(s["id"]).alias("id"), strip(text(s["kind"])).alias("kind"), text(s["title"]).alias("title"), standard_text(s["text"], lambda c: c).alias("text")))
    return F.filter(clean, lambda s: ~s["kind"].isin(*NOT_PAPER) & (s["text"] != ""))


def paper_markdown(references: Column, sections: Column | None = None) -> Column:
    """A capture's Markdown from its columns and its sections (title, kind, text)."""
    title = collapse(text(F.col("title")))
    bits = _some([
        F.when(text(F.col("doi")) != "", F.concat(F.lit("DOI: `"), F.col("doi"), F.lit("`"))),
        F.when(text(F.col("container_title")) != "", strip(F.col("container_title"))),
        F.when(F.col("year").isNotNull() & (F.col("year") != 0), F.col("year").cast("string")),
        F.when(text(F.col("url")) != "", strip(F.col("url"))),
    ])
    full = F.filter(F.transform(F.col("sections") if sections is None else sections, lambda s: F.struct(F.coalesce(F.nullif(strip(text(s["title"])), F.lit("")), F.lit("Section")).alias("title"), strip(text(s["kind"])).alias("kind"), strip(text(s["text"])).alias("text"))), lambda s: s["text"] != "")
    blocks = F.transform(full, lambda s: F.concat(F.when((s["title"] == "Body") & (s["kind"] == "other"), F.lit("")).otherwise(F.concat(F.lit("## "), F.regexp_replace(s["title"], r"[\r\n]", " "), F.lit("\n"))), s["text"]))
    refs = strip(text(references))
    parts = F.concat(F.array(F.concat(F.lit("# "), F.when(title == "", "Untitled").otherwise(title))), F.when(F.size(bits) > 0, F.array(F.concat(F.lit("**"), F.array_join(bits, " · "), F.lit("**")))).otherwise(F.array().cast("array<string>")), blocks, F.when(refs != "", F.array(F.concat(F.lit("## References\n"), refs))).otherwise(F.array().cast("array<string>")))
    return F.concat(F.array_join(parts, "\n\n"), F.lit("\n"))


def paper_json() -> Column:
    """One papers JSONL line: sixteen keys in fixed order, nulls kept."""
    keys = ["id", "captured_at", "published_date_raw", "title", "doi", "url", "year", "container_title", "authors", "parse_parser", "parse_ok", "capture_quality", "blocked_reason", "confidence_fulltext", "used_for_index"]
    return F.to_json(F.struct(*keys, paper_sections(F.col("sections")).alias("sections")), {"ignoreNullFields": "false"})


def slug(value: str, most: int = 80) -> str:
    return re.sub(r"[^a-z0-9]+", "-", (value or "").strip().lower()).strip("-")[:most] or "export"


def file_name(extension: str, base: str = "library", capture_id: str | None = None, collection: str | int | None = None, suffix: str | None = None, selected: bool = False) -> str:
    """base, then what was exported, joined by underscores."""
    what = slug(capture_id)[:12] if capture_id else slug(collection) if isinstance(collection, str) and collection else f"col{collection}" if collection else None
    return "_".join(x for x in (base, what, slug(suffix) if suffix else None, "selected" if selected else None) if x) + f".{extension}"


def slug_of(c: Column, most: int = 80) -> Column:
    """slug() of a column, null as empty."""
    dashed = F.regexp_replace(F.lower(strip(text(c))), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.substring(F.trim(dashed, F.lit("-")), 1, most), F.lit("")), F.lit("export"))


def capture_file_name(extension: str, base: str, capture_id: Column, suffix: Column | None = None) -> Column:
    """file_name() of an export of one capture each row; a blank suffix is none."""
    named = [] if suffix is None else [F.when(strip(text(suffix)) != "", slug_of(suffix))]
    return F.concat(F.concat_ws("_", F.lit(base), F.substring(slug_of(capture_id), 1, 12), *named), F.lit(f".{extension}"))


def scope(captures: DataFrame, items: DataFrame, capture_id: str | None = None, collection: int = 0) -> DataFrame:
    """What an export covers: one capture (nothing if there is none), else a collection, else all."""
    if capture_id and capture_id.strip():
        return captures.where(F.col("id") == capture_id.strip())
    if collection > 0:
        return captures.join(items.where(F.col("collection_id") == collection).select(F.col("capture_id").alias("id")), "id", "left_semi")
    return captures


def best_markdown(stored: Column, article_text: Column, references_text: Column) -> Column:
    """The stored Markdown, else one made of the article's text as a single body."""
    body = strip(text(article_text))
    sections = F.when(body != "", F.array(F.struct(F.lit("Body").alias("title"), F.lit("other").alias("kind"), body.alias("text")))).otherwise(F.array().cast("array<struct<title:string,kind:string,text:string>>"))
    return F.when(strip(text(stored)) != "", F.concat(F.regexp_replace(stored, r"\s+\z", ""), F.lit("\n"))).otherwise(paper_markdown(references_text, sections))


def master_markdown(captures: DataFrame, title: str, order: list[str]) -> DataFrame:
    """pos (array), value: the parts of one Markdown file in order of pos: a header that counts all captures, then each `paper_md` with text."""
    key = F.array(*[F.col(c).cast("string") for c in order])
    blobs = captures.select(key.alias("pos"), strip(text(F.col("paper_md"))).alias("md")).where("md != ''")
    first = blobs.agg(F.min("pos").alias("first"))
    parts = blobs.crossJoin(F.broadcast(first)).select("pos", F.concat(F.when(F.col("pos") == F.col("first"), F.lit("\n")).otherwise(F.lit("\n\n---\n\n")), "md", F.lit("\n")).alias("value"))
    header = captures.agg(F.count(F.lit(1)).alias("n")).select(F.array().cast("array<string>").alias("pos"), F.concat(F.lit(f"# {title}\n\n_Items: "), "n", F.lit("_\n")).alias("value"))
    return header.unionByName(parts)


def sections_json() -> Column:
    """One capture of the sections export: keys in order of name, nulls kept."""
    return F.to_json(F.struct("container_title", "doi", "id", "sections", "title", "url", "year"), {"ignoreNullFields": "false"})


def json_text(c: Column) -> Column:
    """A text as JSON; null as null."""
    quoted = F.to_json(F.array(c))
    return F.coalesce(F.when(c.isNotNull(), F.substring(quoted, F.lit(2), F.length(quoted) - 2)), F.lit("null"))


def pretty_json(c: Column, kind: DataType, indent: int = 0) -> Column:
    """A value as JSON over several lines, two spaces a level, keys in order of name, nulls kept."""
    pad, inner = " " * indent, " " * (indent + 2)
    if isinstance(kind, StructType):
        if not kind.fields:
            return F.lit("{}")
        cells = [F.concat(F.lit(f'{inner}"{f.name}": '), pretty_json(c.getField(f.name), f.dataType, indent + 2)) for f in sorted(kind.fields, key=lambda f: f.name)]
        whole = F.concat(F.lit("{\n"), F.concat_ws(",\n", *cells), F.lit(f"\n{pad}}}"))
    elif isinstance(kind, ArrayType):
        cells = F.transform(c, lambda x: F.concat(F.lit(inner), pretty_json(x, kind.elementType, indent + 2)))
        whole = F.when(F.size(c) == 0, "[]").otherwise(F.concat(F.lit("[\n"), F.array_join(cells, ",\n"), F.lit(f"\n{pad}]")))
    elif isinstance(kind, StringType):
        return json_text(c)
    else:
        whole = c.cast("string")
    return F.coalesce(F.when(c.isNotNull(), whole), F.lit("null"))


def json_array(rows: DataFrame, order: list[Column]) -> DataFrame:
    """n, value: the lines of one JSON array of all rows in order of n, a row each; a single line if there are none.

    Brackets and commas come with the rows, as each knows its number and how many there are: no task sees them all.
    """
    item = pretty_json(F.struct(*rows.columns), StructType(rows.schema.fields), 2)
    lines = numbered(rows, order, "_n").select(F.col("_n").alias("n"), item.alias("item"))
    lines = graph.stored(lines, "export-items")
    total = lines.count()
    if not total:
        return rows.sparkSession.createDataFrame([(0, "[]")], "n long, value string")
    begin, end = F.when(F.col("n") == 1, "[\n  ").otherwise("  "), F.when(F.col("n") == total, "\n]").otherwise(",")
    return lines.select("n", F.concat(begin, "item", end).alias("value"))


def write_parts(lines: DataFrame, order: list, path: str, parts: int | None = None) -> None:
    """Lines in global order as many text files: those of a folder, put together in order of their names, are one file."""
    dealt = lines.repartitionByRange(parts, *order) if parts else lines.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def row_json(captures: DataFrame) -> DataFrame:
    """id, row: each capture's row as JSON, columns in their order, nulls kept."""
    return captures.select("id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))


def write_lines(entries: DataFrame, column: str, order: list, path: str, separator: str = "\n") -> None:
    """Entries in global order as text files, whose names sort in that order."""
    entries.orderBy(*order).select(F.col(column).alias("value")).write.mode("overwrite").option("lineSep", separator).text(path)
