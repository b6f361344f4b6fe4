"""Sections of article texts, row by row: a text's lines, merged lines and sections are arrays, so nothing moves between tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.strings import collapse, text
from folioforge.functions.text import KEYWORDS_LINE, heading_kind, heading_kinds, heading_number, heading_title, is_heading

#: What ends a line.
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
#: What comes before a heading while sections are cut; lines whose white space is collapsed don't hold it.
CUT = "\x1e"


def lines_of(c: Column) -> Column:
    """The lines of a text, each with its white space collapsed."""
    return F.transform(F.split(text(c), LINE_ENDS, -1), collapse)


def headings_in(c: Column) -> Column:
    """How many lines of a text read like headings."""
    return F.size(F.filter(lines_of(c), is_heading)).cast("long")


def merged_lines(lines: Column) -> Column:
    """Lines that are not blank, a fragment of up to 3 characters, or 6 with a full stop, joined to the line before unless that is blank. `lines` is a plain column: it is looked at for each line."""
    fragment = lambda x: (x != "") & ((F.length(x) <= 3) | ((F.length(x) <= 6) & x.endswith(".")))
    behind = lambda i: F.coalesce(F.get(lines, i - 1), F.lit("")) != ""
    glued = F.transform(lines, lambda x, i: F.concat(F.when(fragment(x) & behind(i), " ").otherwise("\n"), x))
    return F.filter(F.split(F.array_join(glued, ""), "\n"), lambda x: x != "")


def split_sections(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, section_id, title, kind, kinds, number, text, level: the sections with text, numbered in order; text before a heading is `Body`."""
    lines = docs.select(F.col(id_col).alias("id"), lines_of(F.col(text_col)).alias("lines"))
    merged = lines.select("id", merged_lines(F.col("lines")).alias("lines"))
    marked = F.transform("lines", lambda x: F.concat(F.when(is_heading(x), CUT).otherwise(""), x))
    cut = merged.select("id", F.split(F.array_join(marked, "\n"), CUT).alias("parts"))
    head = lambda part, i: F.when(i > 0, F.substring_index(part, "\n", 1))
    rest = lambda part, i: F.rtrim(F.when(i > 0, F.substring(part, F.length(F.substring_index(part, "\n", 1)) + 2, F.length(part))).otherwise(part), F.lit("\n"))

    def section(s: Column) -> Column:
        inline = F.when(s["head"].rlike(KEYWORDS_LINE), F.concat(F.lit("Keywords: "), collapse(F.regexp_extract(s["head"], KEYWORDS_LINE, 1))))
        return F.struct(s["head"].alias("head"), F.concat_ws("\n", inline, F.nullif(s["body"], F.lit(""))).alias("text"))

    parts = F.transform("parts", lambda p, i: F.struct(head(p, i).alias("head"), rest(p, i).alias("body")))
    full = cut.select("id", F.posexplode(F.filter(F.transform(parts, section), lambda s: s["text"] != "")).alias("n", "s"))
    keywords = F.col("s.head").rlike(KEYWORDS_LINE)
    kind = F.when(F.col("s.head").isNull(), "other").when(keywords, "keywords").otherwise(heading_kind(heading_title(F.col("s.head"))))
    return full.select(
        "id", F.format_string("s%02d", F.col("n") + 1).alias("section_id"), F.when(F.col("s.head").isNull(), "Body").when(keywords, "Keywords").otherwise(heading_title(F.col("s.head"))).alias("title"),
        kind.alias("kind"), heading_kinds(kind).alias("kinds"), F.when(~keywords, heading_number(F.col("s.head"))).alias("number"), "s.text", F.lit(2).alias("level"),
    )
