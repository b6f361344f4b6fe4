"""Text standardisation and heading rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.strings import WS, collapse, nfkc, rstrip, strip, text

#: Lines of page furniture, in lower case.
UI_LINES = (
    "download pdf", "article pdf", "open in new tab", "open in a new tab", "view full text", "view article", "metrics", "view metrics", "cite this article",
    "share", "sign in", "log in", "register", "cookies", "cookie preferences", "manage cookies", "privacy policy", "terms of use", "rights and permissions",
    "get access", "subscribe", "institutional access",
)
#: Longest line that can be page furniture.
UI_LINE_CHARS = 80

#: A line of keywords, a numbered heading, what a heading may consist of, and how sentences start that are none.
KEYWORDS_LINE = r"(?iU)^\s*keywords?\s*:\s*(.+)\s*$"
NUMBERED = r"(?U)^\s*(?:(\d+(?:\.\d+)*)\s*[.)]\s+)?(.+?)\s*$"
HEADING_LINE = r"(?U)^\s*([^\W\d_][\w \-–—,:;()'’/]{2,160})\s*$"
SENTENCE_STARTS = r"^(this |we |in this |however |therefore )"
#: Kinds of headings with the patterns that a whole heading must match, in the order in which they are tried.
HEADING_KINDS = (
    ("results_discussion", r"results?\s*(and|&)\s*discussion|discussion\s*(and|&)\s*results?"),
    ("abstract", r"abstract"),
    ("keywords", r"keywords?"),
    ("introduction", r"introduction|background"),
    ("methods", r"methods?|materials\s+and\s+methods?|methodology"),
    ("results", r"results?"),
    ("discussion", r"discussion"),
    ("conclusion", r"conclusion|conclusions"),
    ("references", r"references|bibliography|works cited|literature cited|citations"),
    ("acknowledgements", r"acknowledg(e)?ments?|acknowledgments"),
    ("funding", r"funding"),
    ("conflicts", r"conflicts? of interest|competing interests?"),
    ("author_contributions", r"author contributions?"),
)


def plain_whitespace(c: Column, normalize=nfkc) -> Column:
    """NFKC, no invisible characters, \\n line ends, single spaces, at most one blank line in a row, stripped."""
    s = normalize(text(c))
    s = F.translate(F.translate(s, "\u00a0", " "), "\u00ad\u200b\u200c\u200d\ufeff", "")
    s = F.regexp_replace(s, r"\r\n?", "\n")
    s = F.regexp_replace(s, WS.replace("\\u000a", "") + r"++(?=\n|\z)", "")
    s = F.regexp_replace(s, r"[ \t\f\x0B]+", " ")
    return strip(F.regexp_replace(s, r"\n{3,}", "\n\n"))


#: A hyphen that wraps a word over a line end: behind two letters, or behind one that the match before has joined to others.
_WRAP = r"(?:(?<=[A-Za-z]{2})|(?<=(?!\A)\G[A-Za-z]))-\n(?:[ \t]*\n)?(?=[A-Za-z])"


def joined_words(c: Column) -> Column:
    """Words that a hyphen wraps over a line end become whole, in one pass."""
    return F.regexp_replace(c, _WRAP, "")


def without_ui_lines(c: Column) -> Column:
    """Without short lines that are page furniture or start with it."""
    phrases = "^(" + "|".join(UI_LINES) + ")( .*)?$"
    kept = F.filter(F.split(c, "\n", -1), lambda x: ~((F.length(strip(x)) <= UI_LINE_CHARS) & F.lower(collapse(x)).rlike(phrases)))
    return strip(F.array_join(F.transform(kept, rstrip), "\n"))


def standard_text(c: Column, normalize=nfkc) -> Column:
    """`normalize` is the Unicode normalisation; pass the identity where text is known to be NFKC. What it has made stays so: joining words and dropping lines bring no letters and marks together."""
    return plain_whitespace(without_ui_lines(joined_words(plain_whitespace(c, normalize))), lambda x: x)


def heading_number(line: Column) -> Column:
    return F.nullif(F.regexp_extract(collapse(text(line)), NUMBERED, 1), F.lit(""))


def heading_title(line: Column) -> Column:
    s = collapse(text(line))
    return F.when(s == "", s).otherwise(collapse(F.regexp_extract(s, NUMBERED, 2)))


def heading_kind(line: Column) -> Column:
    def kind_of(h: Column) -> Column:
        out = F.when(h["line"].rlike(KEYWORDS_LINE), "keywords")
        for kind, pattern in HEADING_KINDS:
            out = out.when(h["title"].rlike(rf"(?iU)^\s*({pattern})\s*$"), kind)
        return out.otherwise("other")

    # An array of one binds what all patterns look at; without it each would compute it anew.
    return F.transform(F.array(F.struct(collapse(text(line)).alias("line"), heading_title(line).alias("title"))), kind_of)[0]


def heading_kinds(kind: Column) -> Column:
    return F.when(kind == "results_discussion", F.array(F.lit("results"), F.lit("discussion"))).otherwise(F.array(kind))


#: Characters that a heading has, at least and at most.
HEADING_CHARS = (3, 220)


def is_heading(line: Column) -> Column:
    """Whether a line reads like a heading. Only lines of the right length are looked at closely."""
    bad_end = r"(?U)[.?!]\s*$"

    def reads_so(h: Column) -> Column:
        s, title = h["line"], h["title"]
        base = F.substring(s, F.lit(1), F.length(s) - 1)
        label = s.endswith(":") & (collapse(base) != "") & (heading_kind(base) == "other")
        shape = ~title.rlike(bad_end) & title.rlike(HEADING_LINE) & (F.size(F.split(title, f"{WS}+")) <= 16) & ~F.lower(F.substring(title, 1, 15)).rlike(SENTENCE_STARTS)
        return s.rlike(KEYWORDS_LINE) | (shape & ~label)

    def may_be(h: Column) -> Column:
        s = h["line"]
        title = F.when(heading_number(s).isNotNull(), heading_title(s)).otherwise(collapse(s))
        close = F.transform(F.array(F.struct(s.alias("line"), title.alias("title"))), reads_so)[0]
        return F.when(F.length(s).between(*HEADING_CHARS) & ~F.rtrim(s).rlike(r"[.?!]$"), close).otherwise(False)

    return F.transform(F.array(F.struct(strip(text(line)).alias("line"))), may_be)[0]
