"""Article pages of four publishers' layouts: sections in page order and references, with the general parser behind them.

A small reader lists what a page has where its layout puts it; kinds, numbers, texts, confidence and the choice between
the layout and the general parser are column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from folioforge.functions import metadata, urls
from folioforge.functions.pieces import in_pieces
from folioforge.functions.text import heading_kind, heading_number, heading_title
from folioforge.sources import html
from folioforge.sources.html import Node

#: Where each layout has its article, and which elements are never part of it.
ROOTS = {
    "oup": ("div#ContentTab div.widget-ArticleFulltext div.widget-items", "div.widget-ArticleFulltext div.widget-items", "div.widget-ArticleFulltext"),
    "wiley": ("div.article__body article", "article.article", "article"),
    "pmc": ("section[aria-label=Article content]", "article", "main", "body"),
    "sciencedirect": ("article",),
}
BASE_STRIPPED = {"script", "style", "noscript", "iframe", "form", "input", "button", "svg", "canvas"}
STRIPPED = {"oup": BASE_STRIPPED, "wiley": BASE_STRIPPED | {"nav", "header", "aside"}, "pmc": BASE_STRIPPED | {"nav", "header", "aside", "figure", "video", "audio", "source", "track", "picture"}, "sciencedirect": BASE_STRIPPED | {"nav", "header", "aside"}}
#: Class fragments of blocks that are no content, interface texts, and identifiers and classes of sections to leave out.
NO_CONTENT = {
    "oup": ("article-metadata", "kwd-group", "metadata-taggedcollection", "copyright", "license", "toolbar", "downloadimagesppt"),
    "wiley": ("article-section__references", "article-section__citedby", "cited-by", "tab__pane"),
}
INTERFACE = re.compile(r"^(open in new tab|download slide|download all slides|view large|open in another window)$", re.I)
LEFT_OUT_IDS = ("article-references-section-1", "cited-by", "citedby-section")
#: Article lengths in characters from which confidence takes each value.
CONFIDENCE = {"oup": ((0, 0.6), (2000, 0.75), (6000, 0.9)), "wiley": ((0, 0.6), (2500, 0.75), (7000, 0.9)), "pmc": ((0, 0.65), (1200, 0.9)), "sciencedirect": ((0, 0.6), (2500, 0.75), (9000, 0.9))}
REFERENCE_CHARS = 40

_simple = re.compile(r"^(\w*)((?:[.#][\w-]+)*)(?:\[([\w-]+)=([^\]]*)\])?$")
_doi = re.compile(metadata.DOI, re.I)
_references = re.compile(html.REFERENCES, re.I)


def matches(node: Node, simple: str) -> bool:
    tag, marks, attr, value = _simple.match(simple).groups()
    classes = node.attrs.get("class", "").split()
    return (not tag or node.tag == tag) and all(m[1:] in classes if m[0] == "." else node.attrs.get("id") == m[1:] for m in re.findall(r"[.#][\w-]+", marks)) and (not attr or node.attrs.get(attr) == value)


def select(root: Node, path: str) -> list[Node]:
    """Elements below root that a descendant path of simple selectors reaches."""
    found = [root]
    for part in re.findall(r"(?:[^\s\[]|\[[^\]]*\])+", path):
        found = list({id(d): d for n in found for d in n.walk() if matches(d, part)}.values())
    return found


def first(root: Node, *paths: str, chars: int = 1) -> Node | None:
    return next((n for p in paths for n in select(root, p)[:1] if len(line(n)) >= chars), None)


def line(node: Node) -> str:
    return " ".join(node.text().split())


def classes(node: Node) -> str:
    return node.attrs.get("class", "").lower()


def elements(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node)]


def paragraphs(node: Node, items: bool = True) -> list[str]:
    """Paragraphs, and list items without any, as lines; the whole text where there are none; no line twice in a row."""
    found = [line(n) for n in node.walk() if n.tag == "p" or items and n.tag == "li" and not any(x.tag == "p" for x in n.walk())]
    found = [x for x in found if x and not INTERFACE.match(x)] or [x for x in [line(node)] if x]
    return [x for i, x in enumerate(found) if i == 0 or x != found[i - 1]]


Section = tuple[str, int, list[str]]


def oup_sections(root: Node) -> Iterator[Section]:
    """The root's children are a stream of headings and blocks."""
    current: Section | None = None
    for c in elements(root):
        if c.tag == "h2" and any(x in classes(c) for x in ("abstract-title", "section-title", "backreferences-title")):
            if current:
                yield current
            if "backreferences-title" in classes(c):
                return
            current = ("Abstract" if "abstract-title" in classes(c) else line(c), 2, [])
        elif current and c.tag in ("p", "div", "section") and not any(x in classes(c) for x in NO_CONTENT["oup"]):
            current[2].extend([line(c)] if c.tag == "p" else paragraphs(c, items=False))
    if current:
        yield current


def wiley_sections(root: Node) -> Iterator[Section]:
    """An abstract, then content blocks; one without a heading goes on with the section before."""
    if abstract := first(root, "section.article-section__abstract"):
        yield "Abstract", 2, paragraphs(abstract)
    title, lines = "Body", []
    for block in select(root, "section.article-section__content"):
        if block.attrs.get("id") in LEFT_OUT_IDS or any(x in classes(block) for x in NO_CONTENT["wiley"]) or select(block, "section.article-section__references"):
            continue
        head = first(block, "h2.article-section__title", "h2.article-section__header", "h2")
        text = paragraphs(block)
        if head:
            if _references.match(line(head)):
                break
            yield title, 2, lines
            title, lines = line(head), []
            text = text[1:] if text[:1] == [title] else text
        lines = lines + text
    yield title, 2, lines


def pmc_is_references(node: Node) -> bool:
    return any(x in node.attrs.get("id", "").lower() for x in ("ref-list", "references", "bib")) or "ref-list" in classes(node)


def pmc_sections(root: Node) -> Iterator[Section]:
    """Loose paragraphs and sections in order, then the sections inside those; what was told already is left out."""
    body = first(root, "section.body.main-article-body") or root
    loose: list[str] = []
    for c in elements(body):
        if c.tag == "footer":
            continue
        head = first(c, "h2", "h3", "h4") if c.tag == "section" else None
        if c.tag == "section" and not pmc_is_references(c) and (head or "kwd-group" in classes(c) or "abstract" in classes(c)):
            yield "Body", 2, loose
            loose = []
            title = "Keywords" if "kwd-group" in classes(c) else line(head) if head else "Abstract"
            yield title, int(head.tag[1]) if head else 2, paragraphs(c)
        elif c.tag in ("p", "section") and not pmc_is_references(c):
            loose += paragraphs(c) if c.tag == "section" else [line(c)]
    yield "Body", 2, loose
    for c in body.walk():
        if c.tag == "section" and not pmc_is_references(c) and (head := first(c, "h2", "h3", "h4")):
            yield line(head), int(head.tag[1]), paragraphs(c)


def sciencedirect_sections(root: Node) -> Iterator[Section]:
    """The abstract, then the regions between headings of the body, with table captions instead of tables."""
    is_paragraph = lambda n: n.tag == "p" or n.tag == "div" and "u-margin-s-bottom" in classes(n)
    aside = lambda n: any(x in classes(n) for x in ("bibliography", "listarticles", "cited-by", "mathjax")) or n.attrs.get("id", "").lower().startswith(("aep-bibliography", "section-cited-by"))
    if abstract := first(root, "div#abstracts", "div.abstract", chars=121):
        yield "Abstract", 2, [line(n) for n in abstract.walk() if is_paragraph(n)]
    body = (first(root, "div#body", "div.Body") or root).cleaned(aside)
    title, level, lines = "", 2, []
    for n in body.walk():
        if n.tag in ("h2", "h3", "h4"):
            if title:
                yield title, level, lines
            title, level, lines = line(n), int(n.tag[1]), []
        elif n.tag == "div" and "tables" in classes(n):
            lines += [line(c).replace(" . ", ". ") for c in [first(n, ".captions", "caption")] if c]
        elif is_paragraph(n):
            lines.append(line(n))
    if title:
        yield title, level, lines


SECTIONS = {"oup": oup_sections, "wiley": wiley_sections, "pmc": pmc_sections, "sciencedirect": sciencedirect_sections}


def references(site: str, page: Node) -> list[tuple[str, str, str, str]]:
    """(number, text, DOI, PubMed link) of each reference."""
    if site == "oup":
        box = first(page, "div.ref-list", chars=201)
        items = box and (select(box, "div.js-splitview-ref-item") or select(box, "div.ref-content"))
    elif site == "wiley":
        box = first(page, "section.article-section__references")
        items = box and [n for n in select(box, "li") if "data-bib-id" in n.attrs]
    elif site == "pmc":
        box = next((n for n in page.walk() if n.tag == "section" and pmc_is_references(n)), None)
        items = box and [n for n in select(box, "li") if select(n, "cite")]
    else:
        box = first(page, "section.bibliography", "ol.references", chars=201)
        items = box and [n for n in select(box, "li") if len(line(n)) >= REFERENCE_CHARS]
    out = []
    for n in items or ():
        links = [a.attrs.get("href", "") for a in select(n, "a")] if site == "pmc" else []
        text = line(first(n, "cite") or n) if site == "pmc" else line(n)
        label = first(n, "span.label") if site == "pmc" else None
        given = first(n, "span.hidden.data-doi") if site == "wiley" else None
        doi = line(given) if given else next((m.group() for x in (*links, line(n)) if (m := _doi.search(x))), "")
        if text:
            out.append((line(label).rstrip(". ") if label else "", text, doi.lower(), next((x for x in links if "pubmed.ncbi.nlm.nih.gov" in x), "")))
    return out


SECTION = StructType([StructField("title", StringType()), StructField("level", IntegerType()), StructField("text", StringType()), StructField("parent", IntegerType())])
REFERENCE = StructType([StructField(c, StringType()) for c in ("n", "text", "doi", "pubmed")])
LISTED = StructType([StructField("found", BooleanType()), StructField("sections", ArrayType(SECTION)), StructField("references", ArrayType(REFERENCE)), StructField("plain", StringType()), StructField("error", StringType())])


READ = StructType([StructField("s", LISTED), StructField("p", html.PAGE)])


def _read_page(kind: str, page: str | None) -> dict:
    """What a page has where its layout puts it, and its features, of one tree."""
    whole, found = None, (False, [], [], "", None)
    if kind in SECTIONS and page:
        try:  # a page that can't be read becomes a row that says so
            whole = html.tree(page)
            if root := first(whole, *ROOTS[kind]):
                clean = root.cleaned(lambda n, out=STRIPPED[kind]: n.tag in out)
                sections, told, open_ = [], set(), []
                for title, level, lines in SECTIONS[kind](clean):
                    text = "\n".join(x for i, x in enumerate(lines) if x and (i == 0 or x != lines[i - 1]))
                    mark = f"{title}|{text[:80]}".casefold()
                    if text and mark not in told:
                        told.add(mark)
                        while open_ and open_[-1][0] >= level:
                            open_.pop()
                        sections.append((title, level, text, open_[-1][1] if open_ else None))
                        open_.append((level, len(sections)))
                found = (True, [dict(zip(SECTION.names, x, strict=True)) for x in sections], [dict(zip(REFERENCE.names, x, strict=True)) for x in references(kind, whole)], line(clean), None)
        except (ValueError, AssertionError, RecursionError) as e:
            found = (False, [], [], "", f"{type(e).__name__}: {e}"[:500])
    return {"s": dict(zip(LISTED.names, found, strict=True)), "p": html.features(page, whole)}


def _read_pages(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    return in_pieces(batches, _read_page, to_arrow_type(READ))


def read_page(site: Column, page: Column) -> Column:
    return F.arrow_udf(_read_pages, READ)(site, page)


def reference_lines(items: Column) -> Column:
    """One line a reference: number, text, DOI and PubMed link."""
    extra = lambda r: F.array_join(F.filter(F.array(F.when(r["doi"] != "", F.concat(F.lit("DOI:"), r["doi"])), F.when(r["pubmed"] != "", F.concat(F.lit("PubMed:"), r["pubmed"]))), lambda x: x.isNotNull()), " · ")
    lines = F.transform(items, lambda r: F.concat(F.when(r["n"] != "", F.concat(r["n"], F.lit(". "))).otherwise(""), r["text"], F.when(extra(r) != "", F.concat(F.lit(" ["), extra(r), F.lit("]"))).otherwise("")))
    return F.when(F.size(items) > 0, F.array_join(F.concat(F.array(F.lit("References")), lines), "\n")).otherwise("")


def parse_articles(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, parser, sections, references, article_text, references_text, confidence, capture_quality, error.

    A known layout counts if it gave any text, else the general parser's result does.
    """
    site = urls.site_kind(F.col(url_col))
    read = pages.select(F.col(id_col).alias("id"), site.alias("site"), read_page(site, F.col(html_col)).alias("r"))
    general = html.judged(read.select("id", "site", "r.s", "r.p.*"))
    known = F.col("s.found") & ((F.size("s.sections") > 0) | (F.col("s.plain") != ""))
    number = lambda i: F.format_string("s%02d", i)
    titled = F.transform("s.sections", lambda x, i: F.struct(number(i + 1).alias("id"), heading_title(x["title"]).alias("title"), heading_kind(x["title"]).alias("kind"), heading_number(x["title"]).alias("number"), x["level"].alias("level"), F.when(x["parent"].isNotNull(), number(x["parent"])).alias("parent_id"), x["text"].alias("text")))
    text = F.when(F.size("s.sections") > 0, F.array_join(F.transform("s.sections", lambda x: F.concat(x["title"], F.lit("\n"), x["text"])), "\n\n")).otherwise(F.col("s.plain"))
    steps = F.lit(0.0)
    for kind, marks in CONFIDENCE.items():
        for least, value in marks:
            steps = F.when((F.col("site") == kind) & (F.length(text) >= least), F.lit(value)).otherwise(steps)
    return general.select(
        "id", F.when(known, F.col("site")).otherwise("generic").alias("parser"), F.when(known, titled).alias("sections"), F.when(known, F.col("s.references")).alias("references"),
        F.when(known, text).otherwise(F.col("article_text")).alias("article_text"), F.when(known, reference_lines(F.col("s.references"))).otherwise(F.col("references_text")).alias("references_text"),
        F.when(known, steps).otherwise(F.col("confidence")).alias("confidence"), F.when(known, F.lit("ok")).otherwise(F.col("capture_quality")).alias("capture_quality"), F.coalesce("s.error", "error").alias("error"),
    )
