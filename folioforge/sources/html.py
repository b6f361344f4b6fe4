"""Web pages: head metadata, plain text, and the main article with its references.

A small parser turns a page into a tree (an end tag closes the nearest open element of its name; nothing else closes
implicitly) and reports what blocks there are and what they hold; choosing among them, confidence and wall detection are
column expressions over those features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from folioforge.functions.pieces import in_pieces
from folioforge.functions.strings import collapse, strip

#: Elements without content, elements that are never article text, and fragments of class or id names of page furniture.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NOT_TEXT = {"script", "style", "template"}
STRIPPED = {"script", "style", "noscript", "iframe", "form", "input", "button", "svg", "canvas", "nav", "header", "footer", "aside"}
FURNITURE = ("nav", "breadcrumb", "toolbar", "cookie", "consent", "subscribe", "paywall", "header", "footer", "sidebar", "related", "recommend", "advert", "promo")
FURNITURE_CHARS = 400
#: Elements and titles of headings, words that sections are named by, and characters of a page's text that are kept.
HEADINGS = ("h1", "h2", "h3", "h4")
REFERENCES = r"^\s*(references|bibliography|works cited|literature cited|citations)\s*$"
SECTION_WORDS = r"(?i)\b(abstract|introduction|methods?|materials?|results?|discussion|conclusion|references)\b"
TEXT_CHARS = 400_000
#: Patterns of cookie walls, paywalls and robot checks in a page's text, in the order in which they are tried.
WALLS = (
    (r"\bcookie(s)?\b.*\b(consent|preferences)\b", "cookie_wall"),
    (r"\b(consent|gdpr)\b", "cookie_wall"),
    (r"\bsubscribe\b|\bsubscription\b|\bsign in\b|\blog in\b", "paywall"),
    (r"\bactivate\b.*\bsubscription\b", "paywall"),
    (r"\bunusual traffic\b|\bare you a robot\b|\bcaptcha\b", "bot_block"),
    (r"\b(accept|reject|manage)\b.*\b(cookie|consent)\b", "cookie_wall"),
)
#: Page lengths below which a wall blocks, and below which a page is suspicious.
BLOCKED_CHARS, SHORT_CHARS = 4000, 800

_references = re.compile(REFERENCES, re.I)


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        """The elements below, in document order."""
        stack = [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, Node):
                    yield c
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()

    def text(self, sep: str = " ") -> str:
        out, stack = [], [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, str):
                    if c := c.strip():
                        out.append(c)
                elif c.tag not in NOT_TEXT:
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()
        return sep.join(out)

    def cleaned(self, dropped) -> Node:
        """A copy without the elements for which dropped(element) holds."""
        out = Node(self.tag, self.attrs)
        stack = [(iter(self.children), out)]
        while stack:
            source, target = stack[-1]
            for c in source:
                if isinstance(c, str):
                    target.children.append(c)
                elif not dropped(c):
                    copy = Node(c.tag, c.attrs)
                    target.children.append(copy)
                    stack.append((iter(c.children), copy))
                    break
            else:
                stack.pop()
        return out


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in reversed(attrs)}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def lengths(root: Node) -> dict[int, int]:
    """The number of characters of each element's text(), by the element's id(), from the leaves up."""
    held: dict[int, tuple[int, int]] = {}
    for n in reversed([root, *root.walk()]):
        chars = pieces = 0
        for c in n.children:
            if isinstance(c, str):
                size = len(c.strip())
                chars, pieces = chars + size, pieces + (size > 0)
            elif c.tag not in NOT_TEXT:
                chars, pieces = chars + held[id(c)][0], pieces + held[id(c)][1]
        held[id(n)] = chars, pieces
    return {k: chars + max(0, pieces - 1) for k, (chars, pieces) in held.items()}


def is_furniture(node: Node, chars: int) -> bool:
    names = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower()
    return any(f in names for f in FURNITURE) and chars < FURNITURE_CHARS


def block_text(node: Node) -> str:
    """Headings, paragraphs and list items as lines; items that hold paragraphs are left to those."""
    lines = (n.text() for n in node.walk() if n.tag in (*HEADINGS, "p", "li") and not (n.tag == "li" and any(x.tag == "p" for x in n.walk())))
    return "\n".join(x for x in lines if x)


def body_and_references(node: Node) -> tuple[str, str]:
    """The text before the child with the first reference heading, and the text from it on."""
    head = next((h for h in node.walk() if h.tag in HEADINGS and _references.match(" ".join(h.text().split()))), None)
    if head is None:
        return block_text(node), ""
    children = [c for c in node.children if isinstance(c, Node)]
    at = next(i for i, c in enumerate(children) if c is head or any(x is head for x in c.walk()))
    parts = Node("div", {}), Node("div", {})
    parts[0].children, parts[1].children = children[:at], children[at:]
    return block_text(parts[0]), block_text(parts[1])


def blocks(root: Node) -> list[dict]:
    """The blocks that may be the article, in the order in which ties are decided, with their features."""
    nodes = list(root.walk())
    first = lambda test: next((n for n in nodes if test(n)), None)
    found = [("tag:article", first(lambda n: n.tag == "article")), ("tag:main", first(lambda n: n.tag == "main")), ('attr:role="main"', first(lambda n: n.attrs.get("role") == "main"))]
    found += [(f"id:{i}", first(lambda n, i=i: n.attrs.get("id") == i)) for i in ("maincontent", "content", "main")]
    size_of = lengths(root)
    sized = [(size_of[id(n)], -k, n) for k, n in enumerate(nodes) if n.tag in ("div", "section")]
    if sized and (best := max(sized, key=lambda x: x[:2]))[0] > 0:
        found.append(("fallback:largest_block", best[2]))
    out, seen = [], set()
    for hint, node in found:
        if node is None or id(node) in seen:
            continue
        seen.add(id(node))
        bare = node.cleaned(lambda n: n.tag in STRIPPED)
        bare_size = lengths(bare)
        clean = bare.cleaned(lambda n, size=bare_size: is_furniture(n, size[id(n)]))
        inner, text, clean_size = list(clean.walk()), clean.text(), lengths(clean)
        body, refs = body_and_references(clean)
        out.append({
            "hint": hint, "chars": len(text), "paragraphs": sum(n.tag == "p" for n in inner), "headings": sum(n.tag in HEADINGS for n in inner),
            "link_chars": sum(clean_size[id(n)] for n in inner if n.tag == "a"), "lead": text[:20_000], "body": body or clean.text("\n"), "refs": refs,
        })
    return out


def head_meta(root: Node) -> tuple[dict[str, list[str]], str]:
    """Lower-case names with all their values, and the title element's text."""
    meta: dict[str, list[str]] = {}
    title = None
    for n in root.walk():
        if n.tag == "meta" and ("name" in n.attrs or "property" in n.attrs):
            key, value = (n.attrs.get("name") or n.attrs.get("property") or "").strip().lower(), n.attrs.get("content", "").strip()
            if key and value:
                meta.setdefault(key, []).append(value)
        elif n.tag == "title" and title is None:
            title = n.text("")
    return meta, title or ""


BLOCK = StructType([StructField("hint", StringType()), *[StructField(c, IntegerType()) for c in ("chars", "paragraphs", "headings", "link_chars")], *[StructField(c, StringType()) for c in ("lead", "body", "refs")]])
PAGE = StructType([
    StructField("title_tag", StringType()), StructField("meta", MapType(StringType(), ArrayType(StringType()))), StructField("document_text", StringType()),
    StructField("blocks", ArrayType(BLOCK)), StructField("error", StringType()),
])


def features(html: str | None, root: Node | None = None) -> dict:
    """A page's fields of PAGE; root: its tree, if it has been read before."""
    try:  # a page that can't be parsed becomes a row that says so
        root = root or tree(html or "")
        meta, title = head_meta(root)
        row = (title, list(meta.items()), root.text(), blocks(root), None)
    except (ValueError, AssertionError, RecursionError) as e:
        row = ("", [], "", [], f"{type(e).__name__}: {e}"[:500])
    return dict(zip(PAGE.names, row, strict=True))


def _page_features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return in_pieces(batches, features, to_arrow_type(PAGE))


def page_features(html: Column) -> Column:
    return F.arrow_udf(_page_features, PAGE)(html)


def visible_text(html: str | None) -> str:
    return tree(html or "").cleaned(lambda n: n.tag in ("script", "style", "noscript")).text()


def _visible_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return in_pieces(batches, visible_text, pa.string())


def page_text(html: Column) -> Column:
    """A page's text on one line, at most TEXT_CHARS characters."""
    return F.substring(collapse(F.arrow_udf(_visible_texts, StringType())(html)), 1, TEXT_CHARS)


def ended_entities(html: Column) -> Column:
    """A page in which only what ends in a semicolon is an entity; any other & stands for itself."""
    return F.regexp_replace(html, "&(?!#?[A-Za-z0-9]+;)", "&amp;")


def wall_reason(document_text: Column) -> Column:
    out = None
    for pattern, reason in WALLS:
        hit = document_text.rlike("(?i)" + pattern)
        out = F.when(hit, reason) if out is None else out.when(hit, reason)
    return out.otherwise("")


def block_score(b: Column) -> Column:
    # What counts in full at how many characters, paragraphs and headings, and the weights.
    share = lambda c, most: F.least(c.cast("double"), F.lit(float(most))) / most
    links = F.least(b["link_chars"] / F.greatest(b["chars"], F.lit(1)), F.lit(1.0))
    score = share(b["chars"], 6000) * 6.0 + share(b["paragraphs"], 60) * 4.0 + share(b["headings"], 30) * 2.0 - links * 5.0 + F.when(b["lead"].rlike(SECTION_WORDS), 1.5).otherwise(0.0)
    return F.when(b["chars"] <= 0, F.lit(-1e9)).otherwise(score)


def judged(read: DataFrame) -> DataFrame:
    """Rows with the fields of page_features, with the best block's text and what it is worth in place of the blocks."""
    scored = F.transform("blocks", lambda b, i: F.struct(block_score(b).alias("score"), (-i).alias("order"), b.alias("b")))
    best = read.withColumn("best", F.array_max(F.filter(scored, lambda x: x["score"] > -1e9))).withColumn("reason", wall_reason(F.col("document_text")))
    long = F.length("document_text")
    quality = F.when(long == 0, "suspicious").when((F.col("reason") != "") & (long < BLOCKED_CHARS), "blocked").when((F.col("reason") != "") | (long < SHORT_CHARS), "suspicious").otherwise("ok")
    # The steps of confidence.
    raw = F.least(F.lit(1.0), F.coalesce(F.col("best.score"), F.lit(0.0)) / 10) + F.when(F.col("best.b.chars") >= 2500, 0.25).otherwise(0.0) + F.when(F.col("best.b.paragraphs") >= 8, 0.25).otherwise(0.0)
    capped = F.when(quality == "blocked", F.least(raw, F.lit(0.2))).otherwise(raw)
    return best.withColumns({
        "selected_hint": F.coalesce("best.b.hint", F.lit("")), "score": F.col("best.score"), "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), capped)), "capture_quality": quality,
        "blocked_reason": F.when(long == 0, "unknown").otherwise(F.col("reason")), "article_text": strip(F.coalesce("best.b.body", F.lit(""))), "references_text": F.coalesce("best.b.refs", F.lit("")), "ok": F.col("best").isNotNull(),
    }).drop("blocks", "document_text", "best", "reason")


def parse_pages(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, title_tag, meta, error, selected_hint, score, confidence, capture_quality, blocked_reason, article_text, references_text, ok."""
    return judged(pages.select(F.col(id_col).alias("id"), page_features(F.col(html_col)).alias("p")).select("id", "p.*"))
