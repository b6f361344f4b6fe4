"""Library search: substring and full-text prefix predicates, collection filter, count, recency pages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.strings import like_any_case

#: Page size limits and the number of terms that a query uses.
PAGE_SIZE, MOST_PAGE_SIZE, MOST_TERMS = 50, 500, 10
SEARCHED = ("title", "url", "doi")


def query_terms(q: str | None) -> list[str]:
    """The ASCII words of a query, lower case; the first ten count."""
    return re.findall(r"[a-z0-9]+", (q or "").lower())[:MOST_TERMS]


def whole_number(value) -> int | None:
    """A whole number from a request's text; None if it is none or beyond 32 bits."""
    found = re.fullmatch(r"[+-]?[0-9]{1,10}", str(value if value is not None else "").strip())
    return int(found[0]) if found and -(2**31) <= int(found[0]) < 2**31 else None


def params(args: dict) -> dict:
    """q, collection, number and size of a request: `collection`, else the older `col`; a page from 1; a size within its bounds."""
    return {
        "q": str(args.get("q") or "").strip(), "collection": max(0, whole_number(args.get("collection") or args.get("col")) or 0),
        "number": max(1, whole_number(args.get("page")) or 1), "size": page_size(whole_number(args.get("page_size"))),
    }


def page_size(size: int | None) -> int:
    return PAGE_SIZE if not size or size <= 0 else min(size, MOST_PAGE_SIZE)


def matching_ids(postings: DataFrame, terms: list[str]) -> DataFrame:
    """capture_id: captures in which every term starts some token. postings: capture_id, token.

    The prefixes reach the Parquet scan; each surviving posting folds into one bit a term before the shuffle.
    """
    hits = [F.col("token").startswith(t) for t in terms]
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(h, F.lit(1 << i)).otherwise(F.lit(0)) for i, h in enumerate(hits)])
    found = postings.where(reduce(lambda a, b: a | b, hits)).groupBy("capture_id").agg(F.bit_or(bits).alias("terms"))
    return found.where(F.col("terms") == (1 << len(terms)) - 1).select("capture_id")


def search(captures: DataFrame, q: str = "", texts: DataFrame | None = None, postings: DataFrame | None = None, items: DataFrame | None = None, collection: int = 0) -> DataFrame:
    """Captures whose title, URL or DOI holds q, or whose text does: by index where there is one and q has a term, else by substring."""
    found = captures
    if collection > 0:
        inside = items.where(F.col("collection_id") == collection).select(F.col("capture_id").alias("id"))
        found = found.join(inside, "id", "left_semi")
    if not q:
        return found
    terms = query_terms(q)
    if postings is not None and terms:
        by_text = matching_ids(postings, terms)
    elif texts is not None:
        by_text = texts.where(like_any_case(F.col("content_text"), q)).select("capture_id").distinct()
    else:
        by_text = None
    hit = reduce(lambda a, b: a | b, [like_any_case(F.col(c), q) for c in SEARCHED])
    if by_text is None:
        return found.where(hit)
    marked = found.join(by_text.select(F.col("capture_id").alias("id"), F.lit(True).alias("in_text")), "id", "left")
    return marked.where(hit | F.col("in_text")).drop("in_text")


def page(found: DataFrame, number: int = 1, size: int | None = None) -> DataFrame:
    """One page, the latest first, ties by id."""
    size = page_size(size)
    return found.orderBy(F.desc("updated_at"), "id").offset((max(1, number) - 1) * size).limit(size)


def page_and_more(found: DataFrame, number: int = 1, size: int | None = None) -> DataFrame:
    """A page with `has_more`: whether the next one has rows. One row more than the page is read, no count."""
    size = page_size(size)
    order = Window.partitionBy().orderBy(F.desc("updated_at"), "id")
    rows = found.orderBy(F.desc("updated_at"), "id").offset((max(1, number) - 1) * size).limit(size + 1)  # at most MOST_PAGE_SIZE + 1 rows
    numbered = rows.withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > size).withColumn("n", F.row_number().over(order))
    return numbered.where(F.col("n") <= size).drop("n")


def count_of(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("total"))


def with_known_ids(captures: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (pos, id) that exist, in their order and as often as given."""
    return ids.join(captures.select("id"), "id", "left_semi").orderBy("pos")
