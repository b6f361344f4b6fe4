"""Bibliographic fields from page metadata as column expressions. Metadata is MAP<STRING, ARRAY<STRING>> with lower-case keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.strings import WS, collapse, dedupe, rstrip, strip, text

#: Metadata keys by field, in the order in which they are tried.
TITLE_KEYS = ("citation_title", "dc.title", "dcterms.title", "prism.title")
CONTAINER_KEYS = ("citation_journal_title", "prism.publicationname")
DATE_KEYS = ("citation_publication_date", "prism.publicationdate", "citation_date", "dc.date", "dcterms.issued")
DOI_KEYS = ("citation_doi", "prism.doi", "dc.identifier")
KEYWORD_KEYS = ("citation_keywords", "keywords")
AUTHOR_KEYS = ("citation_author", "citation_authors", "dc.creator", "dcterms.creator")
ABSTRACT_KEYS = ("citation_abstract", "dcterms.abstract", "dc.description")
ABSTRACT_CHARS, SNIPPET_CHARS = 20_000, 220
#: Fixed value: what a DOI looks like.
DOI = r"""10\.\d{4,9}/[^\s<>"']+"""


def value(meta: Column, key: str) -> Column:
    """A key's values as one text, joined by "; "."""
    return F.coalesce(F.array_join(F.filter(F.try_element_at(meta, F.lit(key)), lambda x: x != ""), "; "), F.lit(""))


def first_value(meta: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(strip(value(meta, k)), F.lit("")) for k in keys], F.lit(""))


def doi(raw: Column) -> Column:
    """The DOI in a text, lower case; empty if there is none. Punctuation inside stays."""
    s = strip(F.replace(strip(text(raw)), F.lit("\u200b"), F.lit("")))
    s = strip(F.regexp_replace(s, rf"(?i)^{WS}*https?://(?:dx\.)?doi\.org/", ""))
    s = strip(F.regexp_replace(s, rf"(?i)^{WS}*doi{WS}*:{WS}*", ""))
    s = F.regexp_replace(s, r"""^[.,;:)\]}"']+|[.,;:)\]}"']+\z""", "")
    return F.lower(F.regexp_extract(s, "(?U)" + DOI, 0))


def year(raw: Column) -> Column:
    """The first year from 1500 to 2199 in a text."""
    return F.nullif(F.regexp_extract(text(raw), r"\b(1[5-9]\d{2}|20\d{2}|21\d{2})\b", 1), F.lit("")).try_cast("int")


def keywords(raw: Column) -> Column:
    return dedupe(F.split(text(raw), r"[,\n;]+"))


def author_parts(raw: Column) -> Column:
    """One metadata value's authors: split at ; and line ends, else at " and "; never at commas."""
    s = strip(text(raw))
    return F.when(s.rlike(r"[;\n]"), F.split(s, r"[;\n]+")).otherwise(F.split(s, rf"(?i){WS}+and{WS}+"))


def authors(values: Column) -> Column:
    """All values' authors without repetitions, case aside."""
    return dedupe(F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")), author_parts)))


def best_doi(meta: Column) -> Column:
    return F.coalesce(*[F.nullif(doi(value(meta, k)), F.lit("")) for k in DOI_KEYS], F.lit(""))


def best_title(meta: Column, title_tag: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(first_value(meta, TITLE_KEYS), F.lit("")), F.nullif(strip(text(title_tag)), F.lit("")), F.nullif(text(url), F.lit("")), F.lit("Untitled"))


def best_container(meta: Column) -> Column:
    return first_value(meta, CONTAINER_KEYS)


def best_date(meta: Column) -> Column:
    return first_value(meta, DATE_KEYS)


def best_abstract(meta: Column) -> Column:
    return F.substring(collapse(first_value(meta, ABSTRACT_KEYS)), 1, ABSTRACT_CHARS)


def _first_list(lists: list[Column]) -> Column:
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast("array<string>"))


def best_keywords(meta: Column) -> Column:
    return _first_list([keywords(value(meta, k)) for k in KEYWORD_KEYS])


def best_authors(meta: Column) -> Column:
    return _first_list([authors(F.try_element_at(meta, F.lit(k))) for k in AUTHOR_KEYS])


def merged_meta(head: Column, client: Column) -> Column:
    """Both maps with stripped lower-case keys; the client's values win whole."""
    clean = lambda m: F.transform(F.filter(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,array<string>>"))), lambda e: strip(e["key"]) != ""), lambda e: F.struct(F.lower(strip(e["key"])).alias("key"), e["value"].alias("value")))
    last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda later: later["key"] == e["key"]))
    # An array of one binds the entries; without it each entry would compute them anew.
    return F.map_from_entries(F.transform(F.array(F.concat(clean(head), clean(client))), last)[0])


#: Keys of a person's record, in the order in which they are tried, and years that a registry's date may have.
FAMILY_KEYS, GIVEN_KEYS = ("family", "last", "last_name"), ("given", "first", "first_name")
REGISTRY_YEARS = (1500, 2200)


def person_name(record: Column) -> Column:
    """A display name from a name or a person's JSON record: given and family name, else the family name or the name."""
    of = lambda keys: strip(F.coalesce(*[F.nullif(F.get_json_object(record, f"$.{k}"), F.lit("")) for k in keys], F.lit("")))
    family, given, name = of(FAMILY_KEYS), of(GIVEN_KEYS), of(("name",))
    full = F.when((given != "") & (family != ""), F.concat(given, F.lit(" "), family)).when(family != "", family).otherwise(name)
    return F.when(strip(text(record)).startswith("{"), full).otherwise(strip(text(record)))


def registry_record(message: Column) -> Column:
    """title, container_title, published_date_raw, year, authors from a DOI registry's message (JSON)."""
    many = lambda path: F.get_json_object(message, f"$.{path}[0]")
    one = lambda path: F.get_json_object(message, f"$.{path}")
    title = lambda path: strip(F.coalesce(many(path), F.when(~one(path).startswith("["), one(path)), F.lit("")))
    part = lambda i: F.get_json_object(message, f"$.issued.date-parts[0][{i}]").try_cast("int")
    year = F.when(part(0).between(*REGISTRY_YEARS), part(0))
    month, day = F.when(part(1).between(1, 12), part(1)), F.when(part(2).between(1, 31), part(2))
    date = F.when(year.isNull(), "").when(month.isNull(), year.cast("string")).when(day.isNull(), F.format_string("%04d-%02d", year, month)).otherwise(F.format_string("%04d-%02d-%02d", year, month, day))
    people = F.from_json(one("author"), "array<string>")
    names = F.filter(F.transform(F.coalesce(people, F.array().cast("array<string>")), person_name), lambda x: x != "")
    return F.struct(title("title").alias("title"), title("container-title").alias("container_title"), date.alias("published_date_raw"), year.alias("year"), names.alias("authors"))


def iso(at: Column) -> Column:
    """A time in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def now_iso() -> Column:
    """The time of the query in UTC, to the second."""
    return iso(F.current_timestamp())


def lengths(**texts: Column) -> Column:
    """A struct of the lengths of some texts in characters, null as 0."""
    return F.struct(*[F.length(text(c)).alias(f"{name}_chars") for name, c in texts.items()])


def last_name(name: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(strip(name), rf"(?U){WS}+"), -1), "^,+|,+$", "")


def authors_short(names: Column) -> Column:
    """`Last`, `A & B` or `A et al.`"""
    named = F.filter(names, lambda x: strip(text(x)) != "")
    at = lambda i: last_name(F.try_element_at(named, F.lit(i)))
    return F.when(F.size(named) == 1, at(1)).when(F.size(named) == 2, F.concat(at(1), F.lit(" & "), at(2))).when(F.size(named) > 2, F.concat(at(1), F.lit(" et al."))).otherwise("")


def snippet(c: Column, chars: int = SNIPPET_CHARS) -> Column:
    s = strip(text(c))
    return F.when(F.length(s) <= chars, s).otherwise(F.concat(rstrip(F.substring(s, 1, chars - 1)), F.lit("…")))


#: Fields that a registry may fill.
REGISTRY_FIELDS = ("title", "container_title", "published_date_raw", "year", "authors")


def one_a_doi(registry: DataFrame) -> DataFrame:
    """A registry with one row a DOI (trimmed, lower case): with authors before without, then the one whose fields come first in order."""
    has_none = (F.coalesce(F.size("authors"), F.lit(0)) <= 0).alias("has_none")
    first = F.min(F.struct(has_none, *REGISTRY_FIELDS)).alias("row")
    named = registry.where(F.coalesce(strip(F.col("doi")), F.lit("")) != "").groupBy(F.lower(strip(F.col("doi"))).alias("doi"))
    return named.agg(first).select("doi", *[F.col(f"row.{c}").alias(c) for c in REGISTRY_FIELDS])


def filled(captures: DataFrame, registry: DataFrame) -> DataFrame:
    """Captures filled from a registry with one row a DOI, as with_registry() says. Where both tables are bucketed by DOI, nothing is shuffled."""
    r = registry.select(F.col("doi").alias("r_doi"), *[F.col(c).alias(f"r_{c}") for c in REGISTRY_FIELDS])
    joined = captures.join(r, captures["doi"] == F.col("r_doi"), "left")
    use = F.coalesce(F.size("r_authors") > 0, F.lit(False))
    fill = lambda blank, c: F.when(use & blank & (strip(text(F.col(f"r_{c}"))) != ""), strip(F.col(f"r_{c}"))).otherwise(captures[c]).alias(c)
    new = {
        "authors": F.when(use, F.col("r_authors")).otherwise(captures["authors"]).alias("authors"),
        "year": F.when(use & captures["year"].isNull(), F.col("r_year")).otherwise(captures["year"]).alias("year"),
        "container_title": fill(captures["container_title"] == "", "container_title"),
        "title": fill((captures["title"] == "") | (captures["title"] == captures["url"]), "title"),
        "published_date_raw": fill(captures["published_date_raw"] == "", "published_date_raw"),
    }
    return joined.select(*[new.get(c, captures[c]) for c in captures.columns], F.when(use, captures["authors"]).alias("local_authors"))


def with_registry(captures: DataFrame, registry: DataFrame) -> DataFrame:
    """Fill captures from a registry of DOIs (doi, title, container_title, published_date_raw, year, authors).

    Where the registry knows authors they replace the page's own, which are kept as local_authors, and blank year,
    container, title (also one that only repeats the URL) and date are filled; without authors nothing changes. Of several
    registry rows of a DOI one counts, see one_a_doi().
    """
    return filled(captures, one_a_doi(registry))
