"""URL canonicalisation, hashing and site classification as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.strings import strip, text

#: Query parameters that only track, in lower case.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_reader", "utm_name", "utm_cid",
    "gclid", "dclid", "fbclid", "msclkid", "ref", "ref_src", "ref_url",
)

#: Host and path fragments of publishers' sites, in the order in which they are tried.
PMC_HOST_END, PMC_HOST, PMC_PATH, PMC_ARTICLES = "pmc.ncbi.nlm.nih.gov", "ncbi.nlm.nih.gov", "/pmc/", "/articles/pmc"
SITE_HOSTS = {
    "oup": ("oup.com", "academic-oup-com", "journals-oup-com"),
    "wiley": ("onlinelibrary.wiley.com", "onlinelibrary-wiley-com", "wiley.com"),
    "sciencedirect": ("sciencedirect.com", "sciencedirect-com", "elsevier.com", "elsevier-com"),
}

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical_query(query: Column) -> Column:
    """Pairs with a value, without tracking keys, sorted by key (case aside) and value, encoded anew."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p.rlike("(?s)^[^=]*=.")),
        lambda p, i: F.struct(strip(_decoded(F.substring_index(p, "=", 1))).alias("k"), _decoded(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v"), i.alias("i")),
    )
    kept = F.filter(pairs, lambda p: (p["k"] != "") & ~F.lower(p["k"]).isin(*TRACKING))
    ordered = F.array_sort(F.transform(kept, lambda p: F.struct(F.lower(p["k"]).alias("fold"), p["v"].alias("v"), p["i"].alias("i"), p["k"].alias("k"))))
    return F.array_join(F.transform(ordered, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def canonical_url(url: Column) -> Column:
    """Lower-case scheme (https if none) and host, no default port, no tracking parameters, sorted query, no fragment."""
    s = F.translate(strip(text(url)), "\t\r\n", "")
    part = lambda i: F.regexp_extract(s, _PARTS, i)
    scheme = F.lower(F.coalesce(F.nullif(part(1), F.lit("")), F.lit("https")))
    host = F.lower(part(2))
    host = F.when(scheme == "http", F.regexp_replace(host, r":80\z", "")).when(scheme == "https", F.regexp_replace(host, r":443\z", "")).otherwise(host)
    path = F.coalesce(F.nullif(part(3), F.lit("")), F.lit("/"))
    query = canonical_query(part(4))
    slashes = F.when((host != "") | path.startswith("/"), F.concat(F.lit("//"), host)).otherwise(F.lit(""))
    return F.when(s == "", F.lit("")).otherwise(F.concat(scheme, F.lit(":"), slashes, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def url_hash(canonical: Column) -> Column:
    return F.sha2(text(canonical), 256)


def site_kind(url: Column) -> Column:
    """Which publisher's page layout a URL's page follows; `generic` if none is known."""
    host, path = F.lower(F.regexp_extract(text(url), _PARTS, 2)), F.lower(F.regexp_extract(text(url), _PARTS, 3))
    out = F.when(host.endswith(PMC_HOST_END) | (host.contains(PMC_HOST) & path.contains(PMC_PATH)) | path.contains(PMC_ARTICLES), "pmc")
    for kind, fragments in SITE_HOSTS.items():
        hit = F.lit(False)
        for f in fragments:
            hit = hit | host.contains(f)
        out = out.when(hit, kind)
    return out.otherwise("generic")
