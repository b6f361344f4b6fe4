"""Column functions on hand-picked input, and what must hold for any."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioforge.functions import metadata, strings, text, urls
from folioforge.operators import ingest
from folioforge.sources import exports


def apply(spark, values, *columns):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
    return [r[1] if len(columns) == 1 else tuple(r[1:]) for r in rows]


def test_canonical_urls(spark):
    cases = {
        "": "", "  ": "", None: "",
        "HTTP://Ex.org:80": "http://ex.org/", "https://ex.org:443/A?b=1#f": "https://ex.org/A?b=1", "https://ex.org:80/": "https://ex.org:80/", "http://e.org:8080/x": "http://e.org:8080/x",
        "//ex.org/x": "https://ex.org/x", "http://e.org/a;p=1?q=2": "http://e.org/a;p=1?q=2", "ftp://E.org:21/x?a=1&a=0": "ftp://e.org:21/x?a=0&a=1",
        "https://e.org/?b=2&a=1&A=0": "https://e.org/?A=0&a=1&b=2", "https://e.org/?utm_source=x&REF=y&Gclid=1": "https://e.org/", "https://e.org/?c=&d&=e&z=1": "https://e.org/?z=1",
        "https://e.org/?f=%20g+h&k~=*": "https://e.org/?f=+g+h&k~=%2A", "https://e.org/?z=é": "https://e.org/?z=%C3%A9", "https://e.org/?a=1&a=1": "https://e.org/?a=1&a=1",
    }
    assert apply(spark, list(cases), urls.canonical_url(F.col("v"))) == list(cases.values())


def test_canonical_urls_stay_as_they_are(spark):
    rng = random.Random(5)
    parts = ["b=2", "a=1", "A=0", "utm_source=x", "REF=y", "c=", "d", "f=%20g+h", "k~=*", "z=é", ""]
    given = ["https://" + rng.choice(["a.org", "B.Org:80", "c.org:443"]) + rng.choice(["/", "/X/y"]) + "?" + "&".join(rng.choices(parts, k=rng.randint(0, 5))) + rng.choice(["", "#z?q=1"]) for _ in range(200)]
    once = apply(spark, given, urls.canonical_url(F.col("v")))
    assert apply(spark, once, urls.canonical_url(F.col("v"))) == once
    shuffled = [u.split("#")[0].split("?")[0] + "?" + "&".join(sorted(u.split("#")[0].split("?")[1].split("&"), reverse=True)) for u in given]
    same = apply(spark, shuffled, urls.canonical_url(F.col("v")))
    assert sum(x == y for x, y in zip(once, same)) == len(once)


@pytest.mark.parametrize("url,kind", [("https://pmc.ncbi.nlm.nih.gov/articles/1", "pmc"), ("https://www.ncbi.nlm.nih.gov/pmc/x", "pmc"), ("https://academic.oup.com/x", "oup"), ("https://onlinelibrary-wiley-com.proxy.edu/x", "wiley"), ("https://www.sciencedirect.com/a", "sciencedirect"), ("https://example.org/oup.com", "generic")])
def test_sites(spark, url, kind):
    assert apply(spark, [url], urls.site_kind(F.col("v"))) == [kind]


def test_standard_text(spark):
    cases = {
        "": "", "inter-\nnational": "international", "a-\nb": "a-\nb", "ab-\ncd-\nef": "abcdef", "ab-\nc-\nd-\ne f-\ng": "abcde f-\ng", "ab-\n \t\ncd": "abcd", "ab-\n\n\ncd": "abcd", "ab-\n1": "ab-\n1",
        "ﬁne\xa0x": "fine x", "a\u200bb\xadc": "abc", "a \t\r\nb\rc": "a\nb\nc", "a\x0b\x0c b": "a b", "a\n\n\n\nb": "a\n\nb", " \x1c a \u3000": "a",
        "Share\nx": "x", "sign in now\nx": "x", "Download  PDF\nx": "x", "sharing\nx": "sharing\nx", "share " + "y" * 90: "share " + "y" * 90, "a\n  SHARE this  \nb": "a\nb",
    }
    assert apply(spark, list(cases), text.standard_text(F.col("v"))) == list(cases.values())


def test_standard_text_stays_as_it_is(spark):
    rng = random.Random(6)
    parts = ["ab-\n", "cd-\n\n", "e", "word", " ", "  \t", "\n", "\r\n", "\r", "\xa0", "\u200b", "\xad", "ﬁ", "x y", "\x0b", "\x0c", "\u2003", "é", "x" * 90]
    given = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(400)]
    once = apply(spark, given, text.standard_text(F.col("v")))
    assert apply(spark, once, text.standard_text(F.col("v"))) == once


def test_wrapped_words_are_joined_to_the_end(spark):
    rng = random.Random(7)
    given = ["".join(rng.choices(["a", "bc", "-\n", "-\n", "-\n \n", " ", "1"], k=rng.randint(1, 20))) for _ in range(1500)]
    broken = re.compile(r"[A-Za-z]{2}-\n(?:[ \t]*\n)?[A-Za-z]")
    once = apply(spark, given, text.joined_words(F.col("v")))
    assert not any(broken.search(x) for x in once)  # nothing is left to join
    letters = lambda x: re.sub(r"[-\n ]", "", x)
    assert [letters(x) for x in once] == [letters(x) for x in given]
    alone = [g for g, x in zip(given, once) if not broken.search(g)]
    assert apply(spark, alone, text.joined_words(F.col("v"))) == alone  # and where nothing is to join, nothing changes


def test_joining_takes_time_in_proportion(spark):
    long = spark.createDataFrame([("word-\n" * 30_000 + "end",)], "v string")
    assert long.select(F.length(text.joined_words(F.col("v")))).first()[0] == 4 * 30_000 + 3


def test_headings(spark):
    given = ["Introduction", "1. Introduction", "3.2 Methods", "2) Results & Discussion", "Keywords: a, b", "Aims:", "Methods:", "This is how it goes", "A sentence.", "ab", "éa étude", "1999 was", "word " * 17, "However much", "Acknowledgment", "", None]
    kinds, heads = zip(*apply(spark, given, text.heading_kind(F.col("v")), text.is_heading(F.col("v"))))
    assert kinds == ("introduction", "introduction", "other", "results_discussion", "keywords", "other", "other", "other", "other", "other", "other", "other", "other", "other", "acknowledgements", "other", "other")
    assert heads == (True, True, False, False, True, False, True, False, False, False, True, False, False, False, True, False, False)


def test_metadata(spark):
    given = ["https://doi.org/10.1234/AbC.", "doi: 10.5555/x;", "10.1/a", "see (10.9999/q)", None, "10.1000/a; 10.1000/b"]
    assert apply(spark, given, metadata.doi(F.col("v"))) == ["10.1234/abc", "10.5555/x", "", "10.9999/q", "", "10.1000/a;"]
    assert apply(spark, ["12 May 2020", "1499", "20201", "2150 or 1800", None], metadata.year(F.col("v"))) == [2020, None, None, 2150, None]
    assert apply(spark, ["a, B;b\nC,, a", ""], metadata.keywords(F.col("v"))) == [["a", "B", "C"], []]
    m = spark.createDataFrame([({"citation_author": ["Lee, Ann; Bo Roe", "bo roe"], "citation_title": [" T "], "dc.date": ["2001-02"], "citation_doi": ["none"], "dc.identifier": ["10.1234/Z"]}, {" DC.Date ": ["1999"], "": ["x"]})], "head map<string,array<string>>, client map<string,array<string>>")
    h = metadata.merged_meta(F.col("head"), F.col("client"))
    r = m.select(metadata.best_authors(h).alias("a"), metadata.best_title(h, F.lit("tag"), F.lit("u")).alias("t"), metadata.best_date(h).alias("d"), metadata.best_doi(h).alias("doi"), metadata.best_abstract(h).alias("abs"), metadata.best_keywords(h).alias("k")).first()
    assert (r.a, r.t, r.d, r.doi, r.abs, r.k) == (["Lee, Ann", "Bo Roe"], "T", "1999", "10.1234/z", "", [])
    names = spark.createDataFrame([(["Ann Lee"],), (["Ann Lee", "Roe,"],), (["A B", "C D", "E F"],), ([],)], "n array<string>")
    assert [x[0] for x in names.select(metadata.authors_short(F.col("n"))).collect()] == ["Lee", "Lee & Roe", "B et al.", ""]
    assert apply(spark, ["x" * 220, "y" * 218 + "  z"], metadata.snippet(F.col("v"))) == ["x" * 220, "y" * 218 + "…"]


def test_like_is_ascii_and_live(spark):
    given = ["50% off", "5Äb", "a_b", "A\\B", "axb"]
    for q, want in (("0%", [1, 0, 0, 0, 0]), ("5ä", [0, 0, 0, 0, 0]), ("A_B", [0, 0, 1, 1, 1]), ("a\\b", [0, 0, 0, 1, 0])):
        assert apply(spark, given, strings.like_any_case(F.col("v"), q).cast("int")) == want


def test_file_names_of_rows_are_those_of_values(spark):
    values = ["A  b/C", "", None, " --x-- ", "é Ünder", "a" * 79 + "/b", "x_1.md", " Deep ", "***"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select("v", exports.slug_of(F.col("v")).alias("slug"), exports.capture_file_name("bib", "paper", F.col("v"), F.col("v")).alias("name"), exports.capture_file_name("bib", "paper", F.col("v")).alias("plain")).collect()
    assert [r["slug"] for r in got] == [exports.slug(v) for v in values]
    assert [r["name"] for r in got] == [exports.file_name("bib", "paper", capture_id=v or " ", suffix=(v or "").strip()) for v in values]
    assert [r["plain"] for r in got] == [exports.file_name("bib", "paper", capture_id=v or " ") for v in values]


def test_index_choice_takes_the_parsed_text_only_where_it_is_sure(spark):
    rows = [("t", "ok", 0.45), ("t", "suspicious", 1.0), ("t", "ok", 0.449), ("t", "blocked", 1.0), ("", "ok", 1.0)]
    use, chosen = ingest.index_choice(F.col("t"), F.col("q"), F.col("c"), F.lit("base"))
    got = spark.createDataFrame(rows, "t string, q string, c double").select(use.alias("use"), chosen.alias("chosen")).collect()
    assert [tuple(r) for r in got] == [(True, "t"), (True, "t"), (False, "base"), (False, "base"), (False, "base")]
