import json

import pyarrow as pa

from folioforge.functions import pieces
from folioforge.operators import ingest
from folioforge.sources import sites

#: A batch whose results are several times PIECE_CHARS; paragraphs that are not closed hold all that follow.
PAGES = [f"<article><h2>Part {i}</h2><p>{f'word{i} ' * 4000}<p>{'x ' * 50}</article>" for i in range(120)]


def in_parts(found):
    """The number of rows in each array, and all rows."""
    parts = [x.to_pylist() for x in found]
    return [len(x) for x in parts], [r for x in parts for r in x]


def test_articles_of_a_batch_are_handed_on_in_pieces():
    kinds = ["wiley", "sciencedirect", "generic", None] * 30
    sizes, rows = in_parts(sites._read_pages(iter([(pa.array(kinds), pa.array(PAGES)), (pa.array(["generic"]), pa.array([None], pa.string()))])))
    assert sum(sizes) == 121 and len(sizes) > 3
    largest = max(pieces.size(r) for r in rows)
    assert max(n * largest for n in sizes) < 2 * pieces.PIECE_CHARS + 2 * largest
    assert [r["p"]["title_tag"] for r in rows] == [""] * 121 and [r["s"]["found"] for r in rows] == [k in sites.SECTIONS for k in kinds] + [False]
    assert all(f"word{i} " in r["p"]["blocks"][0]["body"] and f"word{i + 1} " not in r["p"]["document_text"] for i, r in enumerate(rows[:120]))


def test_articles_stay_with_their_pages(spark):
    df = spark.createDataFrame([(i, "https://example.org", p) for i, p in enumerate(PAGES)], "id int, url string, html string").coalesce(1)
    rows = sites.parse_articles(df, "id", "url", "html").select("id", "article_text").collect()
    assert len(rows) == 120 and all(r.article_text.startswith(f"Part {r.id}\nword{r.id} ") for r in rows)


def test_payloads_of_a_batch_are_handed_on_in_pieces():
    sizes, rows = in_parts(ingest._read_payloads(iter([(pa.array(PAGES), pa.array(["<p>ﬁne　\n day<script>x</script> "] * 120))])))
    assert sum(sizes) == 120 and len(sizes) > 3
    assert {r["base_text"] for r in rows} == {"fine day"} and [r["normal"] for r in rows] == [[]] * 120
    assert [f"word{i} " in r["p"]["document_text"] for i, r in enumerate(rows)] == [True] * 120


def test_texts_that_nfkc_changes_are_indexed_in_it(spark):
    text = "<p>The ﬁrst ½ of études says enough about methods and results. </p>" * 60
    whole = [json.dumps({"source_url": "https://ex.org/a", "dom_html": f"<main> {text}</main>"}), json.dumps({"source_url": "https://ex.org/b", "extraction": {"content_html": "<b>ﬂat  Ａ</b>" + "x" * 500_000}})]
    raw = ingest.validated(spark.createDataFrame([(p, "2024-01-01", i) for i, p in enumerate(whole)], "value string, captured_at string, seq int"))
    a, b = ingest.parsed(raw).orderBy("seq").collect()
    line = "The first 1⁄2 of études says enough about methods and results."
    assert a.used_for_index and a.content_text == "\n".join([line] * 60) and a.article_text.startswith("The ﬁrst ½ of études")
    assert not b.used_for_index and b.content_text.startswith("flat A xxx") and len(b.content_text) == 400_001  # cut before NFKC makes two letters of one
