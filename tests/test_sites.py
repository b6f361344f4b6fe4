
import time

from folioforge.sources import html, sites

LONG = "text that goes on for long enough to count as a paragraph of an article " * 3
PAGES = [
    ("oup", "https://academic.oup.com/a", f'<div id="ContentTab"><div class="widget-ArticleFulltext"><div class="widget-items"><h2 class="abstract-title">ABSTRACT</h2><section class="abstract"><p>An abstract.</p><p>An abstract.</p></section><div class="kwd-group">kw</div><h2 class="section-title">1. Introduction</h2><p>Loose.</p><div><p>Open in new tab</p><p>Said.</p></div><h2 class="backreferences-title">References</h2><div>no</div></div></div></div><div class="ref-list"><div class="js-splitview-ref-item">{LONG} 10.1234/AbC</div></div>'),
    ("wiley", "https://onlinelibrary.wiley.com/a", '<article><section class="article-section__abstract"><h2>Abstract</h2><p>Short.</p></section><section class="article-section__content"><h2>Methods</h2></section><section class="article-section__content"><p>Done so.</p><ul><li>an item</li></ul></section><section class="article-section__content"><h2>Results</h2><p>Found.</p></section><section class="article-section__references"><ul><li data-bib-id="b1">A ref <span class="hidden data-doi">10.5/X</span></li></ul></section></article>'),
    ("pmc", "https://pmc.ncbi.nlm.nih.gov/articles/PMC1", '<section aria-label="Article content"><section class="body main-article-body"><section class="abstract"><h2>Abstract</h2><p>A.</p></section><p>Loose one.</p><section id="s1"><h2 class="pmc_sec_title">2. Methods</h2><p>M.</p><section id="s1a"><h3>Data</h3><p>D.</p></section></section><section class="kwd-group"><p>k1, k2</p></section></section><section class="ref-list"><h2>References</h2><ol><li><span class="label">1.</span><cite>Someone said</cite> <a href="https://doi.org/10.1234/q">x</a><a href="https://pubmed.ncbi.nlm.nih.gov/7">y</a></li></ol></section></section>'),
    ("sciencedirect", "https://www.sciencedirect.com/a", f'<article><div id="abstracts"><p>{LONG}</p></div><div id="body"><section><h2>1. Introduction</h2><div class="u-margin-s-bottom">First.</div><h3>1.1. Detail</h3><p>Second.</p><div class="tables"><span class="captions">Table 1 . Cap</span><table><tr><td>9</td></tr></table></div></section></div><section class="bibliography"><ol class="references"><li>{LONG} 10.1234/z</li><li>short</li></ol></section></article>'),
    ("generic", "https://www.sciencedirect.com/none", "<main><h1>T</h1><p>Only this.</p></main>"),
    ("generic", "https://example.org", None),
]


def test_layouts(spark):
    df = spark.createDataFrame([(i, u, h) for i, (_, u, h) in enumerate(PAGES)], "id int, url string, html string")
    rows = sites.parse_articles(df, "id", "url", "html").orderBy("id").collect()
    assert [r.parser for r in rows] == [p for p, _, _ in PAGES]
    told = [[(s.id, s.title, s.kind, s.number, s.parent_id, s.text) for s in r.sections or ()] for r in rows]
    assert told[0] == [("s01", "Abstract", "abstract", None, None, "An abstract."), ("s02", "Introduction", "introduction", "1", None, "Loose.\nSaid.")]
    assert told[1] == [("s01", "Abstract", "abstract", None, None, "Short."), ("s02", "Methods", "methods", None, None, "Done so.\nan item"), ("s03", "Results", "results", None, None, "Found.")]
    assert told[2] == [("s01", "Abstract", "abstract", None, None, "A."), ("s02", "Body", "other", None, None, "Loose one."), ("s03", "Methods", "methods", "2", None, "M.\nD."), ("s04", "Keywords", "keywords", None, None, "k1, k2"), ("s05", "Data", "other", None, "s04", "D.")]
    assert [t[1:4] for t in told[3]] == [("Abstract", "abstract", None), ("Introduction", "introduction", "1"), ("Detail", "other", "1.1")] and told[3][2][5] == "Second.\nTable 1. Cap"
    assert [[(x.n, x.doi, x.pubmed) for x in r.references or ()] for r in rows] == [[("", "10.1234/abc", "")], [("", "10.5/x", "")], [("1", "10.1234/q", "https://pubmed.ncbi.nlm.nih.gov/7")], [("", "10.1234/z", "")], [], []]
    assert rows[2].references_text == "References\n1. Someone said [DOI:10.1234/q · PubMed:https://pubmed.ncbi.nlm.nih.gov/7]"
    assert rows[0].confidence == 0.6 and rows[2].confidence == 0.65 and rows[4].article_text == "T\nOnly this." and rows[5].article_text == ""


def test_lengths_are_those_of_the_texts(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()] + [h for _, _, h in PAGES if h] + ["<p>a<script>b</script><template> c </template><p> \n d<b></b>"]
    for page in pages:
        root = html.tree(page)
        size = html.lengths(root)
        assert all(size[id(n)] == len(n.text()) for n in (root, *root.walk()))


def test_deep_pages_take_time_in_proportion():
    def seconds(depth):
        root = html.tree('<div id="nav">' * depth + "x" * 500 + "</div>" * depth)
        began = time.perf_counter()
        html.blocks(root)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(6000) < 12 * seconds(1500) + 0.2
