"""Main text of pages: by hand for each rule, and over the whole table against the standard library's parser."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from rootloom.llm import queries
from rootloom.llm.page_text import extract_pages, main_text

DATA = "/root/testdata/sf0.01"
LONG = "The man and the dog went to the house of his. " * 6


class Article(HTMLParser):
    """The text of the article element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.parts.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.parts.append(" ")

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def test_whole_table_against_another_parser(spark):
    html = {r["page_id"]: (r["url"], r["html"]) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = queries.QUERIES["op11_page_text"](spark, DATA).collect()
    assert len(rows) == len(html)
    for r in rows:
        url, page = html[r["page_id"]]
        parser = Article()
        parser.feed(page)
        parser.close()
        assert (r["url"], r["text"], r["n_chars"]) == (url, (want := " ".join("".join(parser.parts).split())), len(want)) and want


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>One.<p>Two &amp; &lt;three&gt; &#233;&nbsp;x</article>", "One. Two & <three> é x"),
        ("<article><script>var a='<p>no</p>';</script><style>p{}</style><p>a<!-- no --> b</p><noscript>no</noscript></article>", "a b"),
        ("<div class='cookie-notice'>We use cookies</div><main><h1>Title</h1><p>Text.</p></main><footer>end</footer>", "Title Text."),
        ("<article><header><h1>Title</h1><p>by A</p></header><p>Text.</p><section id='comments'><p>Great read.</p></section></article>", "Title Text."),
        ("<article><p>Text.</p><div class=\"adSlot\">Buy</div><p>More.</p><aside>Side</aside><form><label>Mail</label><input></form></article>", "Text. More."),
        ("<article><p>Text.</p><h2>Related</h2><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></article>", "Text."),
        ("<article><p>See <a href='x>y'>this long text</a> in the middle of the words.</p></article>", "See this long text in the middle of the words."),
        ("<form><nav><a href=x>Menu</a><article class='post comments-open'><p>Text.</p></article></form>", "Text."),
        ("<body class='has-sidebar'><article hidden>no</article><article>yes</article>", "yes"),
        ("<article><p><b>Bold.<br><p>Next.</p></article>", "Bold. Next."),
        ("<article><table><tr><td>a<td>b</table><pre>x\n  y</pre></article>", "a b x y"),
        # Without a marked article, by density and neighbours.
        (f"<p>Home</p><p>{LONG}</p><p>Short.</p><p>{LONG}</p><p>Contact</p>", f"{LONG}Short. {LONG.strip()}"),
        (f"<ul><li><a href=a>{LONG}</a></ul><h1>Head</h1><p>{LONG}</p>", f"Head {LONG.strip()}"),
        (f"<p>{LONG}</p><div>{'Zap bim lod kur, ' * 20}</div>", LONG.strip()),
        (f"<div>{'Жил был старый король в лесу, ' * 10}</div>", ("Жил был старый король в лесу, " * 10).strip()),
        ("", ""),
        ("<p class=\"a <b> x", ""),
        ("<!-- <article>x", ""),
        ("<article>&am &amp", "&am &"),
    ],
)
def test_rules(page, text):
    assert main_text(page) == text


def test_rows_of_every_kind(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article>x</article>"), (3, "u", "<article>y</article>"), (3, "u", "<article>y</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("other")).withColumn("n_chars", F.lit(7))
    got = sorted((str(r["page_id"]), str(r["url"]), r["text"], r["n_chars"]) for r in extract_pages(pages).collect())
    assert got == [("1", "u", "", 0), ("2", "None", "", 0), ("3", "u", "y", 1), ("3", "u", "y", 1), ("None", "u", "x", 1)]
    assert extract_pages(pages.limit(0)).collect() == []


def test_long_pages_take_linear_time():
    import time

    for piece in ('<p class="x', "<p>word ", "<script>", "<!--", "<a href='", "<div>", "<", "&amp"):
        start = time.time()
        main_text("<article>" + piece * 60_000)
        assert time.time() - start < 5, piece
