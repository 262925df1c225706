import pytest
from crawl_fixtures import HTML, responses

from wavecrawl.api import extract_links, extract_page_urls, extract_pages
from wavecrawl.operators.htmlpass import parse_page

# How a page states a URL of each kind.
TAGS = {
    "og:url": '<meta property="og:url" content="{}">',
    "twitter:url": '<meta property="twitter:url" content="{}">',
    "canonical": '<link href="{}" rel="canonical">',
    "alternate": '<link rel="alternate" hreflang="da" href="{}">',
    "jsonld": '<script type="application/ld+json">{{"name": "Hall 7", "url": "{}"}}</script>',
}
VALUES = ["//museum.test/halls/7", "//lender.test:8443/loans?id=9", "https://museum.test/halls/7", "/halls/7", "halls/7"]


@pytest.mark.parametrize("scheme", ["https", "http"])
def test_stated_urls(spark, scheme):
    """Every kind with every value: only values without a scheme but with a host change, to the page's scheme."""
    page = f"{scheme}://museum.test/visit"
    stated = [(kind, value) for kind in TAGS for value in VALUES]
    noise = '<meta property="og:image" content="//museum.test/i.png"><link rel="icon" href="//museum.test/f.ico"><meta property="og:url">'
    html = "<head>" + noise + "".join(TAGS[k].format(v) for k, v in stated) + "</head><body>Open daily.</body>"
    found = extract_page_urls(responses(spark, [(page, page, 200, HTML, html)])).orderBy("pos").collect()
    want = sorted((k, v, f"{scheme}:{v}" if v.startswith("//") else v) for k, v in stated)
    assert sorted((r.kind, r.value, r.fixed_value) for r in found) == want


def test_page_without_stated_urls(spark):
    page = "https://museum.test/visit"
    assert extract_page_urls(responses(spark, [(page, page, 200, HTML, "<p>Closed.</p>")])).count() == 0


def test_links_canonical_and_status(spark):
    html = ('<html><head><title> My  Page </title><link rel="canonical" href="  /guide/canon/ ">'
            '</head><body><a href="/a">a</a><a href=" ">blank</a><a href="/a#x">again</a>'
            '<a href="https://Other.com:443/b/">b</a><a href="http://[bad">bad</a>'
            '<article><p>one two three four five six seven eight nine ten</p></article></body></html>')
    url = "https://docs.example.com/guide/x"
    df = responses(spark, [(url, url, 200, HTML, html),
                           ("https://docs.example.com/e", "https://docs.example.com/e", 404, HTML, "nf"),
                           ("https://docs.example.com/f", "https://docs.example.com/f", 200, "application/pdf", "%")])
    links = [(r.pos, r.link_url) for r in extract_links(df).orderBy("pos").collect()]
    assert links == [(0, "https://docs.example.com/a"), (2, "https://other.com/b")]
    got = {r.url: r for r in extract_pages(df).collect()}
    page = got[url]
    assert (page.status, page.title, page.word_count) == ("success", "My Page", 10)
    assert page.canonical_url == "https://docs.example.com/guide/canon"
    assert (got["https://docs.example.com/e"].status, got["https://docs.example.com/e"].error) == (
        "error_http", "HTTP 404")
    assert got["https://docs.example.com/f"].error == "Expected HTML content, received: application/pdf"


def test_unclosed_markup_and_dropped_chrome():
    html = ('<html><head><script>var t="</p>";</script></head><body><nav><a href="/n">nav</a></nav>'
            '<div class="ad">buy now</div><article><h1>T</h1><p><b>Lead text.<br><p>Body &amp; more'
            '<ul><li>one<li>two</ul></article><footer>f</footer>')
    r = parse_page("https://e.com/x", html)
    assert r["content"] == "# T\n\n**Lead text.**\n\nBody & more\n\n- one\n- two"
    assert [link["href"] for link in r["links"]] == ["/n"]


def test_extraction_error_keeps_links(monkeypatch):
    from wavecrawl.operators import htmlpass as H

    def boom(self, node, out, list_depth=0):
        raise ValueError("bad tree")

    monkeypatch.setattr(H._Renderer, "blocks", boom)
    r = parse_page("https://e.com/x", '<html><body><a href="/a">a</a><p>text</p></body></html>')
    assert r["parse_error"] == "ValueError: bad tree" and r["content"] is None
    assert [link["href"] for link in r["links"]] == ["/a"]


def test_one_row_per_capture_and_bad_urls(spark):
    """Captures of one canonical URL stay apart; a URL that can't be parsed is an error row."""
    u, text = "https://museum.test/halls", "The seventh hall shows clocks, globes and maps from five centuries."
    got = extract_pages(responses(spark, [
        (u, u, 200, HTML, f"<title>Halls</title><main><p>{text}</p></main>"),
        (u + "#top", u, 200, HTML, f"<title>Halls, later</title><main><p>{text} Free entry.</p></main>"),
        (u, u, 503, HTML, "busy"), ("http://[bad", "http://[bad", 200, HTML, "<p>x</p>"),
        (u + "/map", u + "/map", None, None, None, "ETIMEDOUT")])).collect()
    seen = sorted(((r.url, r.title, r.status, r.http_status, r.error) for r in got), key=str)
    assert seen == sorted([
        (u, "Halls", "success", 200, None), (u, "Halls, later", "success", 200, None), (u, None, "error_http", 503, "HTTP 503"),
        ("http://[bad", None, "error_network", None, "invalid_url"), (u + "/map", None, "error_network", None, "ETIMEDOUT")], key=str)


def test_html_pass_holds_few_pages_at_a_time(spark):
    from pyspark.sql import functions as F

    from wavecrawl.operators.htmlpass import PASS_ROWS, html_pass

    n = 3 * PASS_ROWS + 1
    pages = spark.range(0, n, 1, 1).select("id", F.lit("https://a.example/").alias("u"), F.when(F.col("id") % 5 > 0, F.concat(
        F.lit("<p>t</p><a href='x"), "id", F.lit("'>x</a>"))).alias("html"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        rows = html_pass(pages, "html", "u", ["id"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    assert {r.id: [x.href for x in r.links] for r in rows} == {i: [f"x{i}"] if i % 5 else [] for i in range(n)}
