"""Main text: densities against a recursive model, page shapes, odd pages, the given pages."""

import html as H
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavecrawl.llm import html_text as X

PAR = "Some words of a real paragraph that goes on for a while, as paragraphs in articles do."


def page(inner, head="<title>t</title>"):
    return f"<!doctype html><html><head>{head}</head><body>{inner}</body></html>"


@pytest.mark.parametrize("inner", [
    "<article><h1>Head</h1><p>{0}<p>{0} &amp; more</article>",
    "<div class='top-nav'><a href=x>one</a></div><div id=c><h1>Head</h1><p>{0}</p><p>{0} &#38; more</p></div><div class=sidebar><p>{0}</p></div>",
    "<header><h1>Site</h1></header><main><h1>Head</h1><div><p>{0}</p><p>{0} & more</p></div></main><aside>{0}</aside><footer>{0}</footer>",
    "<div class='layout has-sidebar'><article><header><h1>Head</h1></header><section><p>{0}</p>\n<p>{0}\n&amp;\tmore</p></section>"
    "<section class=comments><p>{0}</p><p>{0}</p><p>{0}</p></section></article></div>",
    "<form><input name=q><p>{0}</p></form><article><h1>Head</h1><script>var a='<p>x</p>';</script><p>{0}<!-- {0} --></p><style>p{{}}</style>"
    "<p><b>{0} <i>&amp;</i> more</b></article><div id='comments'><article class=comment><p>{0}</p><p>{0}</p></article></div>",
    "<div class=cookie-notice><p>{0}</p></div><div><div><h1>Head</h1><p>{0}</p><p>{0} &amp; more</p></div></div>"
    "<ul><li><a href=a>{0}</a><li><a href=b>{0}</a></ul><div class='ad'>{0}</div>",
])
def test_shapes(inner):
    assert X.main_text(page(inner.format(PAR))) == f"Head\n{PAR}\n{PAR} & more"


@pytest.mark.parametrize("words", ["has-sidebar", "entry no-comments", "elementor-widget"])
def test_class_words_keep_the_article(words):
    inner = f"<div>Site name</div><div id=content class='{words}'>" + f"<p>{PAR}</p>" * 5 + f"</div><div class=comments><p>{PAR}</p></div>"
    assert X.main_text(page(inner)) == "\n".join([PAR] * 5)


def recursive(parent, tag, kept, chars, tags, body):
    """The formula, node by node, from the definition."""
    n = len(parent)
    kids = [[j for j in range(1, n) if parent[j] == i and kept[j]] for i in range(n)]

    def counts(i, link):
        link = link or tag[i] == "a"
        c, t = chars[i], tags[i]
        lc, lt = (c, t) if link else (0, 0)
        for j in kids[i]:
            cj, tj, lcj, ltj = counts(j, link)
            c, t, lc, lt = c + cj, t + tj + 1, lc + lcj, lt + ltj + (1 if link or tag[j] == "a" else 0)
        return c, t, lc, lt

    def up(i):
        while i > 0:
            i = parent[i]
            if tag[i] == "a":
                return True
        return False

    cb, _, lcb, _ = counts(body, up(body))
    out = []
    for i in range(n):
        c, t, lc, lt = counts(i, up(i))
        if not kept[i] or not c:
            out.append(0.0)
            continue
        base = math.log(c / max(c - lc, 1) * max(lc, 1) + max(lcb, 1) / max(cb, 1) * c + math.e)
        out.append(c / max(t, 1) * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1), base))
    return out, [sum(out[j] for j in kids[i]) if kids[i] else out[i] for i in range(n)]


@given(st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["div", "a", "p"]), st.integers(0, 60), st.integers(0, 2)), min_size=2, max_size=14))
@settings(max_examples=200, deadline=None)
def test_densities(nodes):
    parent = [-1] + [p % i for i, (p, *_) in enumerate(nodes[1:], 1)]
    tag, chars, tags = (list(x) for x in zip(*((t, c, k) for _, t, c, k in nodes)))
    tag[0] = "body"
    kept = [True] * len(nodes)
    for got, want in zip(X.densities(parent, tag, kept, chars, tags, 0), recursive(parent, tag, kept, chars, tags, 0)):
        assert got == pytest.approx(want)


def test_odd_pages():
    assert X.main_text("") == "" and X.main_text("   ") == ""
    assert X.main_text("just text") == "just text"
    assert X.main_text("<nav><a href=x>menu</a></nav>") == ""
    assert X.main_text("<p>a<p>b<br>c&nbsp;d") == "a\nb c d"
    deep = "<div>" * 20_000 + PAR
    assert X.main_text(deep) == PAR
    assert X.main_text("<span>" * 3_000 + PAR + "</b></p></div>") == PAR
    assert X.main_text(page("<article>" + f"<p>{PAR}</p>" * 20_000 + "</article>")).count("\n") == 19_999
    assert X.main_text(page("<article><p>x</p></article>")) == "x"


def test_rows(spark):
    rows = [(1, None, "u", 1), (2, "", "u", 2), (3, page(f"<article><p>{PAR}</article>"), None, 3), (3, page(f"<article><p>{PAR}</article>"), None, 3)]
    df = spark.createDataFrame(rows, "page_id long, html string, url string, text int")
    got = sorted((r.page_id, r.text) for r in X.extract_text(df).collect())
    assert got == [(1, ""), (2, ""), (3, PAR), (3, PAR)]
    assert X.extract_text(df.limit(0)).count() == 0


def by_pattern(page_html):
    """For the given tables only: one article of h1 and p."""
    inner = re.search(r"<article>(.*?)</article>", page_html, re.S)[1]
    blocks = (" ".join(H.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:h1|p)>", inner))
    return "\n".join(b for b in blocks if b)


def test_query(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = X.query(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == by_pattern(pages[r.page_id]) and r.n_chars == len(r.text)
