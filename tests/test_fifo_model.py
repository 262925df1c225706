"""Wave crawl == single-worker FIFO queue, on random sites (many crawls in one job)."""

import random
from collections import deque

from crawl_fixtures import HTML, responses

from wavecrawl.plans.crawl import crawl
from wavecrawl.sources.crawls import crawl_row, crawls_frame

N_SITES = 6
N_PAGES = 18
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def make_site(rng, host):
    """pages: url -> (final_url, status, ctype, hrefs, n_words); missing pages have no entry."""
    base = f"https://{host}/guide/"
    site = {}
    for i in range(N_PAGES):
        url = f"{base}p{i}"
        r = rng.random()
        if r < 0.08:
            continue  # not captured -> network error
        final = url
        if rng.random() < 0.15:
            final = f"{base}p{rng.randrange(N_PAGES)}"  # redirect (may collide)
        status = 404 if rng.random() < 0.08 else 200
        ctype = "application/pdf" if rng.random() < 0.08 else HTML
        hrefs = []
        for _ in range(rng.randrange(0, 6)):
            k = rng.random()
            if k < 0.6:
                hrefs.append(f"p{rng.randrange(N_PAGES)}")
            elif k < 0.75:
                hrefs.append(f"/guide/p{rng.randrange(N_PAGES)}#frag")
            elif k < 0.85:
                hrefs.append("/blog/post")
            elif k < 0.92:
                hrefs.append("/guide/search")
            else:
                hrefs.append("mailto:x@example.com")
        n_words = rng.choice([3, 12, 15])
        site[url] = (final, status, ctype, hrefs, n_words)
    return site


def resolve(href, page_final):
    """Enough URL resolution for the hrefs generated above."""
    if href.startswith("mailto:"):
        return href
    href = href.split("#", 1)[0]
    origin = page_final.split("/guide/")[0]
    if href.startswith("/"):
        return origin + href
    return page_final.rsplit("/", 1)[0] + "/" + href


def allowed(url, host):
    if url.startswith("mailto:"):
        return False
    if not url.startswith(f"https://{host}/guide/"):
        return False
    return "/search" not in url


def model(site, host, seed, depth_limit, max_pages):
    queue = deque([(seed, 0)])
    queued, visited, finals, out = {seed}, set(), set(), []
    while queue and len(out) < max_pages:
        url, depth = queue.popleft()
        queued.discard(url)
        visited.add(url)
        page = site.get(url)
        if page is None:
            out.append((url, depth, "error_network", url))
            continue
        final, status, ctype, hrefs, n_words = page
        if final in finals:
            out.append((url, depth, "skipped_filtered", final))
            continue
        finals.add(final)
        if status >= 400:
            out.append((url, depth, "error_http", final))
            continue
        if ctype != HTML:
            out.append((url, depth, "skipped_filtered", final))
            continue
        if depth_limit is None or depth + 1 <= depth_limit:
            seen_here = []  # links of the captured page, resolved against its final URL
            for h in page[3]:
                u = resolve(h, final)
                if u not in seen_here:
                    seen_here.append(u)
            for u in seen_here:
                if allowed(u, host) and u not in visited and u not in queued:
                    queue.append((u, depth + 1))
                    queued.add(u)
        out.append((url, depth, "success" if n_words >= 10 else "skipped_empty", final))
    return out


def html_of(hrefs, n_words, i):
    words = " ".join(WORDS[(i + j) % len(WORDS)] for j in range(n_words))
    links = "".join(f'<a href="{h}">l</a>' for h in hrefs)
    return f"<html><body><nav>{links}</nav><main><p>{words}</p></main></body></html>"


def test_waves_equal_fifo_queue(spark):
    rng = random.Random(7)
    rows, crawls, expected = [], [], {}
    cid = 0
    for s in range(N_SITES):
        host = f"g{s}.example.com"
        site = make_site(rng, host)
        for i, (url, (final, status, ctype, hrefs, n_words)) in enumerate(sorted(site.items())):
            # the captured body is the page reached at the request URL; links resolve against final_url
            rows.append((url, final, status, ctype, html_of(hrefs, n_words, i)))
        for depth_limit, max_pages in [(None, 1000), (2, 1000), (None, 5)]:
            cid += 1
            seed = f"https://{host}/guide/p{rng.randrange(N_PAGES)}"
            crawls.append(crawl_row(cid, seed, depth=depth_limit, max_pages=max_pages, sitemap=False))
            expected[cid] = model(site, host, seed, depth_limit, max_pages)
    # Links sit in <nav>: discovered, but not part of the extracted content (word count = n_words).
    out = crawl(crawls_frame(spark, crawls), responses(spark, rows))
    got = {}
    for r in out.page_results.orderBy("crawl_id", "seq").collect():
        got.setdefault(r.crawl_id, []).append((r.url, r.depth, r.status, r.final_url))
    for k, exp in expected.items():
        assert got.get(k, []) == exp, (k, got.get(k), exp)
    seqs = {}
    for r in out.page_results.select("crawl_id", "seq").collect():
        seqs.setdefault(r.crawl_id, []).append(r.seq)
    for k, v in seqs.items():
        assert sorted(v) == list(range(len(v)))  # dense FIFO numbering


def test_result_independent_of_partition_count(spark):
    rng = random.Random(11)
    host = "h.example.com"
    site = make_site(rng, host)
    rows = [(u, f, s, c, html_of(h, n, i)) for i, (u, (f, s, c, h, n)) in enumerate(sorted(site.items()))]
    crawls = [crawl_row(1, f"https://{host}/guide/p0", max_pages=1000, sitemap=False)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    outs = []
    try:
        for n in ("3", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out = crawl(crawls_frame(spark, crawls), responses(spark, rows))
            outs.append(sorted(tuple(r) for r in out.page_results.select("seq", "url", "depth", "status",
                                                                         "output_path").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert outs[0] == outs[1]
    expected = model(site, host, f"https://{host}/guide/p0", None, 1000)
    assert [(seq, url, depth, status) for seq, url, depth, status, _ in outs[0]] == [
        (i, url, depth, status) for i, (url, depth, status, _) in enumerate(expected)]


def test_crawl_capped_query_matches_brute_force(spark, sf_dir):
    """The registered crawl_capped query (part site, depth 3, cap 500) vs a FIFO model on pandas."""
    import pandas as pd

    from wavecrawl.plans import queries as Q

    li = pd.read_parquet(f"{sf_dir}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_partkey"])
    nxt = li.assign(l_linenumber=li.l_linenumber - 1)
    edges = li.merge(nxt, on=["l_orderkey", "l_linenumber"], suffixes=("", "_dst"))
    out_links = edges.groupby("l_partkey")["l_partkey_dst"].apply(lambda s: sorted(set(s))).to_dict()
    parts = set(pd.read_parquet(f"{sf_dir}/part.parquet", columns=["p_partkey"]).p_partkey)
    base = "https://docs.example.com/guide/p"

    def fifo(seed, depth_limit, max_pages):
        queue, queued, visited, out = deque([(seed, 0)]), {seed}, set(), []
        while queue and len(out) < max_pages:
            k, d = queue.popleft()
            queued.discard(k)
            visited.add(k)
            if k not in parts:
                out.append((base + str(k), d, "error_network"))
                continue
            if d + 1 <= depth_limit:
                for t in out_links.get(k, []):
                    if t not in visited and t not in queued:
                        queue.append((t, d + 1))
                        queued.add(t)
            out.append((base + str(k), d, "success"))
        return out

    got = {}
    for r in Q.crawl_capped(spark, sf_dir).orderBy("crawl_id", "seq").collect():
        got.setdefault(r.crawl_id, []).append((r.url, r.depth, r.status))
    assert got[1] == fifo(1, 3, 500)
    assert got[2] == fifo(2, 3, 500)
