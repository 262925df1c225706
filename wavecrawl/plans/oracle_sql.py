"""Plain-SQL (DuckDB) statements of the registered queries.

Each is an independent statement over the captured tables, written from the
semantics (not from the Spark plan): URL canonical form, scope, filters,
naming and numbering are re-stated with regexes, lists and windows. Used as
the correctness oracle at sf0.01.
"""

from __future__ import annotations

# RE2 class body of JavaScript whitespace (\s).
JS_WS_RE2 = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_JS_WS_CODES = [9, 10, 11, 12, 13, 32, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288, 65279]
JS_WS_CHARS = " || ".join(f"chr({c})" for c in _JS_WS_CODES)


def js_trim(x: str) -> str:
    return f"trim({x}, {JS_WS_CHARS})"


def form_encode(x: str) -> str:
    return f"replace(replace(replace(url_encode({x}), '%20', '+'), '%2A', '*'), '~', '%7E')"


def canon_ctes(name: str, src: str, keys: list[str], url: str) -> str:
    """CTEs ending in ``name``(keys..., canon) for absolute http(s) URLs."""
    k = ", ".join(keys)
    ek = ", ".join(f"e.{c}" for c in keys)
    return f"""
{name}_p AS (
  SELECT {k},
    lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS sch,
    lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*:[/]*([^/?#]*)', 1)) AS hp,
    regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*:[/]*[^/?#]*([^?#]*)', 1) AS rawpath,
    CASE WHEN regexp_matches({url}, '^[^?#]*[?]') THEN regexp_extract({url}, '^[^?#]*[?]([^#]*)', 1) END AS rawq
  FROM {src}
),
{name}_e AS (
  SELECT {k}, sch,
    regexp_extract(hp, '^([^:]*)', 1) AS host,
    regexp_extract(hp, '^[^:]*:([0-9]*)$', 1) AS port,
    regexp_replace(array_to_string(list_transform(
        regexp_extract_all(CASE WHEN rawpath = '' THEN '/' ELSE rawpath END, '.'),
        lambda c: CASE WHEN regexp_matches(c, '[^!-~]|["<>`{{}}]') THEN url_encode(c) ELSE c END), ''),
      '/{{2,}}', '/', 'g') AS p1
  FROM {name}_p
),
{name}_kv AS (
  SELECT {k}, x, i,
    url_decode(replace(split_part(x, '=', 1), '+', ' ')) AS qk,
    CASE WHEN strpos(x, '=') > 0 THEN url_decode(replace(substr(x, strpos(x, '=') + 1), '+', ' ')) ELSE '' END AS qv
  FROM (SELECT {k}, unnest(string_split(rawq, '&')) AS x, unnest(range(len(string_split(rawq, '&')))) AS i
        FROM {name}_p WHERE rawq IS NOT NULL AND rawq <> '')
  WHERE x <> ''
),
{name}_q AS (
  SELECT {k}, string_agg({form_encode('qk')} || '=' || {form_encode('qv')}, '&'
                         ORDER BY qk COLLATE en, qv COLLATE en, i) AS qs
  FROM {name}_kv WHERE NOT regexp_matches(qk, '^utm_', 'i') GROUP BY {k}
),
{name} AS (
  SELECT {ek}, e.sch || '://' || e.host ||
    CASE WHEN e.port = '' OR (e.sch = 'http' AND e.port::INT = 80) OR (e.sch = 'https' AND e.port::INT = 443)
         THEN '' ELSE ':' || CAST(e.port::INT AS VARCHAR) END ||
    CASE WHEN e.p1 = '/' THEN '/' ELSE regexp_replace(e.p1, '/$', '') END ||
    coalesce('?' || q.qs, '') AS canon
  FROM {name}_e e LEFT JOIN {name}_q q USING ({k})
)"""


def url_path(c: str) -> str:
    return f"coalesce(nullif(regexp_extract({c}, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')"


def url_search(c: str) -> str:
    return f"regexp_extract({c}, '^[^?#]*([?][^#]*)$', 1)"


def url_origin(c: str) -> str:
    return f"regexp_extract({c}, '^([a-z][a-z0-9+.-]*://[^/?#]*)', 1)"


def url_host(c: str) -> str:
    return f"regexp_extract({c}, '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)"


def ensure_slash(p: str) -> str:
    return f"(CASE WHEN {p} IN ('', '/') THEN '/' WHEN ends_with({p}, '/') THEN {p} ELSE {p} || '/' END)"


def parent_dir(p: str) -> str:
    par = f"regexp_extract({ensure_slash(p)}, '^(.*/)[^/]+/$', 1)"
    return f"(CASE WHEN {p} IN ('/', '') OR {par} IN ('', '/') THEN '/' ELSE {par} END)"


def sanitize_segment(s: str) -> str:
    low = f"lower({js_trim(f'url_decode({s})')})"
    clean = f"regexp_replace(regexp_replace({low}, '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"coalesce(nullif({clean}, ''), 'page')"


def squash(x: str) -> str:
    return f"regexp_replace({js_trim(x)}, '[{JS_WS_RE2}]+', ' ', 'g')"


def slug(x: str) -> str:
    low = f"lower({js_trim(x)})"
    kept = f"regexp_replace({low}, '[^a-z0-9{JS_WS_RE2}-]', '', 'g')"
    return f"regexp_replace(regexp_replace({kept}, '[{JS_WS_RE2}]+', '-', 'g'), '-+', '-', 'g')"


def html_unescape(x: str) -> str:
    return (f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), "
            f"'&#39;', ''''), '&amp;', '&')")


PAGES_CANON = canon_ctes("pc", "pages", ["page_id"], "url")

NORMALIZE_URLS = f"""
WITH {PAGES_CANON}
SELECT p.page_id, p.url, pc.canon AS normalized_url FROM pages p JOIN pc USING (page_id)
"""

DERIVE_SCOPES = f"""
WITH {PAGES_CANON}
SELECT page_id, canon AS seed,
  {url_origin('canon')} || {parent_dir(url_path('canon'))} AS path_base_url,
  {url_origin('canon')} || '/' AS domain_base_url
FROM pc
"""

_HREF_RE = "'<a href=\"([^\"]*)\"'"
PAGE_LINKS = f"""
{PAGES_CANON},
hrefs AS (
  SELECT page_id, unnest(regexp_extract_all(html, {_HREF_RE}, 1)) AS href,
         unnest(range(len(regexp_extract_all(html, {_HREF_RE}, 1)))) AS pos
  FROM pages
),
res AS (
  SELECT h.page_id, h.pos, h.href, pc.canon AS page_url,
    CASE WHEN regexp_matches(h.href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h.href
         WHEN starts_with(h.href, '/') THEN {url_origin('pc.canon')} || h.href END AS abs_url
  FROM hrefs h JOIN pc USING (page_id)
  WHERE trim(h.href) <> ''
),
{canon_ctes('lc', 'res', ['page_id', 'pos'], 'abs_url')},
firsts AS (SELECT page_id, canon AS link_url, min(pos) AS pos FROM lc GROUP BY page_id, canon),
links AS (
  SELECT f.page_id, r.page_url, f.pos, r.href, f.link_url FROM firsts f JOIN res r USING (page_id, pos)
)"""

LINK_EXTRACT = f"""
WITH {PAGE_LINKS}
SELECT page_id, CAST(pos AS BIGINT) AS pos, href, link_url FROM links
"""

# Hand-written RE2 forms of the job-wide globs of ``filter_decisions``:
# exclude '/*.' and include '/[A-Z]*'.
_EXCLUDE_RE2 = "^/[^./][^/]*\\.$"
_INCLUDE_RE2 = "^/[A-Z][^/]*$"
_BINARY_RE2 = "\\.(pdf|zip|png|jpg|jpeg|gif|svg|webp|ico|woff|woff2|mp4|mp3|xml|json|rss|txt|map)$"
_SKIP_RE2 = "/(search|tags|tag|blog|changelog|releases|pricing|contact|legal|_next|assets|static)/"


def _any_candidate(regex: str, url: str) -> str:
    path = url_path(url)
    return (f"(regexp_matches({url}, '{regex}') OR regexp_matches({path}, '{regex}') "
            f"OR regexp_matches({path} || {url_search(url)}, '{regex}'))")


DECISIONS = f"""
{PAGE_LINKS},
scoped AS (
  SELECT *, {url_origin('page_url')} || CASE WHEN mode = 'domain' THEN '/' ELSE {parent_dir(url_path('page_url'))} END
      AS base_url
  FROM (SELECT *, unnest(['path', 'domain']) AS mode FROM links)
),
decided AS (
  SELECT page_id, mode, pos, link_url, page_url,
    CASE
      WHEN NOT ({url_host('link_url')} = {url_host('base_url')} AND
                (mode = 'domain' OR starts_with({ensure_slash(url_path('link_url'))}, {url_path('base_url')})))
        THEN 'out_of_scope'
      WHEN {_any_candidate(_EXCLUDE_RE2, 'link_url')} THEN 'excluded'
      WHEN {_any_candidate(_INCLUDE_RE2, 'link_url')} THEN
        CASE WHEN regexp_matches(lower({url_path('link_url')}), '{_BINARY_RE2}') THEN 'binary_extension'
             ELSE 'allowed' END
      WHEN regexp_matches({ensure_slash(f"lower({url_path('link_url')})")}, '{_SKIP_RE2}') THEN 'builtin_skip'
      WHEN regexp_matches(lower({url_path('link_url')}), '{_BINARY_RE2}') THEN 'binary_extension'
      ELSE 'allowed'
    END AS decision
  FROM scoped
)"""

FILTER_DECISIONS = f"""
WITH {DECISIONS}
SELECT page_id, mode, CAST(pos AS BIGINT) AS pos, link_url, decision FROM decided
"""

REJECT_REASON_COUNTS = f"""
WITH {DECISIONS}
SELECT {url_host('page_url')} AS host, mode, decision, count(*) AS n_links, count(DISTINCT link_url) AS n_targets
FROM decided GROUP BY ALL
"""

PAGE_HASH_WORDS = f"""
SELECT doc_id, CAST(len(regexp_extract_all(c, '[^{JS_WS_RE2}]+')) AS BIGINT) AS word_count,
  sha256(c) AS content_hash,
  CASE WHEN len(regexp_extract_all(c, '[^{JS_WS_RE2}]+')) >= 10 THEN 'success' ELSE 'skipped_empty' END AS status
FROM (SELECT doc_id, {js_trim('text')} AS c FROM documents)
"""

OUTPUT_PATHS = f"""
WITH {PAGES_CANON},
moved AS (SELECT DISTINCT 'https://docs.example.com' || {url_path('canon')} || {url_search('canon')} AS url FROM pc),
named AS (
  SELECT url, list_transform(list_filter(string_split({url_path('url')}, '/'), lambda s: s <> ''),
                             lambda s: {sanitize_segment('s')}) AS segs
  FROM moved
),
nat AS (
  SELECT url, CASE WHEN len(segs) = 0 THEN 'index.md' ELSE array_to_string(segs, '/') || '.md' END AS p0
  FROM named
)
SELECT url,
  CASE WHEN row_number() OVER (PARTITION BY p0 ORDER BY url COLLATE en, url) = 1 THEN p0
       ELSE regexp_replace(p0, '\\.md$', '') || '--' || substr(sha256(url), 1, 6) || '.md' END AS output_path
FROM nat
"""

HEADING_ANCHORS = f"""
WITH {PAGES_CANON},
titled AS (
  SELECT page_id, {url_host('pc.canon')} AS host,
    {squash(html_unescape("regexp_extract(p.html, '<title>(.*?)</title>', 1)"))} AS title
  FROM pages p JOIN pc USING (page_id)
),
slugged AS (SELECT page_id, host, title AS heading, {slug('title')} AS s FROM titled),
numbered AS (SELECT *, row_number() OVER (PARTITION BY host, s ORDER BY page_id) AS n FROM slugged)
SELECT page_id, host, heading, CASE WHEN n = 1 THEN s ELSE s || '-' || CAST(n AS VARCHAR) END AS anchor
FROM numbered
"""


CRAWL_REACHABILITY = """
WITH RECURSIVE edges AS (
  SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
),
reach(crawl_id, partkey, depth) USING KEY (crawl_id, partkey) AS (
  SELECT crawl_id, partkey, 0 FROM (VALUES (1::BIGINT, 1::BIGINT), (2::BIGINT, 2::BIGINT)) s(crawl_id, partkey)
  UNION
  SELECT r.crawl_id, e.dst, min(r.depth) + 1
  FROM reach r JOIN edges e ON e.src = r.partkey
  WHERE NOT EXISTS (SELECT 1 FROM recurring.reach x WHERE x.crawl_id = r.crawl_id AND x.partkey = e.dst)
  GROUP BY r.crawl_id, e.dst
)
SELECT crawl_id, 'https://docs.example.com/guide/p' || partkey AS url, CAST(depth AS INTEGER) AS depth,
  'success' AS status, 'guide/p' || partkey || '.md' AS output_path
FROM reach
"""



def fifo_queue(cap: int, depth: int | None) -> str:
    """The crawl queue in FIFO order: the part site's pages, their first enqueuer and sequence number.

    Each recursion is one wave: links of pages under the cap, first enqueuer by (source, position).
    """
    limit = f"AND r.depth + 1 <= {depth}" if depth is not None else ""
    return f"""
WITH RECURSIVE edges AS (
  SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS pos FROM (
    SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)
),
q(crawl_id, partkey, seq, depth, src_seq) USING KEY (crawl_id, partkey) AS (
  SELECT crawl_id, partkey, 0::BIGINT, 0, -1::BIGINT
  FROM (VALUES (1::BIGINT, 1::BIGINT), (2::BIGINT, 2::BIGINT)) s(crawl_id, partkey)
  UNION
  SELECT n.crawl_id, n.dst, b.base + row_number() OVER (PARTITION BY n.crawl_id ORDER BY n.first), n.depth, n.first.s
  FROM (
    SELECT r.crawl_id, e.dst, min({{'s': r.seq, 'p': e.pos}}) AS first,
      arg_min(r.depth + 1, {{'s': r.seq, 'p': e.pos}}) AS depth
    FROM q r JOIN edges e ON e.src = r.partkey
    WHERE r.seq < {cap} {limit}
      AND NOT EXISTS (SELECT 1 FROM recurring.q x WHERE x.crawl_id = r.crawl_id AND x.partkey = e.dst)
    GROUP BY r.crawl_id, e.dst) n
  JOIN (SELECT crawl_id, max(seq) AS base FROM recurring.q GROUP BY crawl_id) b ON b.crawl_id = n.crawl_id
)"""


CRAWL_CAPPED = f"""{fifo_queue(500, 3)}
SELECT crawl_id, seq, 'https://docs.example.com/guide/p' || partkey AS url, CAST(depth AS INTEGER) AS depth,
  'success' AS status, 'guide/p' || partkey || '.md' AS output_path
FROM q WHERE seq < 500
"""

QUEUED_LINKS = f"""{fifo_queue(100, None)}
SELECT c.crawl_id, c.src_seq, 'https://docs.example.com/guide/p' || p.partkey AS src_url, count(*) AS queued
FROM q c JOIN q p ON p.crawl_id = c.crawl_id AND p.seq = c.src_seq
WHERE c.src_seq >= 0 GROUP BY ALL
"""

SITEMAP_ORDER = """
WITH RECURSIVE files AS (
  SELECT DISTINCT n_regionkey AS r, c_mktsegment AS seg, CAST(floor(c_custkey / 50000) AS BIGINT) AS chunk
  FROM customer JOIN nation ON c_nationkey = n_nationkey
),
listed AS (
  SELECT n_regionkey AS r, 'root' AS doc, n_nationkey AS rank, '' AS seg, 0::BIGINT AS chunk, 'n' || n_nationkey AS child FROM nation
  UNION ALL SELECT r, 'root', 1 << 20, seg, chunk, seg || chunk FROM files
  UNION ALL
  SELECT n_regionkey, 'n' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 2 END, '', 0,
    coalesce('n' || lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 'root') FROM nation
  UNION ALL
  SELECT n_regionkey, 'n' || n_nationkey, 1, seg, chunk, seg || chunk
  FROM nation JOIN files ON r = n_regionkey WHERE (length(seg) + n_nationkey) % 3 = 0
),
entries AS (SELECT r, doc, child, row_number() OVER (PARTITION BY r, doc ORDER BY rank, seg, chunk) AS pos FROM listed),
ways(r, doc, key, trail) AS (
  SELECT r_regionkey, 'root', []::BIGINT[], ['root'] FROM region
  UNION ALL
  SELECT w.r, e.child, list_append(w.key, e.pos), list_append(w.trail, e.child)
  FROM ways w JOIN entries e ON e.r = w.r AND e.doc = w.doc WHERE NOT list_contains(w.trail, e.child)
),
opened AS (SELECT r, doc, min(key) AS key FROM ways GROUP BY r, doc)
SELECT CAST(n_regionkey AS BIGINT) AS crawl_id,
  CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY o.key, c_custkey) AS BIGINT) AS seq,
  'https://r' || n_regionkey || '.example.com/docs/c' || c_custkey AS url, 1 AS depth
FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN opened o ON o.r = n_regionkey AND o.doc = c_mktsegment || CAST(floor(c_custkey / 50000) AS BIGINT)
UNION ALL
SELECT CAST(r_regionkey AS BIGINT), CAST(0 AS BIGINT), 'https://r' || r_regionkey || '.example.com/docs/start', 0
FROM region
"""

SITEMAP_EXPAND = """
WITH listed AS (
  SELECT CAST(n.n_regionkey AS BIGINT) AS crawl_id, n.n_nationkey, c.c_custkey
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  WHERE c.c_mktsegment NOT IN ('MACHINERY', 'FURNITURE')
)
SELECT crawl_id,
  CAST(row_number() OVER (PARTITION BY crawl_id ORDER BY n_nationkey, floor(c_custkey / 50000), c_custkey) AS BIGINT)
    AS seq,
  'https://r' || crawl_id || '.example.com/docs/c' || c_custkey AS url, 1 AS depth
FROM listed
UNION ALL
SELECT CAST(r_regionkey AS BIGINT), CAST(0 AS BIGINT), 'https://r' || r_regionkey || '.example.com/docs/start', 0
FROM region
"""

_ORDER_WAVE = """
o AS (
  SELECT o_orderkey, o_custkey, o_orderstatus AS st, o_orderpriority AS prio,
    CAST(year(o_orderdate) AS BIGINT) AS crawl_id
  FROM orders
),
w AS (SELECT *, CAST(row_number() OVER (PARTITION BY crawl_id ORDER BY o_orderkey) - 1 AS BIGINT) AS seq FROM o),
r AS (
  SELECT *, 'https://shop.example.com/orders/' || o_orderkey AS url,
    (prio = '2-HIGH' AND st = 'P') OR (prio = '1-URGENT' AND st = 'P') AS net,
    CASE WHEN prio = '1-URGENT' AND st = 'P' THEN 'ECONNRESET' ELSE 'no captured response' END AS net_error,
    CASE WHEN prio = '5-LOW' THEN 404 WHEN prio = '4-NOT SPECIFIED' THEN 503 ELSE 200 END AS http,
    CASE WHEN st = 'P' THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS ctype,
    'https://shop.example.com/customers/' || o_custkey AS fin
  FROM w
),
d AS (
  SELECT *, min(CASE WHEN NOT net THEN seq END) OVER (PARTITION BY crawl_id, CASE WHEN NOT net THEN fin END) AS win
  FROM r
),
cls AS (
  SELECT crawl_id, seq, url,
    CASE WHEN net THEN url ELSE fin END AS final_url,
    CASE WHEN net THEN 'error_network' WHEN seq <> win THEN 'skipped_filtered' WHEN http >= 400 THEN 'error_http'
         WHEN NOT contains(lower(ctype), 'text/html') THEN 'skipped_filtered' ELSE 'fetched' END AS status,
    CASE WHEN net THEN NULL ELSE http END AS http_status,
    CASE WHEN net THEN net_error WHEN seq <> win THEN 'duplicate_final_url' WHEN http >= 400 THEN 'HTTP ' || http
         WHEN NOT contains(lower(ctype), 'text/html') THEN 'non_html:' || ctype END AS error
  FROM d
)"""

FINAL_URL_DEDUP = f"""
WITH {_ORDER_WAVE}
SELECT crawl_id, seq, url, final_url, status, CAST(http_status AS INTEGER) AS http_status, error FROM cls
"""

FINAL_URL_DEDUP_WAVES = """
WITH w AS (
  SELECT o_orderkey, o_orderstatus AS st, o_orderpriority AS prio, CAST(year(o_orderdate) AS BIGINT) AS crawl_id,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END AS wave,
    CASE WHEN o_orderstatus = 'F' THEN 'https://shop.example.com/login'
         ELSE 'https://shop.example.com/customers/' || o_custkey END AS fin
  FROM orders
),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY crawl_id ORDER BY wave, o_orderkey) - 1 AS BIGINT) AS seq,
    'https://shop.example.com/orders/' || o_orderkey AS url, st = 'P' AND prio IN ('1-URGENT', '2-HIGH') AS net,
    CASE prio WHEN '5-LOW' THEN 404 WHEN '4-NOT SPECIFIED' THEN 503 ELSE 200 END AS http
  FROM w
),
d AS (SELECT *, row_number() OVER (PARTITION BY crawl_id, net, fin ORDER BY seq) > 1 AS again FROM r)
SELECT crawl_id, seq, wave, url, CASE WHEN net THEN url ELSE fin END AS final_url,
  CASE WHEN net THEN 'error_network' WHEN again THEN 'skipped_filtered' WHEN http >= 400 THEN 'error_http'
       WHEN st = 'P' THEN 'skipped_filtered' ELSE 'fetched' END AS status,
  CASE WHEN NOT net THEN http END AS http_status,
  CASE WHEN net THEN CASE WHEN prio = '1-URGENT' THEN 'ECONNRESET' ELSE 'no captured response' END
       WHEN again THEN 'duplicate_final_url' WHEN http >= 400 THEN 'HTTP ' || http
       WHEN st = 'P' THEN 'non_html:application/pdf' END AS error
FROM d
"""

STATUS_SUMMARY = f"""
WITH {_ORDER_WAVE}
SELECT crawl_id, count(*) AS total, count(*) FILTER (WHERE status = 'fetched') AS fetched,
  count(*) FILTER (WHERE status IN ('skipped_filtered', 'skipped_empty')) AS skipped,
  count(*) FILTER (WHERE status IN ('error_http', 'error_network', 'error_parse')) AS failed
FROM cls GROUP BY crawl_id
"""

ATTEMPT_RESOLUTION = """
WITH a AS (
  SELECT 'https://shop.example.com/orders/' || l_orderkey AS url,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
         l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INTEGER) AS attempt,
    CASE WHEN l_returnflag = 'A' THEN 'timeout' ELSE 'response' END AS outcome,
    CASE WHEN l_returnflag = 'R' THEN 429 WHEN l_returnflag = 'N' THEN 200 END AS status,
    CASE WHEN l_linestatus = 'O' THEN 'text/html; charset=utf-8' ELSE 'text/plain' END AS content_type,
    'line ' || l_linenumber AS body
  FROM lineitem
),
k AS (SELECT *, CASE WHEN outcome = 'timeout' THEN 'timeout' WHEN status = 429 THEN 'rate_limited'
                     ELSE 'final' END AS kind FROM a),
s AS (SELECT *, kind <> 'final' AND attempt = min(attempt) OVER (PARTITION BY url, kind) AS skipped FROM k),
agg AS (SELECT url, min(CASE WHEN NOT skipped THEN attempt END) AS eff, max(attempt) AS last FROM s GROUP BY url)
SELECT s.url, s.attempt, CAST(s.status AS INTEGER) AS status, s.content_type, s.body,
  CASE WHEN s.outcome = 'timeout' THEN 'timeout' END AS error
FROM s JOIN agg ON s.url = agg.url AND s.attempt = coalesce(agg.eff, agg.last)
"""

STREAM_ADMIT = f"""
WITH {PAGE_LINKS}
SELECT DISTINCT {url_host('page_url')} AS host, link_url AS url
FROM links
WHERE {url_host('link_url')} = {url_host('page_url')}
  AND NOT regexp_matches({ensure_slash(f"lower({url_path('link_url')})")}, '{_SKIP_RE2}')
  AND NOT regexp_matches(lower({url_path('link_url')}), '{_BINARY_RE2}')
"""

PAGES_CRAWL = f"""
WITH RECURSIVE {PAGE_LINKS},
captured AS (SELECT DISTINCT canon AS url FROM pc),
seeds AS (
  SELECT {url_host('canon')} AS host, arg_min(canon, page_id) AS url FROM pc GROUP BY 1
),
edges AS (
  SELECT DISTINCT page_url AS src, link_url AS dst FROM links
  WHERE {url_host('link_url')} = {url_host('page_url')}
    AND NOT regexp_matches({ensure_slash(f"lower({url_path('link_url')})")}, '{_SKIP_RE2}')
    AND NOT regexp_matches(lower({url_path('link_url')}), '{_BINARY_RE2}')
),
reach(host, url, depth) USING KEY (host, url) AS (
  SELECT host, url, 0 FROM seeds
  UNION
  SELECT r.host, e.dst, min(r.depth) + 1
  FROM reach r JOIN captured c ON c.url = r.url JOIN edges e ON e.src = r.url
  WHERE NOT EXISTS (SELECT 1 FROM recurring.reach x WHERE x.host = r.host AND x.url = e.dst)
  GROUP BY r.host, e.dst
)
SELECT r.host, r.url, CAST(r.depth AS INTEGER) AS depth,
  CASE WHEN c.url IS NOT NULL THEN 200 END AS http_status,
  CASE WHEN c.url IS NULL THEN 'no captured response' END AS error
FROM reach r LEFT JOIN captured c ON c.url = r.url
"""

PAGE_FILES = """
SELECT CAST(floor(doc_id / 1000) AS BIGINT) || '/d/' || doc_id || '.md' AS name,
  CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS sha256
FROM documents
"""

REGISTRY = {
    "normalize_urls": NORMALIZE_URLS,
    "derive_scopes": DERIVE_SCOPES,
    "link_extract": LINK_EXTRACT,
    "filter_decisions": FILTER_DECISIONS,
    "reject_reason_counts": REJECT_REASON_COUNTS,
    "page_hash_words": PAGE_HASH_WORDS,
    "output_paths": OUTPUT_PATHS,
    "heading_anchors": HEADING_ANCHORS,
    "crawl_reachability": CRAWL_REACHABILITY,
    "crawl_capped": CRAWL_CAPPED,
    "queued_links": QUEUED_LINKS,
    "sitemap_expand": SITEMAP_EXPAND,
    "sitemap_order": SITEMAP_ORDER,
    "final_url_dedup": FINAL_URL_DEDUP,
    "final_url_dedup_waves": FINAL_URL_DEDUP_WAVES,
    "status_summary": STATUS_SUMMARY,
    "attempt_resolution": ATTEMPT_RESOLUTION,
    "page_files": PAGE_FILES,
    "stream_admit": STREAM_ADMIT,
    "pages_crawl": PAGES_CRAWL,
}
