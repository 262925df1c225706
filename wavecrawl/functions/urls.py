"""URL canonicalisation and URL-derived columns, as Catalyst expressions.

``canonicalize`` resolves an href (optionally against a base URL column) and
returns the canonical form used everywhere in the crawl: fragment dropped,
scheme and host lower-cased, default port dropped, ``.``/``..`` segments
resolved, ``//`` runs collapsed, one trailing ``/`` stripped (not the root),
``utm_*`` parameters dropped, the remaining parameters sorted by key then
value in locale order and re-encoded form-style. Unparsable input → NULL.

Everything is built from built-in functions, so it stays inside whole-stage
codegen except for the (guarded, rare) higher-order branches: dot-segment
removal, percent-encoding of non-ASCII path characters and query re-sorting
only run on rows whose path/query needs them.

The helpers below ``canonicalize`` expect an already canonical URL.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the crawler being re-implemented).
# Schemes with an authority and their default ports (WHATWG "special" schemes
# other than file).
SPECIAL_DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
# Query parameters whose key matches this (case-insensitive) are dropped.
TRACKING_PARAM = r"(?i)^utm_"
# JavaScript's \s class (String.prototype.trim and /\s/): used by word counts,
# slugs and segment trimming.
JS_WS = "\\t\\n\\u000B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
# ---------------------------------------------------------------------------

# Characters percent-encoded in a path: C0 controls, space, non-ASCII, and " < > ` { }
_PATH_ENCODE_CHAR = r'[^\x21-\x7E]|["<>`{}]'
# ... and in a query (special schemes): C0, space, non-ASCII, " < > '
_QUERY_ENCODE_CHAR = r"[^\x21-\x7E]|[\"<>']"
_SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_BAD_HOST = r"[\x00-\x20#/:<>?@\[\\\]^|%\x7F]"
_CANON_RE = r"^([a-z][a-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?$"

_counter = itertools.count()


def _cmp(a: Column, b: Column) -> Column:
    return F.when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0))


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{JS_WS}]+|[{JS_WS}]+$", "")


def _pct_decode(c: Column, plus_is_space: bool) -> Column:
    """Percent-decode; stray ``%`` stay literal (WHATWG), never raise."""
    fixed = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    if not plus_is_space:
        fixed = F.replace(fixed, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(fixed), c)


def _encode_chars(p: Column, char_class: str) -> Column:
    chars = F.regexp_extract_all(p, F.lit("(?s)."), 0)
    enc = F.transform(
        chars,
        lambda ch: F.when(
            ch.rlike(char_class), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))
        ).otherwise(ch),
    )
    return F.array_join(enc, "")


def _encode_path(p: Column) -> Column:
    return _encode_chars(p, _PATH_ENCODE_CHAR)


def _remove_dot_segments(p: Column) -> Column:
    """RFC 3986 / WHATWG dot-segment removal on a path starting with '/'."""
    segs = F.split(F.substring(p, 2, 1 << 30), "/", -1)
    n = F.size(segs)
    tagged = F.transform(segs, lambda x, i: F.struct(x.alias("s"), (i == n - 1).alias("last")))

    def step(acc: Column, e: Column) -> Column:
        low = F.lower(e["s"])
        is_single = low.isin(".", "%2e")
        is_double = low.isin("..", ".%2e", "%2e.", "%2e%2e")
        popped = F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
        empty_tail = F.array(F.lit(""))
        return (
            F.when(is_double, F.when(e["last"], F.concat(popped, empty_tail)).otherwise(popped))
            .when(is_single, F.when(e["last"], F.concat(acc, empty_tail)).otherwise(acc))
            .otherwise(F.concat(acc, F.array(e["s"])))
        )

    out = F.aggregate(tagged, F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(out, "/"))


def _normalize_query(q: Column) -> Column:
    """URLSearchParams round trip: parse, drop utm_*, sort, form-encode."""
    entries = F.filter(F.split(q, "&", -1), lambda x: x != "")
    pairs = F.transform(
        entries,
        lambda x, i: F.struct(
            _pct_decode(F.regexp_extract(x, "^([^=]*)", 1), True).alias("k"),
            _pct_decode(
                F.when(x.contains("="), F.regexp_extract(x, "^[^=]*=(.*)$", 1)).otherwise(F.lit("")), True
            ).alias("v"),
            i.alias("i"),
        ),
    )
    kept = F.filter(pairs, lambda e: ~e["k"].rlike(TRACKING_PARAM))

    def comparator(left: Column, right: Column) -> Column:
        by_key = _cmp(F.collate(left["k"], "UNICODE"), F.collate(right["k"], "UNICODE"))
        by_val = _cmp(F.collate(left["v"], "UNICODE"), F.collate(right["v"], "UNICODE"))
        primary = F.when(left["k"] == right["k"], by_val).otherwise(by_key)
        # Array.prototype.sort is stable: ties keep input order.
        return F.when(primary != 0, primary).otherwise(_cmp(left["i"], right["i"]))

    ordered = F.array_sort(kept, comparator)
    joined = F.array_join(
        F.transform(ordered, lambda e: F.concat(F.url_encode(e["k"]), F.lit("="), F.url_encode(e["v"]))), "&"
    )
    return F.when(F.size(ordered) > 0, F.concat(F.lit("?"), joined)).otherwise(F.lit(""))


def canonicalize(df: DataFrame, src: str | Column, base: str | Column | None = None,
                 out: str = "normalized_url", canonical: bool = True) -> DataFrame:
    """Add column ``out`` = canonical form of ``src`` resolved against ``base``.

    ``base`` must be an absolute http(s) URL column (e.g. a page's final URL);
    relative input without a usable base gives NULL, as do bad hosts/ports.
    With ``canonical=False`` the result is the plain WHATWG ``href`` (no
    slash collapsing, trailing-slash strip or query rewrite).
    """
    p = f"__u{next(_counter)}_"

    def c(name: str) -> Column:
        return F.col(p + name)

    src_c = F.col(src) if isinstance(src, str) else src
    specials = list(SPECIAL_DEFAULT_PORTS)

    cols = {
        "s": F.regexp_replace(F.regexp_replace(src_c, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", ""),
    }
    df = df.withColumns({p + k: v for k, v in cols.items()})
    step = {"sch": F.lower(F.regexp_extract(c("s"), _SCHEME_RE, 1))}
    if base is not None:
        base_c = F.col(base) if isinstance(base, str) else base
        step.update(
            {
                "bsch": F.lower(F.regexp_extract(base_c, _SCHEME_RE, 1)),
                "bauth": F.regexp_extract(base_c, r"^[A-Za-z][A-Za-z0-9+.\-]*:[/\\]*([^/\\?#]*)", 1),
                "bpath": F.regexp_extract(base_c, r"^[A-Za-z][A-Za-z0-9+.\-]*:[/\\]*[^/\\?#]*([^?#]*)", 1),
                "bq": F.when(
                    base_c.rlike(r"^[^?#]*\?"), F.concat(F.lit("?"), F.regexp_extract(base_c, r"^[^?#]*\?([^#]*)", 1))
                ).otherwise(F.lit("")),
            }
        )
    df = df.withColumns({p + k: v for k, v in step.items()})

    s = c("s")
    has_base = F.lit(base is not None) & (c("bsch").isin(specials) if base is not None else F.lit(False))
    kind = (
        F.when(s.isNull(), F.lit(None))
        .when(c("sch").isin(specials), F.lit("abs"))
        .when(c("sch") != "", F.lit("opaque"))
        .when(~has_base, F.lit("invalid"))
        .when(s.rlike(r"^[/\\]{2}"), F.lit("net"))
        .when(s.rlike(r"^[/\\]"), F.lit("root"))
        .when(s.startswith("?"), F.lit("query"))
        .when(s.startswith("#") | (s == ""), F.lit("same"))
        .otherwise(F.lit("rel"))
    )
    df = df.withColumn(p + "kind", kind)
    k = c("kind")
    after_scheme = F.regexp_replace(F.substring(s, F.length(c("sch")) + 2, 1 << 30), r"^[/\\]+", "")
    net_rest = F.when(k == "abs", after_scheme).when(k == "net", F.regexp_replace(s, r"^[/\\]+", ""))
    if base is not None:
        bdir = F.regexp_replace(F.when(c("bpath") == "", F.lit("/")).otherwise(c("bpath")), "[^/]*$", "")
        bpath = F.when(c("bpath") == "", F.lit("/")).otherwise(c("bpath"))
        tail_rel = (
            F.when(k == "root", s)
            .when(k == "query", F.concat(bpath, s))
            .when(k == "same", F.concat(bpath, c("bq")))
            .when(k == "rel", F.concat(bdir, s))
        )
        auth_rel = c("bauth")
        out_sch = F.when(k.isin("abs", "opaque"), c("sch")).otherwise(c("bsch"))
    else:
        tail_rel = F.lit(None).cast("string")
        auth_rel = F.lit(None).cast("string")
        out_sch = c("sch")
    df = df.withColumns(
        {
            p + "osch": out_sch,
            p + "auth": F.when(k.isin("abs", "net"), F.regexp_extract(net_rest, r"^([^/\\?#]*)", 1)).otherwise(auth_rel),
            p + "tail": F.when(k.isin("abs", "net"), F.regexp_replace(net_rest, r"^[^/\\?#]*", ""))
            .when(k == "opaque", F.substring(s, F.length(c("sch")) + 2, 1 << 30))
            .otherwise(tail_rel),
        }
    )
    tail = c("tail")
    hostport = F.regexp_replace(c("auth"), "^.*@", "")
    ipv6 = hostport.startswith("[")
    df = df.withColumns(
        {
            p + "user": F.regexp_replace(F.regexp_extract(c("auth"), "^(.*)@", 1), ":$", ""),
            p + "host": F.lower(
                F.when(ipv6, F.regexp_extract(hostport, r"^(\[[^\]]*\])", 1)).otherwise(
                    F.regexp_extract(hostport, "^([^:]*)", 1)
                )
            ),
            p + "port": F.when(ipv6, F.regexp_extract(hostport, r"^\[[^\]]*\]:(.*)$", 1)).otherwise(
                F.regexp_extract(hostport, "^[^:]*:(.*)$", 1)
            ),
            p + "rawpath": F.regexp_extract(tail, r"^([^?#]*)", 1),
            p + "rawq": F.when(tail.rlike(r"^[^?#]*\?"), F.regexp_extract(tail, r"^[^?#]*\?([^#]*)", 1)),
        }
    )
    default_port = F.lit(None).cast("int")
    for sch, port in SPECIAL_DEFAULT_PORTS.items():
        default_port = F.when(c("osch") == sch, F.lit(port)).otherwise(default_port)
    port_num = F.when(c("port").rlike("^[0-9]{1,5}$"), c("port").cast("int"))
    port_ok = (c("port") == "") | (port_num.isNotNull() & (port_num <= 65535))
    host_ok = F.when(c("host").startswith("["), c("host").rlike(r"^\[[0-9a-f:.]+\]$")).otherwise(
        (c("host") != "") & ~c("host").rlike(_BAD_HOST)
    )
    port_str = F.when((c("port") == "") | (port_num == default_port), F.lit("")).otherwise(
        F.concat(F.lit(":"), port_num.cast("string"))
    )
    path0 = F.regexp_replace(c("rawpath"), r"\\", "/")
    path0 = F.when(path0 == "", F.lit("/")).when(~path0.startswith("/"), F.concat(F.lit("/"), path0)).otherwise(path0)
    df = df.withColumns(
        {
            p + "ok": k.isin("abs", "net", "root", "query", "same", "rel") & port_ok & host_ok,
            p + "authout": F.concat(
                F.when(c("user") != "", F.concat(c("user"), F.lit("@"))).otherwise(F.lit("")), c("host"), port_str
            ),
            p + "p0": path0,
        }
    )
    p1 = F.when(c("p0").rlike(r"(^|/)(\.|%2[eE]){1,2}(/|$)"), _remove_dot_segments(c("p0"))).otherwise(c("p0"))
    df = df.withColumn(p + "p1", p1)
    p2 = F.when(c("p1").rlike(_PATH_ENCODE_CHAR), _encode_path(c("p1"))).otherwise(c("p1"))
    if canonical:
        p3 = F.regexp_replace(p2, "/{2,}", "/")
        p4 = F.when(p3 != "/", F.regexp_replace(p3, "/$", "")).otherwise(p3)
        q = F.when(c("rawq").isNull() | (c("rawq") == ""), F.lit("")).otherwise(_normalize_query(c("rawq")))
    else:
        p4 = p2
        q = F.when(c("rawq").isNull(), F.lit("")).otherwise(
            F.concat(F.lit("?"), F.when(c("rawq").rlike(_QUERY_ENCODE_CHAR), _encode_chars(c("rawq"), _QUERY_ENCODE_CHAR))
                     .otherwise(c("rawq")))
        )
    df = df.withColumn(p + "path", p4)
    df = df.withColumn(p + "q", q)
    opaque_path = F.regexp_extract(c("tail"), r"^([^?#]*)", 1)
    result = (
        F.when(k == "opaque", F.concat(c("sch"), F.lit(":"), opaque_path, c("q")))
        .when(c("ok"), F.concat(c("osch"), F.lit("://"), c("authout"), c("path"), c("q")))
    )
    # Barrier: a (trivially true) nondeterministic guard stops the optimizer
    # from substituting the step columns into predicates pushed down through
    # this projection, which would duplicate the whole chain per reference.
    df = df.withColumn(out, F.when(F.spark_partition_id() >= 0, result))
    return df.drop(*[x for x in df.columns if x.startswith(p)])


def normalize_url_column(df: DataFrame, col: str, base: str | None = None) -> DataFrame:
    """Replace ``col`` in place with its canonical form."""
    tmp = f"__canon_{next(_counter)}"
    return canonicalize(df, col, base, tmp).withColumn(col, F.col(tmp)).drop(tmp)


# ---------------------------------------------------------------------------
# Accessors on canonical URLs (output of ``canonicalize``).

def url_scheme(u: Column) -> Column:
    return F.regexp_extract(u, _CANON_RE, 1)


def url_host(u: Column) -> Column:
    """Hostname: no userinfo, no port."""
    auth = F.regexp_replace(F.regexp_extract(u, _CANON_RE, 2), "^.*@", "")
    return F.when(auth.startswith("["), F.regexp_extract(auth, r"^(\[[^\]]*\])", 1)).otherwise(
        F.regexp_extract(auth, "^([^:]*)", 1)
    )


def url_origin(u: Column) -> Column:
    auth = F.regexp_replace(F.regexp_extract(u, _CANON_RE, 2), "^.*@", "")
    return F.concat(url_scheme(u), F.lit("://"), auth)


def url_path(u: Column) -> Column:
    path = F.regexp_extract(u, _CANON_RE, 3)
    return F.when(path == "", F.lit("/")).otherwise(path)


def url_search(u: Column) -> Column:
    """``?query`` or '' (like URL.search)."""
    return F.regexp_extract(u, _CANON_RE, 4)


def ensure_trailing_slash(p: Column) -> Column:
    return F.when((p == "") | (p == "/"), F.lit("/")).when(p.endswith("/"), p).otherwise(F.concat(p, F.lit("/")))


def strip_trailing_slash(p: Column) -> Column:
    return F.when((p == "") | (p == "/"), F.lit("/")).otherwise(F.regexp_replace(p, "/$", ""))


def path_segments(p: Column) -> Column:
    return F.filter(F.split(p, "/", -1), lambda s: s != "")


def base_path_of(path: Column) -> Column:
    """Parent directory of a seed path, as the path-mode scope base."""
    np_ = ensure_trailing_slash(path)
    parent = F.regexp_extract(np_, r"^(.*/)[^/]+/$", 1)
    return F.when((path == "/") | (path == ""), F.lit("/")).when(
        (parent == "") | (parent == "/"), F.lit("/")
    ).otherwise(parent)


def scope_base_url(seed_canonical: Column, domain: Column) -> Column:
    """Scope base URL: ``origin/`` in domain mode, ``origin + parent dir`` in path mode."""
    origin = url_origin(seed_canonical)
    return F.when(domain, F.concat(origin, F.lit("/"))).otherwise(
        F.concat(origin, base_path_of(url_path(seed_canonical)))
    )


def in_scope(u: Column, base_url: Column, mode: Column) -> Column:
    """Hostname equal (port and scheme ignored); path mode: ``path/`` under ``base/``."""
    base_path = ensure_trailing_slash(strip_trailing_slash(url_path(base_url)))
    target = ensure_trailing_slash(url_path(u))
    return (url_host(u) == url_host(base_url)) & ((mode == "domain") | target.startswith(base_path))


def depth_from_scope(u: Column, base_url: Column) -> Column:
    """max(0, #segments(url) - #segments(base))."""
    base_segs = F.size(path_segments(url_path(base_url)))
    return F.greatest(F.lit(0), F.size(path_segments(url_path(u))) - base_segs)


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 6)


def sanitize_segment(seg: Column) -> Column:
    decoded = _pct_decode(seg, plus_is_space=False)
    low = F.lower(js_trim(decoded))
    cleaned = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.when(cleaned == "", F.lit("page")).otherwise(cleaned)


def output_path(final_url: Column, base_url: Column) -> Column:
    """Relative Markdown path of a page under the crawl's base URL."""
    target = url_path(final_url)
    base_norm = strip_trailing_slash(url_path(base_url))
    base_slash = ensure_trailing_slash(base_norm)
    base_segs = F.transform(path_segments(base_norm), sanitize_segment)
    # Prefix test without a segment boundary, as the original does.
    base_head = F.regexp_replace(base_slash, "/$", "")
    rel = F.when(
        (base_slash != "/") & target.startswith(base_head), F.substring(target, F.length(base_slash), 1 << 30)
    ).otherwise(target)
    rel_segs = F.transform(path_segments(rel), sanitize_segment)
    return F.when(
        F.size(rel_segs) == 0, F.array_join(F.concat(base_segs, F.array(F.lit("index.md"))), "/")
    ).otherwise(
        F.array_join(F.concat(base_segs, F.array(F.concat(F.array_join(rel_segs, "/"), F.lit(".md")))), "/")
    )


def with_suffix(path: Column, suffix: Column) -> Column:
    """``dir/name.md`` → ``dir/name--<suffix>.md``."""
    return F.concat(F.regexp_replace(path, r"\.md$", ""), F.lit("--"), suffix, F.lit(".md"))


def suffixed_path(path: Column, final_url: Column) -> Column:
    """``dir/name.md`` → ``dir/name--<6 hex of sha256(final_url)>.md``."""
    return with_suffix(path, short_hash(final_url))


def trailing_slash_normalized(df: DataFrame, src: str, out: str) -> DataFrame:
    """Plain WHATWG href of ``src`` with one trailing ``/`` removed from a non-root path."""
    tmp = f"__tsn_{next(_counter)}"
    df = canonicalize(df, src, None, tmp, canonical=False)
    parts = F.regexp_extract(F.col(tmp), r"^([^?#]*)(.*)$", 1)
    rest = F.regexp_extract(F.col(tmp), r"^([^?#]*)(.*)$", 2)
    origin_only = parts.rlike(r"^[a-z][a-z0-9+.\-]*://[^/]*/$")
    stripped = F.when(origin_only, parts).otherwise(F.regexp_replace(parts, "/$", ""))
    return df.withColumn(out, F.when(F.col(tmp).isNotNull(), F.concat(stripped, rest))).drop(tmp)
