from pyspark.sql import functions as F

from wavecrawl.functions import urls as U

CASES = [
    # (input, base, expected)
    ("HTTPS://Docs.Example.com:443/guide/intro/?utm_source=x&utm_medium=y&a=1#top", None,
     "https://docs.example.com/guide/intro?a=1"),
    ("https://docs.example.com/guide/intro/", None, "https://docs.example.com/guide/intro"),
    ("https://docs.example.com/", None, "https://docs.example.com/"),
    ("https://docs.example.com", None, "https://docs.example.com/"),
    ("https://docs.example.com/guide/intro#top", None, "https://docs.example.com/guide/intro"),
    ("http://a.com:80/x", None, "http://a.com/x"),
    ("http://a.com:8080/x", None, "http://a.com:8080/x"),
    ("http://a.com:0080/x", None, "http://a.com/x"),
    ("http://a.com:99999/x", None, None),
    ("http://a.com:ab/x", None, None),
    ("http:// bad.com/x", None, None),
    ("https://a.com//x///y//", None, "https://a.com/x/y"),
    ("https://a.com/a/b/../c/./d", None, "https://a.com/a/c/d"),
    ("https://a.com/a/..", None, "https://a.com/"),
    ("https://a.com/a/b/%2e%2E/c", None, "https://a.com/a/c"),
    ("https://a.com/x?b=2&a=1&B=0", None, "https://a.com/x?a=1&b=2&B=0"),
    ("https://a.com/x?a=2&a=1", None, "https://a.com/x?a=1&a=2"),
    ("https://a.com/x?a", None, "https://a.com/x?a="),
    ("https://a.com/x?q=a%20b&r=~", None, "https://a.com/x?q=a+b&r=%7E"),
    ("https://a.com/x?", None, "https://a.com/x"),
    ("https://a.com/x?utm_source=feed", None, "https://a.com/x"),
    ("https://a.com/x?UTM_Medium=1&ref=2", None, "https://a.com/x?ref=2"),
    ("https://a.com/x?page=2&ref=x", None, "https://a.com/x?page=2&ref=x"),
    ("https://a.com/èaux", None, "https://a.com/%C3%A8aux"),
    ("https://a.com/a b", None, "https://a.com/a%20b"),
    ("https://a.com/%7Efoo", None, "https://a.com/%7Efoo"),
    ("  https://a.com/x  ", None, "https://a.com/x"),
    ("mailto:Test@example.com", None, "mailto:Test@example.com"),
    ("JavaScript:void(0)", None, "javascript:void(0)"),
    ("/guide/two", "https://docs.example.com/guide/one", "https://docs.example.com/guide/two"),
    ("two", "https://docs.example.com/guide/one", "https://docs.example.com/guide/two"),
    ("../two", "https://docs.example.com/guide/sub/one", "https://docs.example.com/guide/two"),
    ("//Other.com/p", "http://docs.example.com/guide/one", "http://other.com/p"),
    ("?q=1", "https://docs.example.com/guide/one", "https://docs.example.com/guide/one?q=1"),
    ("#x", "https://docs.example.com/guide/one?a=1", "https://docs.example.com/guide/one?a=1"),
    ("/ß", "https://a.com/", "https://a.com/%C3%9F"),
    ("/the,", "https://a.com/", "https://a.com/the,"),
    ("/x", None, None),
    ("\\x\\y", "https://a.com/b/c", "https://a.com/x/y"),
]


def test_canonicalize_cases(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(CASES)], "i int, u string, b string")
    got = {r.i: r.n for r in U.canonicalize(df, "u", "b", "n").collect()}
    for i, (a, b, want) in enumerate(CASES):
        assert got[i] == want, (a, b, got[i], want)


def test_scope_and_paths(spark):
    df = spark.createDataFrame(
        [("https://docs.example.com/guide/intro", False), ("https://docs.example.com/guide/intro", True),
         ("https://docs.example.com/guide", False)], "seed string, domain boolean")
    rows = df.select(U.scope_base_url(F.col("seed"), F.col("domain")).alias("b")).collect()
    assert [r.b for r in rows] == ["https://docs.example.com/guide/", "https://docs.example.com/",
                                   "https://docs.example.com/"]
    base = "https://docs.example.com/guide/"
    cases = [("https://docs.example.com/guide", "guide/index.md"),
             ("https://docs.example.com/guide/intro", "guide/intro.md"),
             ("https://docs.example.com/guide/advanced/topic", "guide/advanced/topic.md"),
             ("https://docs.example.com/guidebook", "guide/book.md"),
             ("https://docs.example.com/guide/a.html", "guide/a.html.md"),
             ("https://docs.example.com/guide/Caf%C3%A9%20Menu", "guide/caf-menu.md"),
             ("https://docs.example.com/guide/bad%zz", "guide/bad-zz.md")]
    df = spark.createDataFrame(cases, "u string, want string")
    for r in df.select("want", U.output_path(F.col("u"), F.lit(base)).alias("got")).collect():
        assert r.got == r.want
    r = spark.range(1).select(
        U.suffixed_path(F.lit("guide/install.md"), F.lit("https://docs.example.com/guide/install?lang=en")).alias("p")
    ).first()
    assert r.p == "guide/install--03d468.md"


def test_trailing_slash_only(spark):
    df = spark.createDataFrame([("https://docs.example.com/guide/intro/",), ("https://docs.example.com/",),
                                ("https://docs.example.com/a/?b=2&a=1",)], "u string")
    got = [r.o for r in U.trailing_slash_normalized(df, "u", "o").collect()]
    assert got == ["https://docs.example.com/guide/intro", "https://docs.example.com/",
                   "https://docs.example.com/a?b=2&a=1"]
