"""Canonical form is idempotent (the crawl relies on it for discovered links)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wavecrawl.functions import urls as U

SEG = st.text(alphabet="abcXYZ019-._~%é ß/", min_size=0, max_size=6)
KEY = st.sampled_from(["a", "B", "b", "utm_x", "q", "é", "a b", "k%20"])
VAL = st.text(alphabet="abc 12+%&=é", max_size=4)


@st.composite
def urls(draw):
    scheme = draw(st.sampled_from(["http", "https", "HTTP"]))
    host = draw(st.sampled_from(["docs.example.com", "Docs.Example.COM", "a-b.example.org"]))
    port = draw(st.sampled_from(["", ":80", ":443", ":8080", ":0443"]))
    path = "/" + "/".join(draw(st.lists(SEG, max_size=4)))
    query = ""
    if draw(st.booleans()):
        pairs = draw(st.lists(st.tuples(KEY, VAL), max_size=3))
        query = "?" + "&".join(f"{k}={v}" for k, v in pairs)
    frag = draw(st.sampled_from(["", "#top", "#"]))
    return f"{scheme}://{host}{port}{path}{query}{frag}"


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(urls(), min_size=150, max_size=150))
def test_canonical_form_is_idempotent(spark, batch):
    df = spark.createDataFrame([(u,) for u in batch], "u string")
    once = U.canonicalize(df, "u", None, "c1")
    twice = U.canonicalize(once, "c1", None, "c2")
    for r in twice.collect():
        assert r.c1 is not None, r.u
        assert r.c1 == r.c2, (r.u, r.c1, r.c2)
        assert "#" not in r.c1 and "utm_" not in r.c1.lower()
