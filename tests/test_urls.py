import pytest
from pyspark.sql import functions as F

from folio.functions import urls

SITE = "https://forum.example.org"

POST_CASES = [
    (f"{SITE}/posts/abc123/title", True), (f"{SITE}/s/abc123", True), ("/posts/abc123/title", True),
    ("/posts/123", True), ("https://other.example.com/posts/abc", False), (f"{SITE}/handbook", False),
    ("javascript:alert(1)", False), ("file:///etc/passwd", False), ("data:text/html,x", False),
    (f"{SITE}/posts/../../../../etc/passwd", False), ("/posts/abc/../../../../../../etc/passwd", False),
    ("https://forum.example.org:9090/posts/abc/title", False), ("http:///posts/123", False),
    ("https:///posts/123", False), ("/posts/", False), ("//posts/x", False),
    ("https://forum.example.org:99999/posts/x", False),
]


def test_is_post_url_golden(spark):
    df = spark.createDataFrame([(u,) for u, _ in POST_CASES], "u string")
    got = dict(df.select("u", urls.is_post_url("u").alias("p")).collect())
    assert got == dict(POST_CASES)


def test_validate_url_errors(spark):
    df = spark.createDataFrame([("https://evil.com/x",), ("file:///x",), ("https://a.example.org:8080/x",),
                                ("https://u:p@Forum.Example.org/p?q=1#f",)], "u string")
    v = {r.u: (r.url, r.error) for r in df.select("u", urls.validate_url("u").alias("v")).select("u", "v.*").collect()}
    assert v["https://evil.com/x"][1] == "Unsafe URL domain: evil.com"
    assert v["file:///x"][1] == "Unsafe URL scheme: file"
    assert v["https://a.example.org:8080/x"][1] == "Unsafe URL port: 8080"
    assert v["https://u:p@Forum.Example.org/p?q=1#f"] == ("https://forum.example.org/p?q=1#f", None)


@pytest.mark.parametrize("href,base,expected", [
    ("/a/b", "https://h.org/x/y", "https://h.org/a/b"),
    ("c", "https://h.org/x/y", "https://h.org/x/c"),
    ("../c", "https://h.org/x/y/z", "https://h.org/x/c"),
    ("../../../c", "https://h.org/x", "https://h.org/c"),
    ("//o.org/p", "https://h.org/x", "https://o.org/p"),
    ("?q=1", "https://h.org/x?z=2", "https://h.org/x?q=1"),
    ("#f", "https://h.org/x?z=2", "https://h.org/x?z=2#f"),
    ("mailto:a@b", "https://h.org/x", "mailto:a@b"),
])
def test_resolve_url(spark, href, base, expected):
    r = spark.range(1).select(urls.resolve_url(F.lit(href), F.lit(base)).alias("r")).first().r
    assert r == expected


def test_dangerous_schemes_and_redirect(spark):
    vals = ["java\tscript:x", "&#x6A;avascript:x", "%6A%61vascript:x", "  vbscript:x", "/out?url=javascript%3Ax",
            f"{SITE}/out?url=/etc/passwd", "/relative/path", "https://ok.org/a", "mailto:x@y"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = dict(urls.sanitize_df(df, "v", "s").select("v", "s").collect())
    for v in vals[:5]:
        assert got[v] is None, v
    assert got[f"{SITE}/out?url=/etc/passwd"] == f"{SITE}/etc/passwd"
    assert got["/relative/path"] == f"{SITE}/relative/path"
    assert got["https://ok.org/a"] == "https://ok.org/a"
    assert got["mailto:x@y"] == "mailto:x@y"
