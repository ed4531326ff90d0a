from folio.functions import urls
from folio.profile import DEFAULT_PROFILE as PR

ORIGINS = ["https://forum.example.org", "http://example.org", "https://evil.example.com", "https://notexample.org", "https://u:p@forum.example.org",
           "https://forum.example.org:443", "HTTPS://Forum.example.org", " https://forum.example.org", "https://..", "https://", "", "mailto:a", "//forum.example.org"]
TAILS = ["", "/", "/r/1/0", "/r/1/0/", "/a//b", "/a/./b", "/a/../b", "/a.b/c", "/a~b", "?q=/x", "/x?q", "/x#f", "/x\n", "/x\ty", "/x y", "\\x", "/-_/Z9", "//h/x", "r", "/é"]


def test_plain_urls_agree_with_their_parts(spark):
    every = [o + t for o in ORIGINS for t in TAILS] + [None]
    one = spark.createDataFrame([(x,) for x in every], "u string")
    got = one.select(urls.validate_url("u").alias("v"), urls._validate_parts("u", PR).alias("w")).collect()
    assert [r.v for r in got] == [r.w for r in got]
    pairs = spark.createDataFrame([(h, b) for h in every for b in every], "h string, b string")
    got = pairs.select("h", "b", urls.resolve_url("h", "b").alias("v"), urls._resolve_parts("h", "b").alias("w")).collect()
    assert [r for r in got if r.v != r.w] == []
