"""Keys, cache, redirects and snapshot diffs on repeated, null and odd rows."""

from folio.operators import dom, incremental, posts
from folio.profile import DEFAULT_PROFILE as PR

BASE = PR.base_url
PAGES = "page_id long, url string, html string"
RECORD = "url string, markdown string, author string, posted_date string"


def body(text):
    return f'<html><head><meta name="author" content="A"></head><body><div class="postBody"><p>{text}</p></div></body></html>'


# ------------------------------------------------------------------ page keys
def test_one_post_for_each_row(spark):
    rows = [(1, "u1", body("one")), (1, "u1", body("one")), (1, "u2", body("two")), (None, "u3", body("three")), (None, None, body("four")),
            (2, "u4", None), (3, "u5", "")]
    got = sorted((r.page_id or 0, r.url or "", r.markdown, r.author) for r in posts.extract_posts(spark.createDataFrame(rows, PAGES)).collect())
    none = "*Content could not be extracted from {}*"
    assert got == sorted([(1, "u1", "one", "A"), (1, "u1", "one", "A"), (1, "u2", "two", "A"), (0, "u3", "three", "A"), (0, "", "four", "A"),
                          (2, "u4", none.format("u4"), ""), (3, "u5", none.format("u5"), "")])


def test_parse_keeps_columns_and_numbers_rows(spark):
    rows = [(k % 3 or None, f"u{k}", f"<p>{k}</p>", {"a": k}) for k in range(50)]
    df = spark.createDataFrame(rows, PAGES + ", page_key map<string,int>").withColumnRenamed("page_key", "kind").repartition(7)
    own, nodes = dom.parse_pages(df)
    assert own.columns == ["page_key", "page_id", "url", "kind"]
    text = nodes.where("kind = 'text'").select("page_id", "text").withColumnRenamed("page_id", "page_key")
    got = {(r.url, r.text, r["kind"]["a"]) for r in own.join(text, "page_key").collect()}
    assert got == {(f"u{k}", str(k), k) for k in range(50)}
    assert own.select("page_key").distinct().count() == 50
    own, nodes = dom.parse_pages(df.limit(0))
    assert own.count() == nodes.count() == 0


# ------------------------------------------------------------------ cache
def put(spark, path, rows, **more):
    incremental.append_post_cache(spark.createDataFrame(rows, RECORD), path, **more)


def cached(spark, path, **more):
    return sorted((r.url, r.markdown) for r in incremental.read_post_cache(spark, path, **more).collect())


def test_newest_record_of_a_key_counts(spark, tmp_path):
    path = str(tmp_path / "cache")
    put(spark, path, [(f"u{k}", "old", None, None) for k in range(20)])
    put(spark, path, [("u1", "new", "", ""), ("u1", "new", "", ""), ("u2", "a", "", ""), ("u2", "b", "", ""), (None, "no key", "", "")])
    want = [(f"u{k}", {1: "new", 2: "b"}.get(k, "old")) for k in range(20)]
    assert cached(spark, path) == sorted(want)
    incremental.compact_post_cache(spark, path)
    assert cached(spark, path) == sorted(want)
    incremental.compact_post_cache(spark, path)  # nothing to do
    put(spark, path, [("u3", "newer", "", ""), ("v", "added", "", "")])
    want[3] = ("u3", "newer")
    assert cached(spark, path) == sorted([*want, ("v", "added")])
    assert incremental._versions(spark, path) == (2, [3])


def test_failed_append_leaves_no_record(spark, tmp_path):
    path = str(tmp_path / "cache")
    put(spark, path, [("u", "one", "", "")])
    torn = tmp_path / "cache/log/version=2/bucket=ab"
    torn.mkdir(parents=True)
    (torn / "part-0.parquet").write_bytes(b"torn")
    assert cached(spark, path) == [("u", "one")]
    put(spark, path, [("u", "two", "", "")])
    assert cached(spark, path) == [("u", "two")]


def test_log_is_compacted_and_lookups_read_few_buckets(spark, tmp_path):
    path = str(tmp_path / "cache")
    for k in range(3):
        put(spark, path, [(f"u{j}", f"{k}", "", "") for j in range(k, 40)], compact_after=3)
    assert incremental._versions(spark, path) == (3, [])
    keys = spark.createDataFrame([("u5",), ("absent",)], "url string").selectExpr("sha2(url, 256) AS url_key")
    found = incremental.read_post_cache(spark, path, keys=keys)
    assert ("u5", "2") in [(r.url, r.markdown) for r in found.collect()]
    assert found.count() < 10
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan


def test_fills_one_row_for_each_stub(spark):
    cache = spark.createDataFrame([("k", "u", "b", "", ""), ("k", "u", "a", "", "2020")], "url_key string, " + RECORD)
    cache = cache.selectExpr("sha2(url, 256) AS url_key", "url", "markdown", "author", "posted_date")
    stubs = spark.createDataFrame([("u", 1), ("u", 2), ("x", 3), (None, 4)], "url string, n int")
    assert sorted((r.n, r.markdown) for r in incremental.fill_from_cache(stubs, cache).collect()) == [(1, "a"), (2, "a")]
    got = incremental.attach_content(stubs, cache.unionByName(cache)).collect()
    assert sorted((r.n, r.markdown) for r in got) == [(1, "a"), (2, "a"), (3, ""), (4, "")]


# ------------------------------------------------------------------ redirects
def follow(url, answers, limit):
    """The rule, one request at a time; URLs are valid unless they say evil."""
    hops = 0
    for _ in range(limit):
        if "evil" in url:
            return None, hops, True
        status, location = answers.get(url, (None, None))
        if status in PR.redirect_statuses and location:
            url, hops = BASE + location if location.startswith("/") else location, hops + 1
            continue
        return (url if status is not None else None), hops, status is None
    return None, hops, True


def test_redirects_like_one_request_at_a_time(spark):
    u = lambda k: f"{BASE}/r/{k}"
    rows = [(u(k), 302, f"/r/{k + 1}") for k in range(12)] + [(u(12), 200, None), (u(20), 301, "/r/21"), (u(21), 307, "/r/20"), (u(30), 301, ""),
            (u(31), 301, None), (u(32), 304, "/r/12"), (u(33), 308, "https://evil.example.com/x"), (u(34), 301, "/r/33"), (u(35), 301, "/r/99"),
            (u(40), 503, None), (u(40), 200, None), (u(40), 302, "/r/0"), (None, 200, None)]
    answers = {}
    for url, status, location in rows:
        answers[url] = min(answers.get(url, (999, "")), (status, location or ""))
    crawl = spark.createDataFrame(rows * 2, "url string, status int, location string")
    starts = [u(k) for k in [*range(13), 20, 21, *range(30, 36), 40, 99]] + ["https://evil.example.com/y"]
    start = spark.createDataFrame([(s,) for s in starts + starts[:3]], "url string")
    for limit in (1, 2, 5, 13, 200):
        got = incremental.resolve_redirects(start, crawl, max_requests=limit).collect()
        assert len(got) == len(starts) + 3
        for r in got:
            assert (r.final_url, r.hops, r.error is not None) == follow(r.url, answers, limit), (r, limit)


# ------------------------------------------------------------------ snapshots
def test_diff_of_repeated_and_null_keys(spark):
    schema = "url string, markdown string"
    old = [("a", "1"), ("b", "1"), ("c", "1"), ("c", "2"), ("d", "1"), ("d", "1"), (None, "x"), (None, None), ("e", None), ("f", None), ("g", "")]
    new = [("a", "1"), ("b", "2"), ("c", "2"), ("c", "1"), ("d", "1"), (None, None), (None, "x"), ("e", None), ("f", ""), ("g", ""), ("h", None)]
    a, b = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    got = {r.url: r.change for r in incremental.snapshot_diff(a, b).collect()}
    assert got == {"a": "same", "b": "changed", "c": "same", "d": "changed", None: "same", "e": "same", "f": "changed", "g": "same", "h": "added"}
    assert {r.url: r.change for r in incremental.snapshot_diff(b, a, same=False).collect()} == {"b": "changed", "d": "changed", "f": "changed", "h": "removed"}
    assert {r.change for r in incremental.snapshot_diff(a, a).collect()} == {"same"}
    assert incremental.snapshot_diff(a, a).count() == 8
    assert incremental.snapshot_diff(a, a, same=False).count() == 0
    assert [r.change for r in incremental.snapshot_diff(a.limit(0), b.limit(1)).collect()] == ["added"]


def test_digests_find_the_differing_leaves_only(spark):
    rows = [(f"k{k}", str(k)) for k in range(3000)]
    a = spark.createDataFrame(rows, "url string, markdown string")
    b = spark.createDataFrame([(k, v + "!") if k in ("k7", "k8") else (k, v) for k, v in rows], "url string, markdown string")
    da = incremental.snapshot_digest(a)
    leaves = incremental.changed_leaves(da, incremental.snapshot_digest(b.repartition(9))).count()
    assert 1 <= leaves <= 2
    got = incremental.snapshot_diff(a, b, same=False, old_digest=da).collect()
    assert {(r.url, r.change) for r in got} == {("k7", "changed"), ("k8", "changed")}
    assert len(got) == 2
