import pyarrow as pa

from folio.streaming import refresh


def test_first_of_keys_is_exact_and_takes_nulls():
    big = 2 ** 53
    batch = pa.RecordBatch.from_pydict({"url": ["a", None, "a", "b", None, "c", "c"], "page_id": [big + 1, 4, big + 2, None, 3, 5, None],
                                        "html": list("tuvwxyz")})
    got = refresh.first_of_keys(batch, "url", "page_id").to_pylist()
    assert sorted((str(r["url"]), r["page_id"], r["html"]) for r in got) == [("None", 3, "x"), ("a", big + 1, "t"), ("b", None, "w"), ("c", None, "z")]
    assert refresh.first_of_keys(batch.slice(0, 0), "url", "page_id").num_rows == 0
