import pyarrow as pa
import pyarrow.compute

from folio.operators import dom


def test_nodes_leave_a_large_input_batch_in_small_ones():
    pages = ["<p>" + "x" * 10_000 + "</p>"] * 1500 + [None, "<p>" + "y" * 9_000_000 + "</p>", "<p>z</p>"]
    batch = pa.RecordBatch.from_pydict({"page_id": pa.array(range(len(pages)), pa.int64()), "html": pages})
    out = list(dom._parse_batches(iter([batch])))
    longest = [sum(len(t or "") for t in b.column("text").to_pylist()) for b in out]
    assert sorted(longest)[-1] < 9_000_000 + 4_000_000 and sorted(longest)[-2] <= 4_000_000
    assert max(b.num_rows for b in out) <= 20_000 + 10
    rows = pa.Table.from_batches(out)
    assert sorted(set(rows.column("page_id").to_pylist())) == list(range(len(pages)))
    assert rows.filter(pa.compute.equal(rows.column("kind"), "text")).num_rows == 1502


def test_py_strip_is_python_strip(spark):
    space = "".join(c for c in map(chr, range(0x110000)) if c.isspace())
    texts = [space + "a b" + space, "a", "", space, "\n  a​ \r\n", None, "  a  " * 3]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r.i: r.t for r in df.select("i", dom.py_strip(df.t).alias("t")).collect()}
    assert found == {i: None if t is None else t.strip() for i, t in enumerate(texts)}
    assert "RegExpReplace" not in (plan := df.select(dom.py_strip(df.t))._jdf.queryExecution().optimizedPlan().toString()) and "regexp_replace" not in plan
