import os

from folio.operators import incremental
from folio.plans import standins
from folio.sources.pages import read_markdown


def _names(folder):
    return sorted(os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names)


def test_one_file_a_key_in_few_folders_reads_back_whole(spark, tmp_path):
    out = f"file://{tmp_path}/md"
    rows = spark.range(600).selectExpr("id AS key", "concat('# ', id, char(10), 'é') AS text")
    standins.write_files(rows.unionByName(rows.where("key = 7")), out, ".md")
    names = _names(tmp_path / "md")
    assert len(names) == 600 and len({n.split("/")[0] for n in names}) <= standins.FILE_BLOCKS
    assert all(n.count("/") == 1 and n.endswith(".md") for n in names)
    found = {r.path.rsplit("/", 1)[1]: r.text for r in read_markdown(spark, out).collect()}
    assert len(found) == 600 and found["12.md"] == "# 12\né\n" and found["7.md"] == "# 7\né\n" * 2


def test_json_cache_of_a_folder_with_folders(spark, tmp_path):
    path = f"file://{tmp_path}/json"
    rows = spark.range(40).selectExpr("concat('k', id) AS key", """CASE id % 4 WHEN 0 THEN concat('{"url": "u', id, '"}') WHEN 1 THEN '[{}]'
                                      WHEN 2 THEN '{"url": ' ELSE '{}' END AS text""")
    standins.write_files(rows, path, ".json")
    found = {r.url_key: r.url for r in incremental.read_post_cache(spark, path, "json").collect()}
    assert found == {f"k{i}": (f"u{i}" if i % 4 == 0 else None) for i in range(40) if i % 4 in (0, 3)}


def test_folders_are_read_in_tasks_as_spark_reads_them(spark, tmp_path):
    root = tmp_path / "in"
    (root / "a b" / "deep=1").mkdir(parents=True)
    (root / "_gone").mkdir()
    texts = {"1.md": "one", "a b/é +%41.md": "zwei\n", "a b/deep=1/x#y.md": "d\r\n", "a b/bytes.md": b"\xff\xfe a", "a b/empty.md": "",
             "_gone/2.md": "no", ".3.md": "no", "_4.md": "no", "a b/_k=5.md": "5", "a b/[x]^`.md": "6"}
    for name, text in texts.items():
        (root / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    path = f"file://{root}"
    old = spark.read.text(path, wholetext=True, recursiveFileLookup=True).selectExpr("xxhash64(input_file_name()) AS doc_id", "input_file_name() AS path", "value AS text")
    new = read_markdown(spark, path)
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "in/" not in plan
    rows = lambda df: sorted((r.doc_id, r.path, bytes(r.text)) for r in df.selectExpr("doc_id", "path", "cast(text AS binary) AS text").collect())
    assert rows(new) == rows(old) and len(rows(new)) == 6
    assert rows(read_markdown(spark, path + "/*.md")) == [r for r in rows(old) if r[1].endswith("/in/1.md")]


def test_driver_holds_no_json_files(spark, tmp_path):
    path = f"file://{tmp_path}/json"
    standins.write_files(spark.range(30).selectExpr("concat('k', id) AS key", """concat('{"url": "u', id, '"}') AS text"""), path, ".json")
    cache = incremental.read_post_cache(spark, path, "json")
    assert cache.count() == 30 and not [f for f in cache.inputFiles() if f.endswith(".json")]
