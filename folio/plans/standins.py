"""Stand-in inputs for operators whose features the test tables lack.

Each builder only produces rows in the schema an operator expects, made
from the given tables (so their size grows with the tables); the
operator then does all of its own work on them. The matching DuckDB SQL
builds the same rows for the oracle.
"""

from __future__ import annotations

from urllib.parse import quote

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.pages import table

# ---- fixed values: URL shapes of the golden cases ({id} = page_id) ----
URL_TEMPLATES = [
    "/posts/{id}/title",
    "https://forum.example.org/posts/{id}/title",
    "https://forum.example.org/s/{id}",
    "/posts/",
    "https://other.example.com/posts/{id}",
    "https://forum.example.org/handbook",
    "javascript:alert({id})",
    "file:///etc/{id}",
    "data:text/html,{id}",
    "https://forum.example.org/posts/../../../../etc/passwd",
    "/posts/{id}/../../../../../../etc/passwd",
    "https://forum.example.org:9090/posts/{id}/title",
    "http:///posts/{id}",
    "https:///posts/{id}",
    "https://forum.example.org:443/posts/{id}",
    "https://forum.example.org:99999/posts/{id}",
    "https://user:pw@Forum.Example.org/posts/{id}?a=1#f",
    "https:\\\\forum.example.org\\posts\\{id}",
    "//posts/{id}",
    "posts/{id}/x",
    "../s/{id}",
    "./posts/{id}",
    "?q={id}",
    "#frag{id}",
    "mailto:a{id}@example.org",
    "tel:+1{id}",
    "https://sub.example.org/x/{id}",
    "https://example.org.evil.com/{id}",
    "http://forum.example.org:80/a/b/../c/./d/{id}",
    "ftp://forum.example.org/posts/{id}",
    " \thttps://forum.example.org/posts/{id}",
    "//forum.example.org/posts/{id}/",
    "a/b/../../../posts/{id}",
    "/posts//{id}/./x/",
    "HTTPS://FORUM.EXAMPLE.ORG/S/{id}",
    "http://forum.example.org/out?url=https%3A%2F%2Fexample.com%2F{id}",
]


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def url_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``case_id, page_id, page_url, raw``: every page URL, every nav href
    of every page, and the template URLs instantiated per page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    tmpl = F.array(*[F.lit(t) for t in URL_TEMPLATES])
    t = (pages.select("page_id", "url", F.posexplode(tmpl).alias("i", "t"))
         .select((F.col("page_id") * 1000 + F.col("i")).alias("case_id"), "page_id",
                 F.col("url").alias("page_url"),
                 F.replace("t", F.lit("{id}"), F.col("page_id").cast("string")).alias("raw")))
    hrefs = (pages.select("page_id", "url",
                          F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("i", "raw"))
             .select((F.col("page_id") * 1000 + 100 + F.col("i")).alias("case_id"), "page_id",
                     F.col("url").alias("page_url"), "raw"))
    own = pages.select((F.col("page_id") * 1000 + 999).alias("case_id"), "page_id",
                       F.col("url").alias("page_url"), F.col("url").alias("raw"))
    return t.unionByName(hrefs).unionByName(own)


def url_cases_sql() -> str:
    arr = "[" + ", ".join(_sql_lit(t) for t in URL_TEMPLATES) + "]"
    return f"""
    SELECT page_id * 1000 + i - 1 AS case_id, page_id, url AS page_url,
           replace(t, '{{id}}', CAST(page_id AS VARCHAR)) AS raw
    FROM (SELECT page_id, url, unnest({arr}) AS t, generate_subscripts({arr}, 1) AS i FROM pages)
    UNION ALL
    SELECT page_id * 1000 + 100 + i - 1, page_id, url, h
    FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h,
                 generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS i FROM pages)
    UNION ALL
    SELECT page_id * 1000 + 999, page_id, url, url FROM pages
    """


#: Folders that a table of single files is dealt to.
FILE_BLOCKS = 256


def write_files(rows: DataFrame, path: str, suffix: str) -> None:
    """Write ``rows(key, text)`` as one file ``<n>/<key><suffix>`` for each key,
    a row ending in a line break, in folders of ``path`` (any file system that
    ``pyarrow.fs`` reaches). A folder is written by one task. Spark's own writer
    makes a folder for each key; with the same dealing it took about 40 ms of
    task time a file on a local file system, hardly any of it CPU."""
    block = F.pmod(F.xxhash64("key"), F.lit(FILE_BLOCKS))
    dealt = rows.select(F.col("key").cast("string"), "text", block.alias("block")).repartition(FILE_BLOCKS, "block")

    def write(part) -> None:
        fs, root = FileSystem.from_uri(path)
        name, out = None, None
        for row in part:
            at = f"{root}/{row.block}/{quote(row.key or '', safe='=')}{suffix}"
            if at != name:
                if out is None or name.rpartition("/")[0] != f"{root}/{row.block}":
                    fs.create_dir(f"{root}/{row.block}", recursive=True)
                if out is not None:
                    out.close()
                name, out = at, fs.open_output_stream(at)
            out.write((row.text or "").encode() + b"\n")
        if out is not None:
            out.close()

    dealt.sortWithinPartitions("block", "key").foreachPartition(write)
