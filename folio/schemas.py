"""Fixed table schemas of the engine (one module, all StructTypes)."""

from __future__ import annotations

from pyspark.sql import types as T

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

CRAWL = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("location", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("encoding", T.StringType()),
    T.StructField("body", T.BinaryType()),
])

# kind: 'document' (the virtual root, node_id 0), 'element', 'text',
# 'raw' (text content of script/style: excluded from text extraction),
# 'comment'.
NODES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("node_id", T.IntegerType()),
    T.StructField("parent_id", T.IntegerType()),
    T.StructField("end_id", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()),
])

LINKS = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("node_id", T.IntegerType()),
    T.StructField("href", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("anchor", T.StringType()),
    T.StructField("section", T.StringType()),
])

POSTS = T.StructType([
    T.StructField("ordinal", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("posted_date", T.StringType()),
    T.StructField("markdown", T.StringType()),
])

POST_CACHE = T.StructType([
    T.StructField("url_key", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("markdown", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("posted_date", T.StringType()),
])

FRAGMENTS = T.StructType([
    T.StructField("book_id", T.StringType()),
    T.StructField("ordinal", T.LongType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()),
])
