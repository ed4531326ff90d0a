"""DOM as a table (D1, D6, D20, J4) and the structural helpers every
other operator builds on.

``nodes`` rows are numbered in document (pre-order) order per page; an
element's subtree is the id interval ``[node_id, end_id]``. So:

* "descendant of" is ``node_id BETWEEN a.node_id AND a.end_id`` on the
  same page (J4), found by a sweep over open and close events;
* the text length under an element is a difference of a running sum
  (``text_before``) taken at ``end_id`` and at ``node_id`` -- a window and
  an equi-join instead of an ancestor climb;
* "inside any of a set of subtrees" is a comparison with the furthest end
  of those opened so far, as subtrees nest.

All joins are keyed on ``page_id`` (plus ``node_id`` where possible), so a
page never spans tasks except through AQE skew splitting; page size is
bounded by the admission cap (S2). ``page_id`` must therefore be unique and
not null; ``parse_pages`` gives keys to pages without such an id.
"""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio import schemas
from folio.operators.parser import parse_document
from folio.session import materialize

_ARROW_NODES = pa.schema([
    ("page_id", pa.int64()),
    ("node_id", pa.int32()),
    ("parent_id", pa.int32()),
    ("end_id", pa.int32()),
    ("depth", pa.int32()),
    ("kind", pa.string()),
    ("tag", pa.string()),
    ("classes", pa.list_(pa.string())),
    ("attrs", pa.map_(pa.string(), pa.string())),
    ("text", pa.string()),
])


# output batches are flushed at this many node rows or characters of HTML, and
# pages leave an input batch one at a time: beside that batch a task's Python
# holds a few pages, however many rows it has
_MAX_NODES_PER_BATCH, _MAX_CHARS_PER_BATCH = 20_000, 4_000_000


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node rows of ``(page_id, html)`` batches; every page has its rows,
    those with a null id too."""
    def empty() -> dict[str, list]:
        return {f.name: [] for f in _ARROW_NODES}

    for batch in batches:
        cols, chars = empty(), 0
        for pid, doc in zip(batch.column("page_id"), batch.column("html")):
            pid, doc = pid.as_py(), doc.as_py()
            b = parse_document(doc)
            n = len(b.kind)
            cols["page_id"].extend([pid] * n)
            cols["node_id"].extend(range(n))
            cols["parent_id"].extend(b.parent_id)
            cols["end_id"].extend(b.end_id)
            cols["depth"].extend(b.depth)
            cols["kind"].extend(b.kind)
            cols["tag"].extend(b.tag)
            cols["classes"].extend(b.classes)
            cols["attrs"].extend(b.attrs)
            cols["text"].extend(b.text)
            chars += len(doc or "")
            if len(cols["page_id"]) >= _MAX_NODES_PER_BATCH or chars >= _MAX_CHARS_PER_BATCH:
                yield pa.RecordBatch.from_pydict(cols, schema=_ARROW_NODES)
                cols, chars = empty(), 0
        if cols["page_id"]:
            yield pa.RecordBatch.from_pydict(cols, schema=_ARROW_NODES)


def html_nodes(pages: DataFrame) -> DataFrame:
    """Parse ``pages(page_id, html)`` into the ``nodes`` table.

    The parse runs once per page inside executor tasks via ``mapInArrow``
    (Arrow batches in and out, no per-row serialisation). Filters on
    ``pages`` (e.g. URL rules) must be applied before this call: the parse
    is opaque to pushdown.
    """
    return pages.select("page_id", "html").mapInArrow(_parse_batches, schemas.NODES)


def parse_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D1 for pages whose ``page_id`` may be null or repeated: ``(rows, nodes)``.

    The parse gives each input row a key of its own (partition and place) and
    writes it once, with the row's other columns, into the same table as its
    nodes. ``nodes`` has that key as ``page_id``, so every operator sees one page
    per input row; ``rows`` is ``page_key`` and the input columns but ``html``.
    """
    own = [c for c in pages.columns if c != "html"]
    packed = pages.select("html", F.struct(*[F.col(c) for c in own]).alias("_row"))
    row_type = packed.schema["_row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, row = pa.array(range(base, base + n), pa.int64()), batch.column("_row")
            base += n
            head = [keys if f.name == "page_id" else pa.array(["page"] * n) if f.name == "kind" else pa.nulls(n, f.type) for f in _ARROW_NODES]
            yield pa.RecordBatch.from_arrays([*head, row], [*_ARROW_NODES.names, "_row"])
            for part in _parse_batches(iter([pa.RecordBatch.from_arrays([keys, batch.column("html")], ["page_id", "html"])])):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.nulls(part.num_rows, row.type)], [*_ARROW_NODES.names, "_row"])

    parsed = materialize(packed.mapInArrow(run, T.StructType([*schemas.NODES.fields, T.StructField("_row", row_type)])))
    rows = parsed.where("kind = 'page'").select(F.col("page_id").alias("page_key"), *[F.col("_row")[c].alias(c) for c in own])
    nodes = parsed.where("kind != 'page'").drop("_row")
    nodes._table_path = parsed._table_path  # for drop_table
    return rows, nodes


def elements(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("kind") == "element")


def attr(name: str) -> Column:
    """Attribute value (NULL when absent)."""
    return F.col("attrs").getItem(name)


def has_class_token(tokens, mode: str = "exact") -> Column:
    """P11 ``class_matches``: any class token matches.

    mode ``exact``: whole token in ``tokens``; ``icontains``: token contains
    the (lower-case) pattern case-insensitively; ``contains``: case
    sensitive substring.
    """
    if isinstance(tokens, str):
        tokens = [tokens]
    if mode == "exact":
        return F.coalesce(F.exists("classes", lambda c: c.isin(list(tokens))), F.lit(False))
    if mode == "icontains":
        return F.coalesce(F.exists("classes", lambda c: _any([F.lower(c).contains(t.lower()) for t in tokens])),
                          F.lit(False))
    if mode == "contains":
        return F.coalesce(F.exists("classes", lambda c: _any([c.contains(t) for t in tokens])), F.lit(False))
    raise ValueError(mode)


def _any(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def with_text_offsets(nodes: DataFrame) -> DataFrame:
    """Add ``text_before``: total length of visible text (kind='text')
    at node ids <= this node on the page (a per-page running sum), and
    ``next_text``: the first non-empty visible text node at or after this
    node (a reverse running min). One window pass per page."""
    w = Window.partitionBy("page_id").orderBy("node_id")
    tlen = F.when(F.col("kind") == "text", F.length("text")).otherwise(F.lit(0))
    # (lengths are taken before the windows, so that readers without the text don't shuffle it)
    return (nodes.withColumn("_len", tlen.cast("long"))
            .withColumn("text_before", F.sum("_len").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("next_text", F.min(F.when(F.col("_len") > 0, F.col("node_id"))).over(w.rowsBetween(0, Window.unboundedFollowing)))
            .drop("_len"))


def subtree_text_length(nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """A4: length of visible descendant text for each candidate element.

    ``candidates(page_id, node_id, end_id, ...)``; returns the candidates
    with ``text_len`` and ``first_text`` (first non-empty visible text node
    at or after the element). Computed as ``text_before[end_id] -
    text_before[node_id]`` -- one running-sum window over the page and two
    equi-joins on (page_id, node_id), linear in the page size.
    """
    off = with_text_offsets(nodes.select("page_id", "node_id", "kind", "text"))
    off = off.select("page_id", "node_id", "text_before", "next_text")
    at_start = off.select("page_id", "node_id", F.col("text_before").alias("_t0"),
                          F.col("next_text").alias("first_text"))
    at_end = off.select("page_id", F.col("node_id").alias("end_id"), F.col("text_before").alias("_t1"))
    return (candidates
            .join(at_start, ["page_id", "node_id"], "inner")
            .join(at_end, ["page_id", "end_id"], "inner")
            .withColumn("text_len", (F.col("_t1") - F.col("_t0")).cast("long"))
            .drop("_t0", "_t1"))


def open_levels(nodes: DataFrame, ancestors: DataFrame, include_self: bool) -> DataFrame:
    """One ordered pass over each page's events: ``page_id, _pos, _k, _node,
    _anc, _level``. Every row of ``ancestors`` opens before (``include_self``) or
    after its own node and closes at the end of its subtree; ``_level`` is how
    many are open. Subtrees nest, so an element that is open at level ``l`` is
    the last one opened there."""
    of_node = F.struct(*[F.col(c) for c in nodes.columns])
    of_anc = F.struct(*[F.col(c) for c in ancestors.columns])
    none = lambda df, c: F.lit(None).cast(df.select(c.alias("_x")).schema["_x"].dataType)
    seen = nodes.select("page_id", F.col("node_id").alias("_pos"), F.lit(1).alias("_k"), of_node.alias("_node"), none(ancestors, of_anc).alias("_anc"), F.lit(0).alias("_d"))
    event = lambda pos, k, anc, d: F.struct(F.col(pos).alias("_pos"), F.lit(k).alias("_k"), anc.alias("_anc"), F.lit(d).alias("_d"))
    both = F.inline(F.array(event("node_id", 0 if include_self else 2, of_anc, 1), event("end_id", 3, none(ancestors, of_anc), -1)))
    events = ancestors.select("page_id", none(nodes, of_node).alias("_node"), both).select(*seen.columns)
    w = Window.partitionBy("page_id").orderBy("_pos", "_k").rowsBetween(Window.unboundedPreceding, 0)
    return seen.unionByName(events).withColumn("_level", F.sum("_d").over(w).cast("int")).drop("_d")


def descendants_of(nodes: DataFrame, ancestors: DataFrame, how: str = "inner",
                   include_self: bool = True) -> DataFrame:
    """Rows of ``nodes`` inside the subtrees of ``ancestors``.

    ``ancestors(page_id, node_id, end_id, ...)`` columns other than the key are
    carried with an ``anc_`` prefix; a node in several subtrees is a row for each.
    ``how='left_anti'`` gives removal, ``'left_semi'`` containment.

    A sweep over open and close events per page, not a join: a node's level says
    how many subtrees it is in, and its subtree at level ``l`` is the last one
    opened there. The work is that of the nodes and of the result, however many
    subtrees a page has. Rows without a page are in no subtree.
    """
    swept = open_levels(nodes.where("page_id IS NOT NULL") if how != "left_anti" else nodes, ancestors.where("page_id IS NOT NULL"), include_self)
    # (the sweep's own page_id: what follows by page needs no other exchange)
    own = [F.col(c) if c == "page_id" else F.col("_node")[c].alias(c) for c in nodes.columns]
    if how in ("left_semi", "left_anti"):
        return swept.where((F.col("_k") == 1) & ((F.col("_level") > 0) if how == "left_semi" else (F.col("_level") == 0))).select(*own)
    opened = F.col("_anc").isNotNull()
    w = Window.partitionBy("page_id", "_l").orderBy("_pos", "_k").rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(opened, F.array("_level")).when(F.col("_level") > 0, F.sequence(F.lit(1), F.col("_level")))
    return (swept.where("_k < 3 AND (_k != 1 OR _level > 0)").withColumn("_l", F.explode(level))
            .withColumn("_anc", F.last("_anc", ignorenulls=True).over(w)).where("_k = 1")
            .select(*own, *[F.col("_anc")[c].alias("anc_" + c) for c in ancestors.columns if c != "page_id"]))


def page_texts(nodes: DataFrame, strip: bool = True) -> DataFrame:
    """Per page the texts of its nodes as an array ``_texts``, node_id being
    the place (``''`` for nodes that are no text). ``nodes`` is the whole node
    table of the pages."""
    text = F.when(F.col("kind") == "text", py_strip(F.col("text")) if strip else F.col("text"))
    own = nodes.select("page_id", F.struct("node_id", F.coalesce(text, F.lit("")).alias("t")).alias("_x"))
    return own.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["t"]).alias("_texts"))


def node_text(nodes: DataFrame, scopes: DataFrame, strip: bool = True,
              out: str = "text") -> DataFrame:
    """Text of each scope's subtree, per ``(page_id, node_id)`` of
    ``scopes``. Stripped form trims each text node and joins with no
    separator; unstripped form concatenates raw text. Scopes without text
    get ``''``. A subtree is a slice of its page's texts, so the work is the
    size of the subtrees; there is no text x scope join."""
    sc = scopes.select("page_id", "node_id", "end_id")
    own = F.slice("_texts", F.col("node_id") + 1, F.col("end_id") - F.col("node_id") + 1)
    return (sc.join(page_texts(nodes, strip), "page_id", "left")
            .select("page_id", "node_id", "end_id", F.coalesce(F.array_join(own, ""), F.lit("")).alias(out)))


# Python str.strip() removes Unicode whitespace, including the ASCII
# separators \x1c-\x1f and \x85; Spark's trim() removes only spaces.
_PY_WS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def py_strip(c: Column) -> Column:
    """Looks at the ends of the text only; a regular expression would try each
    of its spaces."""
    return F.btrim(c, F.lit(_PY_WS))


def page_links(nodes: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """Every ``a`` with an ``href`` (inside ``scopes`` if given), in
    document order, with its stripped anchor text."""
    anchors = elements(nodes).where((F.col("tag") == "a") & F.col("attrs").getItem("href").isNotNull())
    if scopes is not None:
        anchors = descendants_of(anchors, scopes.select("page_id", "node_id", "end_id"), "left_semi")
    anchors = anchors.select("page_id", "node_id", "end_id", F.col("attrs").getItem("href").alias("href"))
    own = F.slice("_texts", F.col("node_id") + 1, F.col("end_id") - F.col("node_id") + 1)
    return (anchors.join(page_texts(nodes), "page_id", "left")
            .select("page_id", "node_id", "end_id", "href", F.coalesce(F.array_join(own, ""), F.lit("")).alias("anchor")))


def first_match(df: DataFrame, by: str | list[str] = "page_id", order: str | list = "node_id") -> DataFrame:
    """K3: the first row per group in document order (top-1 window)."""
    by = [by] if isinstance(by, str) else by
    order = [order] if isinstance(order, (str, Column)) else order
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
