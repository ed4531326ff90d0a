"""Markdown document operators.

All of these are local to one document, so each is one projection over
arrays of lines: split, fold the fence lines to spans, test each line
against the spans, join. Nothing is exploded and re-gathered, and no
shuffle is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import split_lines_expr

_PY_LSTRIP = "^[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
HEADING_RE = "^( {0,3})(#+)( .*)$"


def split_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, pos, line`` on Python line boundaries (0-based pos)."""
    return docs.select(key, F.posexplode(split_lines_expr(F.col(text))).alias("pos", "line"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often ``body``
    (or a lambda inside it) uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fence_spans(lines: Column) -> Column:
    """Inclusive ``[s, e]`` position spans of fenced code in an array of
    lines. Outside a block, a line whose left-stripped text starts with
    three backticks or tildes opens one; inside, only the same 3-char
    marker closes it; an unclosed block runs to the end."""
    marked = F.transform(lines, lambda x, i: F.struct(i.alias("p"), F.substring(F.regexp_replace(x, _PY_LSTRIP, ""), 1, 3).alias("m")))
    fences = F.filter(marked, lambda f: f["m"].isin("```", "~~~"))
    init = F.struct(F.lit(None).cast("string").alias("m"), F.lit(None).cast("int").alias("o"),
                    F.array().cast("array<struct<s:int,e:int>>").alias("spans"))

    def step(acc, f):
        opening = acc["m"].isNull()
        closing = ~opening & (f["m"] == acc["m"])
        return F.struct(
            F.when(opening, f["m"]).when(closing, F.lit(None).cast("string")).otherwise(acc["m"]).alias("m"),
            F.when(opening, f["p"]).when(closing, F.lit(None).cast("int")).otherwise(acc["o"]).alias("o"),
            F.when(closing, F.concat(acc["spans"], F.array(F.struct(acc["o"].alias("s"), f["p"].alias("e")))))
            .otherwise(acc["spans"]).alias("spans"))

    def finish(acc):
        return F.when(acc["m"].isNotNull(),
                      F.concat(acc["spans"], F.array(F.struct(acc["o"].alias("s"), F.lit(2147483647).alias("e")))))\
            .otherwise(acc["spans"])

    return F.aggregate(fences, init, step, finish)


def _heading_parts(text) -> Column:
    """Array of ``line, in_code, indent, level, rest``; the last three are
    NULL unless the line is an ATX heading outside fenced code."""
    def parts(both):
        def one(line, i):
            in_code = F.exists(both["spans"], lambda s: (i >= s["s"]) & (i <= s["e"]))
            is_h = ~in_code & line.rlike(HEADING_RE)
            return F.struct(line.alias("line"), in_code.alias("in_code"),
                            F.when(is_h, F.regexp_extract(line, HEADING_RE, 1)).alias("indent"),
                            F.when(is_h, F.length(F.regexp_extract(line, HEADING_RE, 2))).alias("level"),
                            F.when(is_h, F.regexp_extract(line, HEADING_RE, 3)).alias("rest"))
        return F.transform(both["lines"], one)
    split = split_lines_expr(F.col(text) if isinstance(text, str) else text)
    return _let(split, lambda lines: _let(F.struct(lines.alias("lines"), fence_spans(lines).alias("spans")), parts))


def code_fence_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """T2 per document: one row ``key, s, e`` for each span."""
    spans = _let(split_lines_expr(F.col(text)), fence_spans)
    return docs.select(key, F.inline(spans))


def heading_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines with ``in_code`` and, outside code, the ATX heading parts:
    ``indent``, ``level`` (number of #), ``rest`` (from the space on)."""
    return (docs.select(key, F.posexplode(_heading_parts(text)).alias("pos", "h"))
            .select(key, "pos", "h.line", "h.in_code", "h.indent", "h.level", "h.rest"))


def demoted(text, levels: int = 2) -> Column:
    """T3 as a column: outside fenced code, ATX headings (0-3 leading spaces,
    ``#`` run, then a space) get ``min(n + levels, 6)`` hashes, indent kept;
    everything else unchanged. Lines re-joined with ``\\n``."""
    def line(h):
        marks = F.repeat(F.lit("#"), F.least(h["level"] + levels, F.lit(6)))
        return F.when(h["level"].isNotNull(), F.concat(h["indent"], marks, h["rest"])).otherwise(h["line"])
    return F.array_join(F.transform(_heading_parts(text), line), "\n")


def demote_headings(docs: DataFrame, levels: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """T3 per document: ``key, text``."""
    return docs.select(key, demoted(text, levels).alias(text))


def toc(docs: DataFrame, depth: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Code-aware headings down to ``depth``: ``key, pos, level,
    title`` (title = heading text, trimmed)."""
    return (heading_lines(docs, key, text).where(F.col("level") <= depth)
            .select(key, "pos", F.col("level").cast("int").alias("level"), F.trim(F.col("rest")).alias("title")))


def split_chapters(docs: DataFrame, level: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Split at headings of level <= ``level`` outside code; chapters
    are numbered from 1, chapter 0 is the text before the first heading (if
    any); each chapter's lines re-joined in order."""
    def chapters(both):
        def one(k, i):
            last = F.when(i + 1 < F.size(both["starts"]), F.element_at(both["starts"], i + 2)).otherwise(F.size(both["lines"]))
            own = F.element_at(both["lines"], k + 1)
            return F.struct((i + both["shift"]).alias("chapter_no"), F.when(own["level"] <= level, F.trim(own["rest"])).otherwise(F.lit("")).alias("title"),
                            F.array_join(F.transform(F.slice(both["lines"], k + 1, last - k), lambda h: h["line"]), "\n").alias("text"))
        return F.transform(both["starts"], one)

    def begin(lines):
        heads = F.filter(F.transform(lines, lambda h, i: F.when(h["level"] <= level, i)), lambda x: x.isNotNull())
        lead = (F.size(lines) > 0) & ~F.coalesce(F.element_at(lines, 1)["level"] <= level, F.lit(False))
        none = F.array().cast("array<int>")
        starts = F.concat(F.when(lead, F.array(F.lit(0))).otherwise(none), heads)
        return F.when(F.size(lines) > 0, _let(F.struct(lines.alias("lines"), starts.alias("starts"),
                                                       F.when(lead, 0).otherwise(1).alias("shift")), chapters))
    return docs.select(key, F.inline(_let(_heading_parts(text), begin)))
