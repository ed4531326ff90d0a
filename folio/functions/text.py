"""Text column functions (T1, T12, T13, M7) as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: Python str.splitlines() boundaries ----
LINE_BREAK_RE = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_lines_expr(text) -> Column:
    """Array of lines on Python line boundaries; a final line break
    yields no extra empty line and ``''`` yields no line."""
    arr = F.split(F.coalesce(_c(text), F.lit("")), LINE_BREAK_RE, -1)
    n = F.size(arr) - F.when(F.element_at(arr, -1) == "", F.lit(1)).otherwise(F.lit(0))
    return F.slice(arr, 1, n)


def clean_author(name) -> Column:
    """M7: drop ``<...>`` tags, collapse Unicode whitespace runs to one
    space, trim."""
    n = F.regexp_replace(_c(name), "<[^>]+>", "")
    n = F.regexp_replace(n, "(?U)\\s+", " ")
    return F.regexp_replace(n, "^ | $", "")


def iso_date_prefix(s) -> Column:
    """The first 10 characters (the reference keeps dates as text)."""
    return F.substring(_c(s), 1, 10)


def typed_date(s) -> Column:
    """T12 companion: DATE when the 10-character prefix parses, else NULL."""
    return F.try_to_date(iso_date_prefix(s), "yyyy-MM-dd")


def content_hash(s) -> Column:
    """Hex SHA-256 of the text (change detection, cache keys)."""
    return F.sha2(_c(s), 256)


def collapse_ws(s) -> Column:
    """Whitespace runs (space, tab, CR, LF) to one space, as HTML
    rendering does for ordinary text."""
    return F.regexp_replace(_c(s), "[ \\t\\r\\n\\f]+", " ")
