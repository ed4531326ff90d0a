"""Small helpers to write the DuckDB oracle SQL of the catalog."""

from __future__ import annotations


def html_decode_sql(x: str) -> str:
    """Decode the entities that occur in the test pages (``&quot; &copy;
    &middot; &amp;``, each also without ``;``). ``&amp;`` goes last so
    an encoded ampersand never starts a second decoding."""
    s = f"regexp_replace({x}, '&quot;?', '\"', 'g')"
    s = f"regexp_replace({s}, '&copy;?', '©', 'g')"
    s = f"regexp_replace({s}, '&middot;?', '·', 'g')"
    return f"regexp_replace({s}, '&amp;?', '&', 'g')"


def strip_tags_sql(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]*>', '', 'g')"
