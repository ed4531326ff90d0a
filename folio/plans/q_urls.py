"""Registered URL queries (P1-P6, P9, P13, P14, S6) and their oracles.

The oracle side re-states each URL rule in DuckDB SQL over the same
stand-in cases (``standins.url_cases``), so both engines compute from
the raw strings independently.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import urls
from folio.operators import dom
from folio.plans.catalog import register
from folio.plans.standins import url_cases, url_cases_sql
from folio.profile import DEFAULT_PROFILE as PR

# ---------------------------------------------------------------- DuckDB side
_SCHEME_RE = "^([A-Za-z][A-Za-z0-9+.\\-]*):"


def _parts_ctes(src: str, col: str, pfx: str) -> list[str]:
    """CTEs adding URL parts of ``col`` with prefix ``pfx`` to ``src``."""
    p = pfx
    return [
        f"{p}a AS (SELECT *, regexp_replace(regexp_replace({col}, '[\\t\\r\\n]', '', 'g'), '^[\\x00-\\x20]+', '') AS {p}c FROM {src})",
        f"{p}b AS (SELECT *, lower(regexp_extract({p}c, '{_SCHEME_RE}', 1)) AS {p}scheme FROM {p}a)",
        f"{p}d AS (SELECT *, CASE WHEN {p}scheme = '' THEN {p}c ELSE regexp_replace({p}c, '{_SCHEME_RE}', '') END AS {p}rest FROM {p}b)",
        f"{p}e AS (SELECT *, regexp_extract({p}rest, '#(.*)$', 1) AS {p}fragment, contains({p}rest, '#') AS {p}has_frag,"
        f" regexp_replace({p}rest, '#.*$', '') AS {p}nofrag FROM {p}d)",
        f"{p}f AS (SELECT *, starts_with({p}nofrag, '//') AS {p}has_auth FROM {p}e)",
        f"{p}g AS (SELECT *, CASE WHEN {p}has_auth THEN regexp_extract({p}nofrag, '^//([^/?]*)', 1) ELSE '' END AS {p}authority,"
        f" CASE WHEN {p}has_auth THEN regexp_replace({p}nofrag, '^//[^/?]*', '') ELSE {p}nofrag END AS {p}after FROM {p}f)",
        f"{p}h AS (SELECT *, regexp_extract({p}after, '\\?(.*)$', 1) AS {p}query, contains({p}after, '?') AS {p}has_query,"
        f" regexp_replace({p}after, '\\?.*$', '') AS {p}path,"
        f" regexp_replace({p}authority, '^.*@', '') AS {p}hostinfo FROM {p}g)",
        f"{p}i AS (SELECT *, lower(CASE WHEN starts_with({p}hostinfo, '[') THEN regexp_extract({p}hostinfo, '^\\[([^\\]]*)\\]', 1)"
        f" ELSE regexp_extract({p}hostinfo, '^([^:]*)', 1) END) AS {p}host,"
        f" CASE WHEN starts_with({p}hostinfo, '[') THEN regexp_extract({p}hostinfo, '^\\[[^\\]]*\\]:(.*)$', 1)"
        f" ELSE regexp_extract({p}hostinfo, '^[^:]*:(.*)$', 1) END AS {p}port FROM {p}h)",
        f"{p}j AS (SELECT *, CASE WHEN {p}port = '' THEN 'none'"
        f" WHEN regexp_full_match({p}port, '[0-9]+') AND length(ltrim({p}port, '0')) <= 5"
        f" AND TRY_CAST({p}port AS BIGINT) <= 65535 THEN 'ok' ELSE 'bad' END AS {p}port_status FROM {p}i)",
        f"{p} AS (SELECT *, CASE WHEN {p}port_status = 'ok' THEN CAST({p}port AS INTEGER) END AS {p}port_value FROM {p}j)",
    ]


def _norm_path_sql(path: str) -> str:
    stack = (f"list_reduce(list_filter(string_split({path}, '/'), lambda s: s <> '' AND s <> '.'),"
             f" lambda acc, s: CASE WHEN s <> '..' THEN list_append(acc, s)"
             f" WHEN len(acc) > 0 AND acc[-1] <> '..' THEN acc[1:len(acc) - 1]"
             f" WHEN starts_with({path}, '/') THEN acc ELSE list_append(acc, s) END, []::VARCHAR[])")
    prefix = (f"(CASE WHEN starts_with({path}, '//') AND NOT starts_with({path}, '///') THEN '//'"
              f" WHEN starts_with({path}, '/') THEN '/' ELSE '' END)")
    body = f"array_to_string({stack}, '/')"
    return f"(CASE WHEN {prefix} = '' AND {body} = '' THEN '.' ELSE {prefix} || {body} END)"


def _remove_dots_sql(path: str) -> str:
    segs = f"string_split({path}, '/')"
    body = f"list_filter({segs}[2:], lambda s, i: s <> '' OR i = len({segs}) - 1)"
    stack = (f"list_reduce(list_prepend('.', {body}), lambda acc, s: CASE WHEN s = '.' THEN acc"
             f" WHEN s = '..' THEN acc[1:len(acc) - 1] ELSE list_append(acc, s) END, []::VARCHAR[])")
    joined = f"('/' || array_to_string({stack}, '/'))"
    trailing = f"({segs}[-1] IN ('.', '..'))"
    return f"(CASE WHEN {trailing} AND NOT ends_with({joined}, '/') THEN {joined} || '/' ELSE {joined} END)"


def url_oracle(select: str, extra_ctes: list[str] | None = None, src_col: str = "u") -> str:
    ctes = [f"cases AS ({url_cases_sql()})",
            "fixed AS (SELECT *, replace(raw, '\\', '/') AS u FROM cases)"]
    ctes += _parts_ctes("fixed", src_col, "x")
    ctes += extra_ctes or []
    return "WITH " + ",\n".join(ctes) + "\n" + select


_HOSTS = ", ".join(f"'{h}'" for h in PR.post_hosts)
_NAMED = ", ".join(f"'{h}'" for h in PR.post_hosts if h)
_PORTS = ", ".join(str(p) for p in PR.allowed_ports)
_IS_POST = (
    f"COALESCE((contains(u, '/posts/') OR contains(u, '/s/')) AND xscheme IN ('http', 'https', '')"
    f" AND NOT (xscheme <> '' AND xhost = '') AND xhost IN ({_HOSTS})"
    f" AND (xhost NOT IN ({_NAMED}) OR xport_status = 'none' OR (xport_status = 'ok' AND xport_value IN ({_PORTS})))"
    f" AND (starts_with(np, '/posts/') OR starts_with(np, '/s/')), false)")
_NP_CTE = f"np AS (SELECT *, CASE WHEN starts_with(n0, '/') THEN n0 ELSE '/' || n0 END AS np FROM (SELECT *, {_norm_path_sql('xpath')} AS n0 FROM x))"


# ---------------------------------------------------------------- Spark side
def _cases(spark, sf_dir):
    return url_cases(spark, sf_dir)


@register("p1_fix_backslashes", url_oracle("SELECT case_id, u AS fixed FROM fixed"))
def p1_fix_backslashes(spark, sf_dir):
    """Backslashes to slashes."""
    return _cases(spark, sf_dir).select("case_id", urls.fix_backslashes("raw").alias("fixed"))


@register("p2_url_parts", url_oracle(
    "SELECT case_id, xscheme AS scheme, xhost AS host, xport AS port, xpath AS path, xquery AS query,"
    " xfragment AS fragment FROM x"))
def p2_url_parts(spark, sf_dir):
    """URL components (host lower-cased, user-info dropped)."""
    p = urls.url_parts(urls.fix_backslashes("raw"))
    return _cases(spark, sf_dir).select(
        "case_id", p["scheme"].alias("scheme"), p["host"].alias("host"), p["port"].alias("port"),
        p["path"].alias("path"), p["query"].alias("query"), p["fragment"].alias("fragment"))


@register("p5_normalize_path", url_oracle(f"SELECT case_id, xpath AS path, {_norm_path_sql('xpath')} AS norm_path FROM x"))
def p5_normalize_path(spark, sf_dir):
    """P5: POSIX path normalisation of every case's path."""
    p = urls.url_parts(urls.fix_backslashes("raw"))
    return _cases(spark, sf_dir).select("case_id", p["path"].alias("path"),
                                        urls.normalize_path(p["path"]).alias("norm_path"))


@register("p4_is_post_url", url_oracle(f"SELECT case_id, raw, {_IS_POST} AS is_post FROM np", [_NP_CTE]))
def p4_is_post_url(spark, sf_dir):
    """post/sequence URL predicate."""
    return _cases(spark, sf_dir).select("case_id", "raw", urls.is_post_url("raw").alias("is_post"))


_NETLOC = "xhost || CASE WHEN xport_status = 'ok' THEN ':' || CAST(xport_value AS VARCHAR) ELSE '' END"
_VALID_ERR = (
    f"CASE WHEN xscheme NOT IN ('http', 'https') THEN 'Unsafe URL scheme: ' || xscheme"
    f" WHEN NOT (xhost = '{PR.domain_suffix}' OR ends_with(xhost, '.{PR.domain_suffix}')) THEN 'Unsafe URL domain: ' || xhost"
    f" WHEN xport_status = 'bad' THEN 'Invalid URL port: ' || xport"
    f" WHEN NOT (xport_status = 'none' OR xport_value IN ({_PORTS})) THEN 'Unsafe URL port: ' || CAST(xport_value AS VARCHAR) END")
_REBUILT = (f"xscheme || '://' || {_NETLOC} || xpath || CASE WHEN regexp_matches(xc, '^[^#]*\\?') THEN '?' || xquery ELSE '' END"
            f" || CASE WHEN xhas_frag THEN '#' || xfragment ELSE '' END")


@register("p3_validate_url", url_oracle(
    f"SELECT case_id, CASE WHEN ({_VALID_ERR}) IS NULL THEN {_REBUILT} END AS safe_url, {_VALID_ERR} AS error FROM x"))
def p3_validate_url(spark, sf_dir):
    """Safe-URL validation with the reason as data."""
    c = _cases(spark, sf_dir).withColumn("v", urls.validate_url("raw")).withColumns({"safe_url": F.col("v.url"), "error": F.col("v.error")})
    return c.select("case_id", "safe_url", "error")


@register("s6_url_key", url_oracle("SELECT case_id, sha256(raw) AS url_key FROM cases"))
def s6_url_key(spark, sf_dir):
    """Hex SHA-256 cache key of the URL."""
    return _cases(spark, sf_dir).select("case_id", urls.url_key("raw").alias("url_key"))


@register("p14_first_non_empty", url_oracle(
    "SELECT case_id, COALESCE(NULLIF(xquery, ''), NULLIF(xfragment, ''), NULLIF(xhost, ''), NULLIF(raw, '')) AS first_part FROM x"))
def p14_first_non_empty(spark, sf_dir):
    """Ordered fallback -- query, else fragment, else host, else the raw URL."""
    p = urls.url_parts(urls.fix_backslashes("raw"))
    return _cases(spark, sf_dir).select(
        "case_id", urls.first_non_empty(p["query"], p["fragment"], p["host"], F.col("raw")).alias("first_part"))


def _resolve_ctes(ref_col: str, base_col: str) -> list[str]:
    """DuckDB RFC 3986 join of ``ref_col`` onto ``base_col`` (columns of x)."""
    out = []
    out += [f"r0 AS (SELECT *, {ref_col} AS rref, {base_col} AS rbase FROM x)"]
    out += _parts_ctes("r0", "rref", "r")
    out += _parts_ctes("r", "rbase", "b")
    merged = ("CASE WHEN bhas_auth AND bpath = '' THEN '/' || rpath "
              "ELSE regexp_replace(bpath, '[^/]*$', '') || rpath END")
    q = lambda hq, qq: f"CASE WHEN {hq} THEN '?' || {qq} ELSE '' END"
    fr = "CASE WHEN rhas_frag THEN '#' || rfragment ELSE '' END"
    bq = "contains(regexp_replace(bc, '#.*$', ''), '?')"
    rq = "contains(regexp_replace(rc, '#.*$', ''), '?')"
    pre = "CASE WHEN bscheme <> '' THEN bscheme || ':' ELSE '' END"
    auth = "CASE WHEN bhas_auth THEN '//' || bauthority ELSE '' END"
    res = (
        f"CASE WHEN rbase IS NULL OR rbase = '' THEN rc"
        f" WHEN COALESCE(rref, '') = '' THEN rbase"
        f" WHEN NOT (rscheme = '' OR rscheme = bscheme) THEN rc"
        f" WHEN rhas_auth THEN {pre} || '//' || rauthority || rpath || {q(rq, 'rquery')} || {fr}"
        f" WHEN rpath = '' THEN {pre} || {auth} || bpath || (CASE WHEN {rq} THEN '?' || rquery WHEN {bq} THEN '?' || bquery ELSE '' END) || {fr}"
        f" ELSE {pre} || {auth} || (CASE WHEN starts_with(rpath, '/') THEN {_remove_dots_sql('rpath')}"
        f" ELSE {_remove_dots_sql('(' + merged + ')')} END) || {q(rq, 'rquery')} || {fr} END")
    out += [f"res AS (SELECT *, {res} AS resolved FROM b)"]
    return out


@register("p6_resolve_url", url_oracle("SELECT case_id, resolved FROM res", _resolve_ctes("raw", "page_url")))
def p6_resolve_url(spark, sf_dir):
    """RFC 3986 resolution of every case against its page URL."""
    return _cases(spark, sf_dir).select("case_id", urls.resolve_url("raw", "page_url").alias("resolved"))


_ABS_KEEP = ("(starts_with(raw, 'http://') OR starts_with(raw, 'https://') OR starts_with(raw, '#')"
             " OR starts_with(raw, 'mailto:') OR starts_with(raw, 'tel:') OR rscheme <> '')")


@register("p9_absolutize_link", url_oracle(
    f"SELECT case_id, CASE WHEN {_ABS_KEEP} THEN raw ELSE resolved END AS absolute FROM res",
    _resolve_ctes("raw", f"'{PR.base_url}'")))
def p9_absolutize_link(spark, sf_dir):
    """Links made absolute against the site base URL unless they
    already carry a scheme or are fragments/mailto/tel."""
    return _cases(spark, sf_dir).select("case_id", urls.absolutize_link("raw").alias("absolute"))




@register("p8_unwrap_redirect", url_oracle(
    "SELECT case_id, CASE WHEN contains(raw, '/out') AND xpath = '/out'"
    " AND regexp_extract(xquery, '(?:^|&)url=([^&]*)', 1) <> ''"
    " THEN url_decode(replace(regexp_extract(xquery, '(?:^|&)url=([^&]*)', 1), '+', ' ')) ELSE raw END AS unwrapped"
    " FROM x"))
def p8_unwrap_redirect(spark, sf_dir):
    """Redirect links (path exactly ``/out``, any host) replaced by
    their first ``url`` parameter, query-decoded; others unchanged."""
    return _cases(spark, sf_dir).select("case_id", urls.unwrap_redirect("raw").alias("unwrapped"))


_WS = "[\\s\\x00-\\x1f\\x7f-\\x{9f}]"
_DANGER = " OR ".join(f"starts_with(t, '{s}')" for s in PR.dangerous_schemes)


@register("p7_has_dangerous_scheme", url_oracle(
    f"SELECT case_id, raw, COALESCE({_DANGER}, false) AS dangerous FROM ("
    f" SELECT case_id, raw, CASE WHEN contains(raw, '%') OR contains(raw, '&') OR regexp_matches(raw, '{_WS}')"
    f" THEN lower(regexp_replace(url_decode(raw), '{_WS}', '', 'g')) ELSE lower(raw) END AS t FROM cases)"))
def p7_has_dangerous_scheme(spark, sf_dir):
    """Entity-decode, percent-decode, drop whitespace and control
    characters, lower-case, then test the dangerous scheme prefixes."""
    from folio.functions.entities import with_unescaped
    c = with_unescaped(_cases(spark, sf_dir), "raw", "_dec")
    return c.select("case_id", "raw", F.coalesce(urls.has_dangerous_scheme("raw", decoded=F.col("_dec")),
                                                 F.lit(False)).alias("dangerous"))


# redirect links of every document: blank, repeated and encoded names, a stray %
_OUT = "CASE doc_id % 5 WHEN 0 THEN '/out?url=&url=' WHEN 1 THEN '/out?%75rl=' WHEN 2 THEN '/out?a=b&url=50%&url=' WHEN 3 THEN '/out?url' ELSE '/out?x=1&url=' END"


@register("p8_redirect_pairs", f"""
SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN '50%' WHEN 3 THEN '/out?urlhttps%3A%2F%2Fx.example%2F' || CAST(doc_id AS VARCHAR) || '+z'
               ELSE 'https://x.example/' || CAST(doc_id AS VARCHAR) || ' z' END AS target FROM documents
""")
def p8_redirect_pairs(spark, sf_dir):
    """The query is read as pairs; blank values are skipped, names and
    values decoded, a stray ``%`` kept."""
    from folio.sources.pages import table
    link = F.concat(F.expr(_OUT), F.lit("https%3A%2F%2Fx.example%2F"), F.col("doc_id").cast("string"), F.lit("+z"))
    return table(spark, sf_dir, "documents").select("doc_id", urls.unwrap_redirect(link).alias("target"))


_KEEP = ("CASE doc_id % 5 WHEN 0 THEN '/posts/' WHEN 1 THEN 'https://other.example.com/posts/' WHEN 2 THEN 'http:///posts/'"
         " WHEN 3 THEN '/s/../handbook/' ELSE '/a/../posts/' END")


@register("p13_keep_link", "SELECT doc_id, doc_id % 5 IN (0, 4) AND doc_id % 3 <> 0 AS kept FROM documents")
def p13_keep_link(spark, sf_dir):
    """Href and anchor text present, target a post of the site."""
    from folio.sources.pages import table
    href = F.concat(F.expr(_KEEP), F.col("doc_id").cast("string"), F.lit("/x"))
    anchor = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", urls.keep_link(href, anchor).alias("kept"))
