"""URL column functions.

All are built-in Spark expressions (codegen, no Python), usable in
``select``/``where`` and in SQL via ``F.expr`` text. Semantics follow the
standard library URL splitter the original rules were written against:
scheme = leading ``[A-Za-z][A-Za-z0-9+.-]*:``, tabs/newlines removed,
leading C0/space stripped, host lower-cased from the authority after the
last ``@`` and before the first ``:``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.profile import DEFAULT_PROFILE, SiteProfile


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once: inside ``body`` it is a
    lambda variable, so a rule that reads the parts of a URL many times
    neither repeats the split nor grows the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fix_backslashes(url) -> Column:
    """``\\`` -> ``/`` before parsing."""
    return F.replace(_c(url), F.lit("\\"), F.lit("/"))


def _clean(url: Column) -> Column:
    u = F.regexp_replace(url, "[\\t\\r\\n]", "")
    return F.regexp_replace(u, "^[\\x00-\\x20]+", "")


def url_parts(url) -> Column:
    """Split a URL into a struct of scheme, authority, userinfo, host,
    port (string), path, query, fragment. Missing parts are ``''``.
    ``has_authority``, ``has_query`` and ``has_fragment`` tell whether ``//``,
    ``?`` and ``#`` were present; ``clean`` is the URL without tabs, line
    breaks and leading controls."""
    scheme_re = "^([A-Za-z][A-Za-z0-9+.\\-]*):"

    def by_scheme(u):
        scheme = F.lower(F.regexp_extract(u, scheme_re, 1))
        return F.struct(u.alias("clean"), scheme.alias("scheme"),
                        F.when(scheme == "", u).otherwise(F.regexp_replace(u, scheme_re, "")).alias("rest"))

    def by_fragment(x):
        nofrag = F.regexp_replace(x["rest"], "#.*$", "")
        auth = nofrag.startswith("//")
        return F.struct(x["clean"].alias("clean"), x["scheme"].alias("scheme"),
                        F.regexp_extract(x["rest"], "#(.*)$", 1).alias("fragment"), x["rest"].contains("#").alias("has_fragment"),
                        auth.alias("has_authority"),
                        F.when(auth, F.regexp_extract(nofrag, "^//([^/?]*)", 1)).otherwise(F.lit("")).alias("authority"),
                        F.when(auth, F.regexp_replace(nofrag, "^//[^/?]*", "")).otherwise(nofrag).alias("after"))

    def by_host(x):
        hostinfo = F.regexp_replace(x["authority"], "^.*@", "")
        bracketed = hostinfo.startswith("[")
        host = F.lower(F.when(bracketed, F.regexp_extract(hostinfo, "^\\[([^\\]]*)\\]", 1)).otherwise(F.regexp_extract(hostinfo, "^([^:]*)", 1)))
        port = F.when(bracketed, F.regexp_extract(hostinfo, "^\\[[^\\]]*\\]:(.*)$", 1)).otherwise(F.regexp_extract(hostinfo, "^[^:]*:(.*)$", 1))
        return F.struct(x["scheme"].alias("scheme"), x["authority"].alias("authority"),
                        F.regexp_extract(x["authority"], "^(.*)@", 1).alias("userinfo"), host.alias("host"), port.alias("port"),
                        F.regexp_replace(x["after"], "\\?.*$", "").alias("path"), F.regexp_extract(x["after"], "\\?(.*)$", 1).alias("query"),
                        x["fragment"].alias("fragment"), x["has_authority"].alias("has_authority"),
                        x["has_fragment"].alias("has_fragment"), x["after"].contains("?").alias("has_query"), x["clean"].alias("clean"))

    return let(_clean(_c(url)), lambda u: let(by_scheme(u), lambda x: let(by_fragment(x), by_host)))


def port_status(port: Column) -> Column:
    """'none' | 'ok' | 'bad' for a port string (bad = not digits or > 65535)."""
    return (F.when(port == "", F.lit("none"))
            .when(port.rlike("^[0-9]+$") & (F.length(F.regexp_replace(port, "^0+", "")) <= 5)
                  & (F.try_to_number(port, F.lit("9999999999")) <= 65535), F.lit("ok"))
            .otherwise(F.lit("bad")))


def port_value(port: Column) -> Column:
    return F.when(port_status(port) == "ok", port.cast("int"))


def normalize_path(path) -> Column:
    """P5: POSIX path normalisation (resolve ``.``/``..``, collapse
    slashes; exactly two leading slashes are kept, ``..`` above an absolute
    root dropped, empty -> ``.``)."""
    p = _c(path)
    parts = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
    is_abs = p.startswith("/")
    empty = F.array().cast("array<string>")

    def step(acc, s):
        can_pop = (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        popped = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return (F.when(s != "..", F.concat(acc, F.array(s)))
                .when(can_pop, popped)
                .when(is_abs, acc)
                .otherwise(F.concat(acc, F.array(s))))

    stack = F.aggregate(parts, empty, step)
    prefix = (F.when(p.startswith("//") & ~p.startswith("///"), F.lit("//"))
              .when(is_abs, F.lit("/")).otherwise(F.lit("")))
    body = F.array_join(stack, "/")
    return F.when((prefix == "") & (body == ""), F.lit(".")).otherwise(F.concat(prefix, body))


def _merge_path(base_path: Column, ref_path: Column, base_has_auth: Column) -> Column:
    merged = F.when(base_has_auth & (base_path == ""), F.concat(F.lit("/"), ref_path)) \
        .otherwise(F.concat(F.regexp_replace(base_path, "[^/]*$", ""), ref_path))
    return merged


def _remove_dots(path: Column) -> Column:
    """RFC 3986 dot-segment removal keeping a trailing slash; ``..`` above
    the root is dropped."""
    segs = F.split(path, "/", -1)
    # the first element is '' for absolute paths
    body = F.slice(segs, 2, F.greatest(F.size(segs) - 1, F.lit(0)))
    body = F.filter(body, lambda s, i: (s != "") | (i == F.size(body) - 1))
    last = F.element_at(segs, -1)
    trailing = (last == ".") | (last == "..")
    empty = F.array().cast("array<string>")

    def step(acc, s):
        return (F.when(s == ".", acc)
                .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                .otherwise(F.concat(acc, F.array(s))))

    stack = F.aggregate(body, empty, step)
    joined = F.concat(F.lit("/"), F.array_join(stack, "/"))
    return F.when(trailing & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


# an absolute path without dot or empty segments, a URL's scheme and authority
# without user or port, and a URL of both: what most links are made of
_PLAIN_PATH, _PLAIN_ORIGIN = "^/[A-Za-z0-9_/-]*[A-Za-z0-9_-]\\z", "^(https?://[a-z0-9.-]+)(?:[/?#]|\\z)"
_PLAIN_URL = "^https?://([a-z0-9.-]+)/[A-Za-z0-9_/.~-]*\\z"


def resolve_url(href, base) -> Column:
    """RFC 3986 reference resolution of ``href`` against ``base``
    (``//h/x`` takes the base scheme, ``..`` above the root is dropped,
    query and trailing slash kept). A plain URL stays as it is, a plain path
    follows the base's origin; only other references are taken apart."""
    h, origin = _c(href), F.regexp_extract(_c(base), _PLAIN_ORIGIN, 1)
    plain = h.rlike(_PLAIN_PATH) & ~h.contains("//") & (origin != "")
    return F.when(h.rlike(_PLAIN_URL), h).when(plain, F.concat(origin, h)).otherwise(_resolve_parts(href, base))


def _resolve_parts(href, base) -> Column:
    def build(x):
        r, b, ref, whole = x["r"], x["b"], x["ref"], x["base"]
        pre = F.when(b["scheme"] != "", F.concat(b["scheme"], F.lit(":"))).otherwise(F.lit(""))
        auth = F.when(b["has_authority"], F.concat(F.lit("//"), b["authority"])).otherwise(F.lit(""))
        query = F.when(r["has_query"], F.concat(F.lit("?"), r["query"])).otherwise(F.lit(""))
        frag = F.when(r["has_fragment"], F.concat(F.lit("#"), r["fragment"])).otherwise(F.lit(""))
        merged = F.when(r["path"].startswith("/"), r["path"]).otherwise(_merge_path(b["path"], r["path"], b["has_authority"]))
        return (F.when(whole.isNull() | (whole == ""), r["clean"])
                .when(F.coalesce(ref, F.lit("")) == "", whole)
                .when(~((r["scheme"] == "") | (r["scheme"] == b["scheme"])), r["clean"])
                .when(r["has_authority"], F.concat(pre, F.lit("//"), r["authority"], r["path"], query, frag))
                .when(r["path"] == "", F.concat(pre, auth, b["path"],
                                                F.when(~r["has_query"] & b["has_query"], F.concat(F.lit("?"), b["query"])).otherwise(query), frag))
                .otherwise(F.concat(pre, auth, let(merged, _remove_dots), query, frag)))

    return let(F.struct(url_parts(href).alias("r"), url_parts(base).alias("b"), _c(href).alias("ref"), _c(base).alias("base")), build)


def validate_url(url, profile: SiteProfile = DEFAULT_PROFILE) -> Column:
    """struct<url, error>. Scheme http/https; host equal to the domain
    or a sub-domain; port none/80/443; the URL is rebuilt from host and
    port only (credentials dropped). Of a plain URL only the host is tested."""
    u, dom = _c(url), profile.domain_suffix
    host = F.regexp_extract(u, _PLAIN_URL, 1)
    error = F.when(~((host == dom) | host.endswith("." + dom)), F.concat(F.lit("Unsafe URL domain: "), host))
    return F.when(host != "", F.struct(F.when(error.isNull(), u).alias("url"), error.alias("error"))).otherwise(_validate_parts(url, profile))


def _validate_parts(url, profile: SiteProfile) -> Column:
    dom, allowed = profile.domain_suffix, [int(x) for x in profile.allowed_ports]

    def check(p):
        ps, pv = port_status(p["port"]), port_value(p["port"])
        netloc = F.concat(p["host"], F.when(ps == "ok", F.concat(F.lit(":"), pv.cast("string"))).otherwise(F.lit("")))
        rebuilt = F.concat(p["scheme"], F.lit("://"), netloc, p["path"],
                           F.when(p["has_query"], F.concat(F.lit("?"), p["query"])).otherwise(F.lit("")),
                           F.when(p["has_fragment"], F.concat(F.lit("#"), p["fragment"])).otherwise(F.lit("")))
        error = (F.when(~p["scheme"].isin("http", "https"), F.concat(F.lit("Unsafe URL scheme: "), p["scheme"]))
                 .when(~((p["host"] == dom) | p["host"].endswith("." + dom)), F.concat(F.lit("Unsafe URL domain: "), p["host"]))
                 .when(ps == "bad", F.concat(F.lit("Invalid URL port: "), p["port"]))
                 .when(~((ps == "none") | ((ps == "ok") & pv.isin(allowed))), F.concat(F.lit("Unsafe URL port: "), pv.cast("string"))))
        return let(error, lambda e: F.struct(F.when(e.isNull(), rebuilt).alias("url"), e.alias("error")))

    return let(url_parts(fix_backslashes(url)), check)


def is_post_url(url, profile: SiteProfile = DEFAULT_PROFILE) -> Column:
    """Does the URL point to a post or sequence of the site?

    Cheap substring test first, then scheme (http/https/none), a host
    required with a scheme, host in the allow-list (or none), default
    ports only, and a prefix test on the *normalised* path. An
    out-of-range port gives false instead of an exception."""
    u = fix_backslashes(url)
    hosts, allowed = list(profile.post_hosts), [int(x) for x in profile.allowed_ports]
    named = [h for h in hosts if h]

    def check(p):
        ps = port_status(p["port"])
        port_ok = (F.lit(True) if not named else
                   ~p["host"].isin(named) | (ps == "none") | ((ps == "ok") & port_value(p["port"]).isin(allowed)))
        path = let(normalize_path(p["path"]), lambda n: _any_startswith(F.when(n.startswith("/"), n).otherwise(F.concat(F.lit("/"), n)), profile.post_prefixes))
        return (p["scheme"].isin("http", "https", "") & ~((p["scheme"] != "") & (p["host"] == "")) & p["host"].isin(hosts) & port_ok & path)

    return F.coalesce(F.when(_any_contains(u, profile.post_prefixes), let(url_parts(u), check)), F.lit(False))


def _any_contains(c: Column, subs) -> Column:
    return reduce(lambda x, y: x | y, [c.contains(s) for s in subs])


def _any_startswith(c: Column, subs) -> Column:
    return reduce(lambda x, y: x | y, [c.startswith(s) for s in subs])


def absolutize_link(value, profile: SiteProfile = DEFAULT_PROFILE, base=None) -> Column:
    """Leave ``http://``, ``https://``, ``#``, ``mailto:``, ``tel:`` and
    any value with a scheme; otherwise resolve against the site base URL
    (or ``base`` when given, e.g. the page URL)."""
    v = _c(value)
    keep = _any_startswith(v, ("http://", "https://", "#", "mailto:", "tel:")) | (url_parts(v)["scheme"] != "")
    b = F.lit(profile.base_url) if base is None else _c(base)
    return F.when(keep, v).otherwise(resolve_url(v, b))


def link_target(href, profile: SiteProfile = DEFAULT_PROFILE) -> Column:
    """P13 (URL part): hrefs starting with ``http`` are kept as they are,
    anything else is resolved against the site base URL."""
    h = _c(href)
    return F.when(h.startswith("http"), h).otherwise(resolve_url(h, F.lit(profile.base_url)))


def keep_link(href, anchor, profile: SiteProfile = DEFAULT_PROFILE) -> Column:
    """Non-empty href, non-empty anchor text, resolved target is a
    post URL."""
    h = _c(href)
    return ((F.coalesce(h, F.lit("")) != "") & (F.coalesce(_c(anchor), F.lit("")) != "")
            & let(link_target(h, profile), lambda t: is_post_url(t, profile)))


def first_non_empty(*cols) -> Column:
    """First argument that is neither NULL nor ``''``."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols])


def url_key(url) -> Column:
    """Hex SHA-256 of the UTF-8 URL (cache key)."""
    return F.sha2(_c(url), 256)


# ---- fixed values: characters removed before the dangerous-scheme test ----
# Python's \s (Unicode whitespace) plus C0/C1 controls.
_WS_CTRL = "(?U)[\\s\\x00-\\x1f\\x7f-\\x9f]"


def percent_decode(c: Column) -> Column:
    """Percent-decoding that leaves ``+`` and stray ``%`` alone (path
    semantics): pre-escape them so ``try_url_decode`` never fails."""
    esc = F.regexp_replace(F.regexp_replace(c, "\\+", "%2B"), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(esc), c)


def has_dangerous_scheme(value, profile: SiteProfile = DEFAULT_PROFILE, decoded=None) -> Column:
    """Entity-decode -> percent-decode -> drop whitespace/controls ->
    lower -> starts with a dangerous scheme. ``decoded`` is the
    entity-decoded value (see ``folio.functions.entities``); without it
    the raw value is used."""
    v = _c(value)
    d = v if decoded is None else _c(decoded)
    cleaned = F.lower(F.regexp_replace(percent_decode(d), _WS_CTRL, ""))
    needs = v.contains("%") | v.contains("&") | v.rlike(_WS_CTRL)
    tested = F.when(needs, cleaned).otherwise(F.lower(v))
    return _any_startswith(tested, profile.dangerous_schemes)


def unwrap_redirect(value, profile: SiteProfile = DEFAULT_PROFILE) -> Column:
    """A value whose parsed path is exactly the redirect path is
    replaced by the first non-blank value of the redirect parameter; names
    and values are query-decoded, stray ``%`` stay; any host qualifies; one
    level only."""
    v = _c(value)

    def decode(x):
        esc = F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25")
        return F.coalesce(F.try_url_decode(esc), x)

    def target(p):
        pairs = F.filter(F.split(p["query"], "&"), lambda x: x.rlike("^[^=]*=.") & (decode(F.substring_index(x, "=", 1)) == profile.redirect_param))
        first = F.when(F.size(pairs) > 0, decode(F.regexp_replace(F.element_at(pairs, 1), "^[^=]*=", "")))
        return F.when(p["path"] == profile.redirect_path, first)

    return F.when(v.contains(profile.redirect_path), F.coalesce(let(url_parts(v), target), v)).otherwise(v)


def sanitize_df(df, col: str, out: str, profile: SiteProfile = DEFAULT_PROFILE):
    """P10 on one column: NULL when the value hides a dangerous scheme (P7,
    also after unwrapping the redirect, P8), else the unwrapped value made
    absolute (P9). Empty values pass through. Apply it to the *distinct*
    values of a link column and join back; only values with ``&`` are
    entity-decoded in Python."""
    from folio.functions.entities import with_unescaped
    s, c = "_sz_", F.col
    df = df.withColumn(s + "unw", unwrap_redirect(c(col), profile))
    df = with_unescaped(with_unescaped(df, col, s + "dec"), s + "unw", s + "dec2")
    bad = has_dangerous_scheme(c(col), profile, decoded=c(s + "dec")) | has_dangerous_scheme(c(s + "unw"), profile, decoded=c(s + "dec2"))
    res = (F.when(c(col).isNull() | (c(col) == ""), c(col))
           .when(bad, F.lit(None).cast("string"))
           .otherwise(absolutize_link(c(s + "unw"), profile)))
    return df.withColumn(out, res).drop(s + "unw", s + "dec", s + "dec2")


def classify_links_df(df, href: str, profile: SiteProfile = DEFAULT_PROFILE):
    """P13 for a link table: adds ``url`` (target) and ``is_post``; the
    rules run once per *distinct* href and are joined back, so a link
    repeated across millions of pages costs one evaluation."""
    hv = df.select(F.col(href).alias("_h")).where(F.col("_h").isNotNull()).distinct()
    hv = hv.select(F.col("_h").alias(href), link_target("_h", profile).alias("url"))
    hv = hv.withColumn("is_post", is_post_url("url", profile))
    return df.join(hv, href, "left")
