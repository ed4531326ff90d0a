"""Site profile: every site-specific constant of the corpus jobs, passed to
operators as a parameter instead of being read from globals."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SiteProfile:
    # Site addresses are parameters; the neutral defaults below are the
    # shape used by the tests (a forum host under an allowed domain).
    base_url: str = "https://forum.example.org"
    index_url: str = "https://forum.example.org/handbook"
    domain_suffix: str = "example.org"
    post_hosts: tuple[str, ...] = ("forum.example.org", "")
    # ---- fixed values: rules that must equal the original behaviour ----
    post_prefixes: tuple[str, ...] = ("/posts/", "/s/")
    allowed_ports: tuple[int, ...] = (80, 443)
    noise_tags: tuple[str, ...] = ("nav", "footer", "script", "style", "noscript")
    rewrite_tags: tuple[str, ...] = (
        "a", "img", "source", "object", "iframe", "embed", "video", "audio",
        "track", "abbr", "summary", "kbd", "q", "cite", "del", "s", "sup",
        "sub", "mark", "u", "ins", "figcaption",
    )
    dangerous_schemes: tuple[str, ...] = (
        "javascript:", "data:", "vbscript:", "file:", "jscript:", "vbs:", "livescript:",
    )
    body_classes: tuple[str, ...] = ("postBody", "post-body", "PostBody")
    body_itemprop: str = "articleBody"
    byline_class_regex: str = "(?i)author|username|usersname"
    group_item_class: str = "LargeSequencesItem-columns"
    group_title_class: str = "LargeSequencesItem-titleAndAuthor"
    group_links_class: str = "LargeSequencesItem-right"
    comment_class_token: str = "comments"
    redirect_path: str = "/out"
    redirect_param: str = "url"
    license_phrases: tuple[str, ...] = ("creative commons", "cc by")
    default_section: str = "Introduction"
    max_bytes: int | None = None         # reject larger bodies; off by default, as a table holds them anyway
    max_requests: int = 5
    redirect_statuses: tuple[int, ...] = (301, 302, 303, 307, 308)
    mime_allow: tuple[str, ...] = ("text/html", "application/xhtml+xml")
    inline_literal_tags: tuple[str, ...] = ("kbd", "q", "cite", "del", "s", "mark", "u", "ins")
    embed_tags: tuple[str, ...] = ("iframe", "object", "embed", "video", "audio")
    placeholder_template: str = "*Content could not be extracted from {url}*"
    # ---- book front matter (parameters of the bound corpus) ----
    book_title: str = "The Handbook"
    book_author: str = "The Editors"
    book_language: str = "en"
    book_description: str = "A curated collection of posts."
    compiler_name: str = "the corpus compiler"
    repo_url: str = "https://example.org/corpus-compiler"
    # ---- flags for documented quirks (K = keep as default) ----
    cache_placeholders: bool = False     # original caches placeholders; we cache successes only


DEFAULT_PROFILE = SiteProfile()
