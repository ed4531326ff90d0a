"""Per-page HTML tokenising helper used by ``html_nodes``.

Runs inside executor tasks only. The stdlib tokenizer does the lexing
(entities, raw-text script/style); this module adds the small set of
tree-building rules a tolerant HTML parser needs and emits the flat,
pre-order node rows. Everything after this point is relational.
"""

from __future__ import annotations

from html.parser import HTMLParser

# ---- fixed values: HTML tree-construction rules ----
VOID_TAGS = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen",
    "link", "meta", "param", "source", "track", "wbr",
])
HEAD_TAGS = frozenset(["title", "meta", "link", "style", "script", "base", "noscript"])
# start tags that implicitly end an open <p>
CLOSES_P = frozenset([
    "address", "article", "aside", "blockquote", "details", "dialog", "div", "dl",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre",
    "section", "table", "ul", "li", "dd", "dt",
])
# elements that bound the search for an element to close implicitly
SCOPE_TAGS = frozenset([
    "div", "article", "section", "td", "th", "li", "table", "blockquote",
    "body", "html", "button", "main", "aside", "header", "footer", "nav",
])
# tag -> (tags it closes, tags that stop the search)
SELF_CLOSING_GROUPS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "body", "html", "table"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "body", "html", "table"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "body", "html", "table"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table", "tbody", "thead", "tfoot", "body", "html"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table", "body", "html"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table", "body", "html"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "body", "html"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table", "body", "html"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table", "body", "html"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table", "body", "html"])),
}
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
RAW_TEXT_TAGS = frozenset(["script", "style"])


class NodeTableBuilder(HTMLParser):
    """Builds column lists (node_id, parent_id, end_id, depth, kind, tag,
    classes, attrs, text) for one document."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent_id: list[int] = []
        self.end_id: list[int] = []
        self.depth: list[int] = []
        self.kind: list[str] = []
        self.tag: list[str | None] = []
        self.classes: list[list[str] | None] = []
        self.attrs: list[list[tuple[str, str]] | None] = []
        self.text: list[str | None] = []
        self.stack: list[int] = []  # open node ids; stack[0] is the document
        self.html_id = -1
        self.head_id = -1
        self.body_id = -1
        self._new("document", None, None, None, None)
        self.stack.append(0)

    # -- row emission -------------------------------------------------------
    def _new(self, kind, tag, classes, attrs, text) -> int:
        nid = len(self.kind)
        self.parent_id.append(self.stack[-1] if self.stack else -1)
        self.end_id.append(nid)
        self.depth.append(len(self.stack))
        self.kind.append(kind)
        self.tag.append(tag)
        self.classes.append(classes)
        self.attrs.append(attrs)
        self.text.append(text)
        return nid

    def _open(self, tag: str, attrs) -> int:
        seen: dict[str, str] = {}
        for k, v in attrs:
            if k not in seen:  # first occurrence of an attribute wins
                seen[k] = "" if v is None else v
        cls = seen.get("class")
        classes = cls.split() if cls is not None else None
        nid = self._new("element", tag, classes, list(seen.items()), None)
        self.stack.append(nid)
        return nid

    def _pop(self) -> None:
        nid = self.stack.pop()
        self.end_id[nid] = len(self.kind) - 1

    def _pop_to(self, index: int) -> None:
        while len(self.stack) > index:
            self._pop()

    def _find_open(self, targets, stops) -> int:
        for i in range(len(self.stack) - 1, 0, -1):
            t = self.tag[self.stack[i]]
            if t in targets:
                return i
            if t in stops:
                return -1
        return -1

    # -- implicit html / head / body ---------------------------------------
    def _ensure_html(self) -> None:
        if self.html_id < 0:
            self._pop_to(1)
            self.html_id = self._open("html", [])

    def _ensure_body(self) -> None:
        self._ensure_html()
        if self.body_id >= 0:
            return
        if self.head_id >= 0 and self.head_id in self.stack:
            self._pop_to(self.stack.index(self.head_id))
        self.body_id = self._open("body", [])

    def _in_document_level(self) -> bool:
        top = self.stack[-1]
        return top in (0, self.html_id) or (top == self.head_id)

    # -- tokenizer callbacks ------------------------------------------------
    def handle_starttag(self, tag, attrs):
        if tag == "html":
            if self.html_id < 0:
                self._pop_to(1)
                self.html_id = self._open("html", attrs)
            return
        if tag == "head":
            if self.head_id < 0 and self.body_id < 0:
                self._ensure_html()
                self.head_id = self._open("head", attrs)
            return
        if tag == "body":
            if self.body_id < 0:
                self._ensure_html()
                if self.head_id >= 0 and self.head_id in self.stack:
                    self._pop_to(self.stack.index(self.head_id))
                self.body_id = self._open("body", attrs)
            return
        if self.body_id < 0:
            if tag in HEAD_TAGS and (self.head_id < 0 or self.head_id in self.stack):
                self._ensure_html()
                if self.head_id < 0:
                    self.head_id = self._open("head", [])
            elif self._in_document_level():
                self._ensure_body()
        if tag in CLOSES_P:
            i = self._find_open(("p",), SCOPE_TAGS)
            if i > 0:
                self._pop_to(i)
        if tag in HEADINGS and self.tag[self.stack[-1]] in HEADINGS:
            self._pop()
        group = SELF_CLOSING_GROUPS.get(tag)
        if group is not None:
            i = self._find_open(group[0], group[1])
            if i > 0:
                self._pop_to(i)
        self._open(tag, attrs)
        if tag in VOID_TAGS:
            self._pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS and self.stack and self.tag[self.stack[-1]] == tag:
            self._pop()

    def handle_endtag(self, tag):
        if tag in ("html", "body", "head"):
            if tag == "head" and self.head_id in self.stack:
                self._pop_to(self.stack.index(self.head_id))
            return  # html/body stay open until the end of input
        if tag in VOID_TAGS:
            return
        stops = SCOPE_TAGS if tag == "p" else ()
        i = self._find_open((tag,), stops)
        if i > 0:
            self._pop_to(i)

    def handle_data(self, data):
        if not data:
            return
        if self.body_id < 0 and self._in_document_level():
            if not data.strip():
                return
            self._ensure_body()
        parent = self.stack[-1]
        kind = "raw" if self.tag[parent] in RAW_TEXT_TAGS else "text"
        last = len(self.kind) - 1
        if last > 0 and self.parent_id[last] == parent and self.kind[last] == kind:
            self.text[last] += data  # tokenizer may split one text run
            return
        self._new(kind, None, None, None, data)

    def parse_marked_section(self, i, report=1):
        """``<![...`` that is no known declaration is a comment up to ``>``,
        or up to the end."""
        j = self.rawdata.find(">", i)
        j = len(self.rawdata) - 1 if j < 0 else j
        self.handle_comment(self.rawdata[i + 2:j])
        return j + 1

    def handle_comment(self, data):
        self._new("comment", None, None, None, data)

    def finish(self):
        self.close()
        self._pop_to(0)
        self.end_id[0] = len(self.kind) - 1


def parse_document(html: str | None, strict: bool = False) -> NodeTableBuilder:
    """The node table of one page. A page that the tokenizer cannot read
    becomes its document row and one row of kind ``error`` with the reason,
    unless ``strict`` asks for the error itself."""
    b = NodeTableBuilder()
    try:
        if html:
            b.feed(html)
        b.finish()
    except Exception as e:
        if strict:
            raise
        b = NodeTableBuilder()
        b._new("error", None, None, None, f"{type(e).__name__}: {e}")
        b.finish()
    return b
