"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into blocks: runs of text between block-level tags. A block's
features are its words and link density, its neighbours' words outside of links
and link density, and what the markup around it says (containers, class words). A decision tree, grown from
the small labelled pages below, tells article blocks from the rest.

Definitions
- Character references are decoded, white space inside a block becomes one
  space, blocks without text don't count. ``br`` is white space.
- The text is the article blocks joined by one line break, in page order; empty
  for a null or empty page and for a page without article blocks.
- Broken markup is read as browsers do where it matters: unclosed paragraphs
  end at the next block, scripts and styles end at their own end tag only, an
  unclosed comment runs to the end. Unknown elements, formulas and drawings are
  part of their line; scripts and the like don't cut a line either.
- Repeated rows are pages of their own; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folio.llm.common import sliced

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>?", re.S)
#: Elements whose content is no page text. They don't end a block.
_SILENT = {"script", "style", "title", "textarea", "template", "iframe", "noembed", "noframes", "xmp", "select", "datalist", "audio", "video", "canvas",
           "annotation", "annotation-xml"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that begin and end blocks; all others, unknown ones and formulas too, are part of a line.
_BLOCK = set("""address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt embed fieldset figcaption figure footer
form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html input legend li link listing main menu meta nav ol optgroup option p plaintext pre
search section summary table tbody td tfoot th thead tr ul""".split())
#: Containers by what they usually hold.
_ARTICLE, _MAIN = {"article"}, {"main"}
_FRAME = {"nav", "aside", "menu", "form", "button", "dialog", "footer", "fieldset"}
_BAD_WORDS = set("""ad ads adbox advert adverts advertisement advertising banner promo promotion sponsor sponsored sponsors cookie cookies consent gdpr notice
notices alert warning popup modal overlay subscribe subscription newsletter signup login signin register paywall sidebar side rail widget widgets related
recommended recommendations trending popular more comment comments commentlist disqus reply replies respond discussion share sharing social follow menu nav
navbar navigation breadcrumb breadcrumbs topbar masthead header footer foot copyright legal pagination pager toolbar search searchbox tags tagcloud skip
hidden print feedback form complementary contentinfo""".split())
_GOOD_WORDS = set("article content post entry story body main text prose articlebody postbody maincontent".split())
_WORDS = re.compile(r"[a-z]+")
_ATTR = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDE = re.compile(r"(?:^|\s)hidden(?=\s|$|=)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)
FEATURES = ("words", "link_density", "plain_words_before", "links_before", "plain_words_after", "links_after", "in_article", "in_article_or_main",
            "in_frame", "in_header", "bad_class", "good_class", "hidden", "heading", "list_item")

# Labelled pages: (html, labels of its blocks in order; 1 is article text).
_P = "The river rose during the night and by the morning the lower road was under water again."
LABELLED: list[tuple[str, str]] = [
    (f"<body><nav><ul><li><a href=1>Home</a><li><a href=2>News</a><li>Topics</ul></nav><div class=ad>Buy two pairs today.</div><article><h1>Flood</h1><p>{_P}<p>Yes.</p>"
     f"<p>{_P} {_P}</p><ul><li>Boats<li><a href=3>Maps of the valley</a></ul><blockquote>{_P}</blockquote></article><footer>&copy; Daily</footer>", "0000" "1111111" "0"),
    (f"<body><header><h1>Site name</h1><p>{_P}</p></header><main><article><header><h1>Flood</h1><p>By Ann</p></header><p>{_P}</p><aside><p>{_P}</p></aside>"
     f"<footer>Filed under rivers</footer><section class=comments><p>{_P}</p><p>Nice.</p></section></article></main><aside><h2>Related</h2><p>{_P}</p></aside>", "00" "111" "0" "0" "00" "00"),
    (f"<body><div id=header><a href=1>Logo</a></div><div class=content><h2>Flood</h2><p>{_P}</p><p>{_P}</p><div class='share'>Share this</div><p>Short end.</p></div>"
     f"<div id=sidebar><p>{_P}</p></div><div class=footer><p>{_P}</p><p>All rights reserved.</p></div>", "0" "111" "0" "1" "0" "00"),
    (f"<body><div><a href=1>One</a> <a href=2>Two</a></div><div><p>{_P}</p><p>{_P}</p><p>{_P}</p></div><div><a href=3>Next page</a></div>", "0" "111" "0"),
    (f"<body><div class=cookie-notice><p>{_P}</p><button>Accept</button></div><div class=menu><ul><li>Home<li>About us</ul></div><main><h1>Flood</h1><p>{_P}</p><p>No.</p>"
     f"<form><p>{_P}</p></form><p><a href=4>{_P}</a></p></main><form><label>Mail</label></form>", "00" "00" "111" "0" "1" "0"),
    (f"<body><article><div class=ad><p>{_P}</p></div><h1>Flood</h1><div class=advert>Cheap boats</div><p>One.</p><p>{_P}</p><div hidden><p>{_P}</p></div><nav><a href=1>Part two</a></nav>"
     f"<div class='related'><h3>More</h3><p>{_P}</p></div><p><a href=5>Source</a></p></article>", "0" "1" "0" "11" "0" "0" "00" "1"),
    (f"<body><div class=post><h1>Flood</h1><p>{_P}</p></div><ol class=commentlist><li><p>{_P}</p><li><p>Agreed.</p></ol><div class=newsletter><h3>Letter</h3><p>{_P}</p></div>"
     "<div>Copyright</div>", "11" "00" "00" "0"),
    (f"<body><h1>Flood</h1><p>{_P}</p><p>{_P} {_P}</p><p>Then it stopped.</p><p>{_P}</p><p><a href=1>Home</a> | <a href=2>Top</a></p>", "11111" "0"),
    (f"<body><table><tr><td><a href=1>A</a><td><a href=2>B</a></table><article><table><tr><td>Level<td>4 m<tr><td>Rain<td>9 mm</table><pre>{_P}</pre><p>a</p><h2>b</h2></article>", "00" "1111" "1" "11"),
    (f"<body><nav><a href=1>Home</a></nav><article><h1>Flood</h1><p>{_P}</p><p>{_P}</p><p>{_P} {_P}</p></article></body>", "0" "1111"),
    (f"<body><div class=menu><a href=1>Home</a></div><main><h1>Flood</h1><p>{_P}</p><p>{_P}", "0" "111"),
    (f"<body><h1>Flood</h1><p>{_P} {_P}</p><p>{_P}</p>", "111"),
    (f"<body><p>{_P}</p><p>{_P}</p><p>{_P}</p>", "111"),
    (f"<body><nav><ul><li><a href=1>Home page</a><li>About the town<li><a href=2>All news of today</a></ul></nav><ul><li><a href=3>Maps of the valley</a><li><a href=4>Boats</a></ul>"
     f"<div class=menu><ul><li>Town hall<li>Market place</ul></div><p>{_P}</p><ul><li>Two boats there<li>Mud</ul><p>{_P}</p>", "000" "00" "00" "1111"),
    (f"<body><h1>Flood</h1><p>{_P}</p><p>{_P}</p><div>Best of today</div><div><a href=1>{_P}</a></div><div>And this one</div><div><a href=2>{_P}</a></div>", "111" "0000"),
    (f"<body><header>Daily news here.</header><p>{_P}</p><div class=comments>Nice river there.</div><p>{_P}</p><aside>See the maps.</aside><p>{_P}</p><p hidden>Draft of text.</p><p>{_P}</p>"
     f"<div class=ad>Buy boats now.</div><p>{_P}</p><h3>Three short words</h3><p>{_P}</p><ul><li>Two boats<li>Mud</ul><p>{_P}</p><p><a href=1>Go to the maps</a></p><p>{_P}</p>", "0" "10" "10" "10" "10" "111111" "0" "1"),
    (f"<body><div><a href=1>All news of today</a></div><div>Places and people</div><div><a href=2>Maps of the valley</a></div><div><p>{_P}</p><p>Three short words.</p><p>{_P}</p></div>"
     "<div><a href=3>The next page here</a></div><div>Or go back</div><div><a href=4>The last page here</a></div>", "000" "111" "000"),
    (f"<body><div><a href=1>Home</a></div><p>{_P}</p><p>{_P}</p><p>Go on.</p><p>{_P}</p>", "0" "1111"),
    (f"<body><div><a href=1>Home</a></div><div>Sections</div><div><a href=2>News</a></div><div><p>{_P}</p><p>Short.</p><p>{_P}</p></div><div><a href=3>Next</a></div><div>Or</div>"
     "<div><a href=4>Back</a></div>", "000" "111" "000"),
    (f"<body><div><a href=1>Home</a></div><div>Places</div><div><a href=2>News</a></div><article><h1>Flood</h1><p><a href=3>Part one</a></p><p>Two.</p><p><a href=4>Part three</a></p>"
     f"<div class=more-text><p>{_P}</p></div><div class=side-by-side>Left.</div><p class=notice-board>{_P}</p><h2 class=alert-level>High</h2><p class=legal-text>{_P}</p></article>"
     f"<p class=legal-text>{_P}</p>", "000" "1111" "11111" "0"),
    (f"<body><article><h1>Flood</h1><p><a href=1>Map</a></p><p>{_P}</p><p>Two.</p><p><a href=2>Boats</a></p><p>{_P} {_P}</p><p>The end.</p></article>", "1111111"),
    (f"<body><main><h1>Flood</h1><p><a href=1>Map</a></p><p>{_P}</p><p>Two.</p><p><a href=2>Boats</a></p><p>{_P} {_P}</p><p>The end.</p></main>", "1111111"),
    (f"<body><article><p>Yes.</p><p>{_P}</p><p>No.</p><p hidden>{_P}</p><ul><li>Boats<li>Mud</ul><p hidden>Draft</p><p>{_P}</p><p>End.</p></article>", "111" "0" "11" "0" "11"),
    (f"<body><main><p>Yes.</p><p>{_P}</p><p>No.</p><p hidden>{_P}</p><ul><li>Boats<li>Mud</ul><p hidden>Draft</p><p>{_P}</p><p>End.</p></main>", "111" "0" "11" "0" "11"),
    (f"<body><p hidden>Draft</p><p>{_P}</p><p>{_P}</p><p>{_P}</p><p hidden>{_P}</p><div><a href=1>Home</a></div>", "0" "111" "00"),
    *[(f"<body><div><a href=1>Home</a></div><{tag}><p>One.</p><p><a href=1>Map</a></p><p>Two.</p><p><a href=2>Boats and mud</a></p><form>Go</form><p>Three words here.</p><p><a href=3>Bank</a></p>"
       "<p>a</p><h2>b</h2><p><a href=4>c</a></p><p>d</p><p><a href=5>e</a></p></" + tag + "><div>Top</div><div><a href=6>Home</a></div><div>End</div>", "0" "1111" "0" "1111111" "000") for tag in ("article", "main")],
    (f"<body><div>Menu</div><div><a href=1>Home</a></div><div><p>One.</p><p>{_P}</p><p>Two.</p><p>{_P} {_P}</p></div>", "00" "1111"),
]


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """Texts of a page's blocks, and a row of ``FEATURES`` for each."""
    texts: list[str] = []
    rows: list[list[float]] = []
    stack: list[tuple[str, int]] = []  # open elements, and the flags they set
    flags = [0] * 7  # article, main, frame, header, bad, good, hidden: how many open elements set them
    text: list[str] = []
    linked = links = heading = item = 0
    pos, size = 0, len(page)

    def end_block() -> None:
        nonlocal linked
        joined = " ".join(html_lib.unescape("".join(text)).split())
        if joined:
            n = joined.count(" ") + 1
            texts.append(joined)
            rows.append([n, min(1.0, linked / n), 0, 0, 0, 0, *[float(f > 0) for f in (flags[0], flags[0] + flags[1], *flags[2:])], float(heading > 0), float(item > 0)])
        text.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal links, heading, item
        while len(stack) > k:
            name, bits = stack.pop()
            for j in range(7):
                flags[j] -= bits >> j & 1
            links -= name == "a"
            heading -= name in ("h1", "h2", "h3", "h4", "h5", "h6")
            item -= name == "li"

    while pos < size:
        m = _TAG.search(page, pos)
        at = m.start() if m else size
        if at > pos:
            text.append(page[pos:at])
            if links:
                linked += len(html_lib.unescape(page[pos:at]).split())
        if not m:
            break
        pos = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ending, attrs = m[1] or m[4], m[3] or m[6] or ""
        if name in _BLOCK:
            end_block()
        elif name == "br":
            text.append(" ")
        if ending:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        if name in _SILENT:
            if not attrs.rstrip().endswith("/"):
                stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, pos)
                pos = stop.end() if stop else size
            continue
        if name in _VOID:
            continue
        if name in ("li", "dt", "dd", "td", "th", "tr", "option", "a") or name in _BLOCK:
            same = {name} if name in ("li", "a", "tr") else {"dt", "dd"} if name in ("dt", "dd") else {"td", "th"} if name in ("td", "th") else {"p"}
            for k in range(len(stack) - 1, -1, -1):  # an unclosed element of the kind ends here
                if stack[k][0] in same:
                    close(k)
                    break
                if stack[k][0] in _BLOCK and (stack[k][0] != "p" or name == "a"):
                    break
        found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
        tokens = " ".join([found.get(k, "") for k in ("class", "id", "role", "itemprop")]).lower()
        said = set(_WORDS.findall(tokens))
        # inside an article or main a word counts as a whole class only: "more-text" is text
        bad = (set(tokens.split()) if flags[0] or flags[1] else said) & _BAD_WORDS
        if flags[0] or said & _GOOD_WORDS:
            bad -= {"header"}  # an article's own heading
        bits = ((name in _ARTICLE) | (name in _MAIN or found.get("role") == "main") << 1 | (name in _FRAME) << 2
                | (name == "header" and not flags[0]) << 3 | (bool(bad) and name not in ("body", "html", "article", "main")) << 4
                | bool(said & _GOOD_WORDS) << 5 | bool(_HIDE.search(attrs)) << 6)
        stack.append((name, bits))
        for j in range(7):
            flags[j] += bits >> j & 1
        links += name == "a"
        heading += name in ("h1", "h2", "h3", "h4", "h5", "h6")
        item += name == "li"
    end_block()
    x = np.array(rows, float).reshape(len(rows), len(FEATURES))
    if len(x):
        plain = np.column_stack([x[:, 0] * (1 - x[:, 1]), x[:, 1]])  # words outside of links, link density
        x[1:, 2:4], x[:-1, 4:6] = plain[:-1], plain[1:]
    return texts, x


def grow(x: np.ndarray, y: np.ndarray, depth: int = 16):
    """A decision tree: a share of article blocks, or (feature, limit, tree of
    the rows up to the limit, tree of the others), split by Gini impurity."""
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in [*range(6, x.shape[1]), *range(6)]:  # of equal splits, what the markup says goes before counts of words
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= limit
            a, b = y[left], y[~left]
            cost = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or cost < best[0] - 1e-12:
                best = cost, f, float(limit), left
    if best is None:
        return float(y.mean())
    _, f, limit, left = best
    return f, limit, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


def decide(tree, x: np.ndarray) -> np.ndarray:
    """True for the rows that the tree takes for article text."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree >= 0.5)
    f, limit, low, high = tree
    left = x[:, f] <= limit
    out = np.zeros(len(x), bool)
    out[left], out[~left] = decide(low, x[left]), decide(high, x[~left])
    return out


def trained(labelled: list[tuple[str, str]] = LABELLED):
    parts = [(blocks(page)[1], np.array([*map(float, labels)])) for page, labels in labelled]
    return grow(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]))


def extract(pages: DataFrame, labelled: list[tuple[str, str]] = LABELLED) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    tree = trained(labelled)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            out = []
            for page in batch.column("html").to_pylist():
                texts, x = blocks(page or "")
                out.append("\n".join([t for t, keep in zip(texts, decide(tree, x).tolist()) if keep]) if texts else "")
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()),
                                              pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
