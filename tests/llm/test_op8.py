"""Main text of generated pages whose truth is known, and pages that end with the article."""

import random

import pytest

from folio.llm import op8_blocks

SCHEMA = "page_id long, url string, html string"


def texts(spark, pages):
    df = spark.createDataFrame([(k, "u", p) for k, p in enumerate(pages)], SCHEMA)
    return [r.text for r in op8_blocks.extract(df).orderBy("page_id").collect()]


def test_nothing_of_an_article_is_lost(spark):
    one, two, last = "First the river rose and the road was closed.", "Then it fell again.", "At last the road was open and the boats went home for good."
    got = texts(spark, [
        f"<article><h1>Title</h1><p>{one}</p><p>{two}</p><p>{last}</p></article></body>",
        f"<body><main><h1>Title</h1><p>{two}</p><p>{one}</p><p>{last}",
        f"<body><nav><a href=1>n</a></nav><main><p>{one}</p><p>{last}</p></main></body></html>",
        f"<article><h1>T</h1><div class='more-text'>{one}</div><div class=side-by-side>{two}</div><p class=notice-board>{one}</p><div class=search-results-table><table><tr><td>a<td>b</table></div>"
        f"<p class=legal-text>{last}</p><h2 class=alert-level>High</h2></article>",
        "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be <svg><text>round</text></svg> or <x-y>odd</x-y><script>f()</script>, <noscript>so</noscript> "
        "<select><option>a</select>it ends.</p></article>"])
    assert got == [f"Title\n{one}\n{two}\n{last}", f"Title\n{two}\n{one}\n{last}", f"{one}\n{last}",
                   f"T\n{one}\n{two}\n{one}\na\nb\n{last}\nHigh", "Let x=2 be round or odd, so it ends."]


def page(rng):
    """A page and its article text."""
    words = "river road boat bridge night morning water level town market field stone".split()
    say = lambda a, b: " ".join(rng.choices(words, k=rng.randint(a, b))).capitalize() + "."
    kept = []

    def keep(form, a=1, b=40):
        kept.append(say(a, b))
        return form.format(kept[-1])

    inner = [keep("<h1>{}</h1>", 2, 6)]
    for _ in range(rng.randint(1, 9)):
        inner.append(rng.choice([
            lambda: keep("<p>{}</p>"), lambda: keep("<p>{}"), lambda: keep("<h2>{}</h2>", 1, 4), lambda: keep("<ul><li>{}</li></ul>", 1, 8), lambda: keep("<blockquote>{}</blockquote>"),
            lambda: keep("<div class=" + rng.choice(["more-text", "side-note", "alert-level", "text-body"]) + ">{}</div>"), lambda: keep("<p><a href=/x>{}</a></p>", 1, 6),
            lambda: f"<div class=ad>{say(2, 12)}</div>", lambda: f"<aside><p>{say(5, 30)}</p></aside>", lambda: f"<script>var a = '<p>{say(2, 4)}</p>'</script>",
            lambda: f"<form><label>{say(1, 3)}</label><button>Go</button></form>", lambda: f"<!-- {say(3, 9)} -->"])())
    inner.append(keep("<p>{}</p>", 1, 40))
    out = "<html><head><title>t</title></head><body>" + rng.choice(["", f"<header><a href=/>{say(1, 2)}</a></header>"])
    out += rng.choice(["", "<nav><ul>" + "".join(f"<li><a href=/{k}>{say(1, 3)}</a>" for k in range(rng.randint(1, 5))) + "</ul></nav>"])
    out += rng.choice(["", f"<div class=cookie-banner>{say(4, 20)}</div>"])
    out += rng.choice(["<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>"]).format("".join(inner))
    out += rng.choice(["", "<section class=comments>" + f"<p>{say(3, 30)}</p>" * rng.randint(1, 3) + "</section>"])
    out += rng.choice(["", f"<div class=sidebar><p>{say(5, 25)}</p></div>"]) + rng.choice(["", f"<footer>&copy; {say(1, 4)}</footer>"])
    return out + rng.choice(["", "</body></html>"]), "\n".join(kept)


@pytest.mark.parametrize("seed", [1, 2])
def test_generated_pages(spark, seed):
    rng = random.Random(seed)
    pages = [page(rng) for _ in range(300)]
    for (html, want), got in zip(pages, texts(spark, [p for p, _ in pages])):
        assert got == want, html


def test_neighbours_decide():
    """The words between two links are menu, those between paragraphs are text."""
    tree = op8_blocks.trained()
    used = set()

    def walk(t):
        if isinstance(t, tuple):
            used.add(op8_blocks.FEATURES[t[0]])
            walk(t[2])
            walk(t[3])

    walk(tree)
    assert used & {"plain_words_before", "plain_words_after"}
    blocks, x = op8_blocks.blocks("<body><p>A long line of plain text about the river and the town and its boats.</p><h3>Read more</h3><p><a href=/>A long line of text in a link about "
                                  "the river, the town and its many boats.</a></p><h3>Read more</h3><p>A long line of plain text about the river and the town and its boats.</p>")
    assert op8_blocks.decide(tree, x).tolist() == [True, False, False, True, True]
    plain = ["One night the river rose and the whole lower road of the town was under water."] * 4
    for n in range(2, 5):
        blocks, x = op8_blocks.blocks("<body><div><a href=/>Home</a></div>" + "".join(f"<p>{p}</p>" for p in plain[:n]))
        assert op8_blocks.decide(tree, x).tolist() == [False] + [True] * n
