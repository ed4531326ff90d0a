SITE = "https://forum.example.org"


def page(body, head=""):
    return f"<html><head><title>t</title>{head}</head><body>{body}</body></html>"


def test_markdown_golden(render_pages):
    md = render_pages([
        (1, "u", page('<div class="postBody"><h1>Title</h1><p>Hello <b>b</b> <a href="/posts/x">l</a></p>'
                      '<nav>menu</nav><span aria-hidden="true">h</span><div class="CommentsSection">c</div>'
                      '<script>s</script><footer>f</footer></div>')),
        (2, "u", page('<div class="postBody"><img src="/a.png"><img src="/b.png" alt="">'
                      '<img src="/c.png" alt="A nice image"><img src="/d.png" role="none" alt="x"></div>')),
        (3, "u", page('<div class="postBody"><p><abbr title="World Health Organization">WHO</abbr> <abbr>UN</abbr></p>'
                      '<figcaption>Cap</figcaption><p><kbd>K</kbd> x<sup>2</sup> H<sub>2</sub>O</p></div>')),
        (4, "u", page('<div class="postBody"><iframe src="https://v.example.com/e" title="Vid"></iframe>'
                      '<object aria-label="Obj" data="/o.bin"></object><embed src="/e.swf"></div>')),
        (5, "u", page("<div class=\"postBody\"><p>Text.</p><p>Licensed under CC BY 4.0</p>"
                      "<p>Creative Commons text</p><p>MIT License</p></div>")),
    ])
    assert md[1] == f"# Title\n\nHello **b** [l]({SITE}/posts/x)"
    assert md[2] == f"![Image]({SITE}/a.png)![]({SITE}/b.png)![A nice image]({SITE}/c.png)![]({SITE}/d.png)"
    assert md[3] == "WHO (World Health Organization) UN\n\n*Cap*\n\n<kbd>K</kbd> x^2^ H~2~O"
    assert md[4] == (f'[Vid](https://v.example.com/e "Vid")[Obj]({SITE}/o.bin "Embedded content")'
                     f'[Embedded content]({SITE}/e.swf "Embedded content")')
    assert md[5] == "Text.\n\nMIT License"


def test_body_fallbacks(spark):
    from folio.operators import body, dom
    df = spark.createDataFrame([
        (1, "u", page('<div>short</div><div>a much longer text</div>')),
        (2, "u", page('<p>only p</p>')),
        (3, "u", page('<div></div>')),
        (4, "u", page('<div><!-- a long comment here --></div><div>ab</div>')),
    ], "page_id long, url string, html string")
    nodes = dom.html_nodes(df)
    got = {r.page_id: r.text_len for r in body.largest_div(nodes).collect()}
    assert got == {1: 18, 4: 2}


def test_table_header_separator(render_pages):
    md = render_pages([(1, "u", page('<div class="postBody"><table><tr><th>A</th><th>B</th></tr>'
                                     '<tr><td>1</td><td>2</td></tr></table></div>'))])
    assert md[1] == "| A | B |\n| --- | --- |\n| 1 | 2 |"


def test_lists_code_and_quotes(render_pages):
    md = render_pages([
        (1, "u", page('<div class="postBody"><ol>\n<li>a</li>\n<li>b</li>\n<li>c</li>\n</ol><ol start="4"><li>d</ol></div>')),
        (2, "u", page('<div class="postBody"><p>x</p><pre>def f():\n    a = 1\n\n\n    return  a\n</pre><p>y</p></div>')),
        (3, "u", page('<div class="postBody"><blockquote>\n<p>one</p>\n<p>two</p>\n</blockquote><p>three</p></div>')),
        (4, "u", page('<div class="postBody"><ul><li><p>a</p></li><li><p>b</p><p>c</p></li></ul></div>')),
        (5, "u", page('<div class="postBody"><ul><li>a<ul><li>b</li><li>c<ul><li>d</li></ul></li></ul></li><li>e</li></ul></div>')),
        (6, "u", page('<div class="postBody"><p>a<a href="/e"></a>b<br>c</p><hr><p>d</p></div>')),
        (7, "u", page('<div class="postBody"><table><tr><th>h</th><th><p>i</p></th></tr><tr><td>1</td><td>2</td></tr></table></div>')),
        (8, "u", page('<div class="postBody"><blockquote><ul><li>a</li></ul><pre>x\n y</pre></blockquote></div>')),
    ])
    assert md[1] == "1. a\n2. b\n3. c\n\n4. d"
    assert md[2] == "x\n\n```\ndef f():\n    a = 1\n\n\n    return  a\n```\n\ny"
    assert md[3] == "> one\n>\n> two\n\nthree"
    assert md[4] == "* a\n\n* b\n\n  c"
    assert md[5] == "* a\n  + b\n  + c\n    - d\n* e"
    assert md[6] == "ab  \nc\n\n---\n\nd"
    assert md[7] == "| h | i |\n| --- | --- |\n| 1 | 2 |"
    assert md[8] == "> * a\n>\n> ```\n> x\n>  y\n> ```"


def test_licence_blocks_nested_and_rewritten(render_pages):
    deep = "<div>" * 45 + "<span>Licensed under CC BY 4.0</span>" + "</div>" * 45
    md = render_pages([
        (1, "u", page(f'<div class="postBody"><p>Text.</p>{deep}</div>')),
        (2, "u", page('<div class="postBody"><p>Text.</p><p>Under <abbr title="Creative Commons">C</abbr></p></div>')),
        (3, "u", page('<div class="postBody"><p>Text.</p><p><a href="/l" title="CC BY"></a></p></div>')),
        (4, "u", page('<div class="postBody"><p>Text.</p><div>Kept <p>CC BY <b>4.0</b></p> tail</div><p>CC <b>BY</b></p></div>')),
    ])
    assert md[1] == md[2] == md[3] == "Text."
    assert md[4] == "Text.\n\nKept tail\n\nCC **BY**"  # stripped pieces join without a space
