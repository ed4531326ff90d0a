from folio.operators.parser import parse_document


def rows(html):
    b = parse_document(html)
    return [(b.kind[i], b.tag[i], b.text[i], b.parent_id[i], b.end_id[i]) for i in range(len(b.kind))]


def test_unclosed_p_and_b_close_at_next_block():
    b = parse_document("<html><body><article><p><b>x<br><p>y</p></article></body></html>")
    tags = [(b.tag[i], b.depth[i]) for i in range(len(b.kind)) if b.kind[i] == "element"]
    # the second <p> is a sibling of the first, not nested in <b>
    assert tags == [("html", 1), ("body", 2), ("article", 3), ("p", 4), ("b", 5), ("br", 6), ("p", 4)]


def test_script_text_is_raw_and_entities_decode():
    b = parse_document('<head><script>var t="</p>";</script></head><body>a &amp b &copy; &am</body>')
    kinds = {(b.kind[i], b.text[i]) for i in range(len(b.kind)) if b.text[i]}
    assert ("raw", 'var t="</p>";') in kinds
    assert ("text", "a & b © &am") in kinds


def test_intervals_cover_subtrees():
    b = parse_document("<div><p>a</p><p>b</p></div><div>c</div>")
    for i in range(len(b.kind)):
        for j in range(i + 1, b.end_id[i] + 1):
            # every node inside an interval has an ancestor chain reaching i
            k = j
            while k not in (-1, i):
                k = b.parent_id[k]
            assert k == i


def test_implicit_body_and_li_autoclose():
    b = parse_document("<ul><li>a<li>b</ul>")
    tags = [b.tag[i] for i in range(len(b.kind)) if b.kind[i] == "element"]
    assert tags == ["html", "body", "ul", "li", "li"]
    li = [i for i in range(len(b.kind)) if b.tag[i] == "li"]
    assert b.parent_id[li[1]] == b.parent_id[li[0]]


def test_malformed_declarations_and_errors():
    from folio.operators.parser import parse_document
    for html in ("<p>a<![x[b]]>c</p>", "<![", "<!", "<![if x]>y<![endif]>", "<!DOCTYPE [<!x>", "<p <b>x", "&#xFFFFFFFFFF;", "<a href='"):
        b = parse_document(html)
        assert b.kind[0] == "document" and len(b.kind) == len(b.end_id)
    b = parse_document("<p>a<![x[b]]>c</p>")
    assert "error" not in b.kind and [t for k, t in zip(b.kind, b.text) if k == "text"] == ["a", "c"]
