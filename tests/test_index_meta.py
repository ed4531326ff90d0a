SITE = "https://forum.example.org"


def nodes_of(spark, pages):
    from folio.operators import dom
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return dom.html_nodes(df)


def test_index_heading_and_grouped(spark):
    from folio.operators import index
    heading = ("<html><body><div class='ContentTableOfContents'>toc</div><main>"
               "<h2>Intro</h2><ul><li><a href='/posts/a/one'>One</a></li><li><a href='/posts/b/two'>Two</a></li></ul>"
               "<p><a href='/posts/z/out'>outside</a></p>"
               "<h2>Next</h2><ul><li><a href='/posts/a/one'>Dup</a></li><li><a href=''>empty</a></li>"
               "<li><a href='https://other.example.com/posts/x'>ext</a></li><li><a href='/s/c'>Three</a></li></ul>"
               "</main></body></html>")
    grouped = ("<html><body><main><h2>X</h2><ul><li><a href='/posts/h/x'>H</a></li></ul></main>"
               "<div class='LargeSequencesItem-columns'><div class='LargeSequencesItem-titleAndAuthor'>"
               "<a href='/s/1'>Part One</a></div><div class='LargeSequencesItem-right'>"
               "<a href='/posts/g1/x'>G1</a><a href='/posts/g2/x'>G2</a></div></div>"
               "<div class='LargeSequencesItem-columns'><div class='LargeSequencesItem-right'>"
               "<a href='/posts/g3/x'>G3</a></div></div></body></html>")
    out = index.scan_index(nodes_of(spark, [(1, "u", heading), (2, "u", grouped)]))
    got = sorted((r.page_id, r.ordinal, r.title, r.url, r.section) for r in out.collect())
    assert got == [
        (1, 1, "One", f"{SITE}/posts/a/one", "Intro"),
        (1, 2, "Two", f"{SITE}/posts/b/two", "Intro"),
        (1, 3, "Three", f"{SITE}/s/c", "Next"),
        (2, 1, "G1", f"{SITE}/posts/g1/x", "Part One"),
        (2, 2, "G2", f"{SITE}/posts/g2/x", "Part One"),
        (2, 3, "G3", f"{SITE}/posts/g3/x", "Introduction"),
    ]


def test_author_and_date_strategies(spark):
    from folio.operators import metadata
    ld = '<script type="application/ld+json">{}</script>'
    pages = [
        (1, "u", "<html><head>" + ld.format('{"author": {"name": "Ann"}, "datePublished": "2024-05-10T08:00:00Z"}')
         + "</head><body></body></html>"),
        (2, "u", "<html><head>" + ld.format('{"author": "Ben", "dateCreated": "2023-01-02"}') + "</head><body></body></html>"),
        (3, "u", "<html><head>" + ld.format('[{"author": "List"}]') + ld.format("{bad json")
         + '<meta name="author" content="  <b>Cy  Doe</b> "><meta property="article:published_time" content="2022-03-04T00:00:00Z">'
         + "</head><body></body></html>"),
        (4, "u", '<html><head></head><body><div class="byline"><a class="UsersName-root" href="/u"> Di </a></div>'
         '<time datetime="2021-07-08T09:00">x</time></body></html>'),
        (5, "u", '<html><head></head><body><div class="author">Not me</div></body></html>'),
        (6, "u", "<html><head>" + ld.format('{"author": {"url": "x"}}') + "</head><body></body></html>"),
    ]
    meta = {r.page_id: (r.author, r.posted_date) for r in metadata.page_metadata(nodes_of(spark, pages)).collect()}
    assert meta == {1: ("Ann", "2024-05-10"), 2: ("Ben", "2023-01-02"), 3: ("Cy Doe", "2022-03-04"),
                    4: ("Di", "2021-07-08"), 5: ("", ""), 6: ("", "")}
