import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from folio.session import get_spark
    s = get_spark("local[2]", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def render_pages(spark):
    """Render helper: inline HTML pages -> {page_id: markdown}."""
    from folio.operators import body, clean, dom, render

    def run(pages):
        df = spark.createDataFrame(pages, "page_id long, url string, html string")
        nodes = dom.html_nodes(df)
        chosen = body.choose_body(nodes)
        md = render.html_to_markdown(clean.drop_noise(clean.scope_nodes(nodes, chosen)))
        return {r.page_id: r.markdown for r in md.collect()}
    return run
