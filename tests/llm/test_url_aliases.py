"""Alias edges that dot segments, further tags and lists of link types make."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from farandole.llm import urls


@pytest.mark.parametrize("link", ["../f", "./f", "../../../f", "/x/../f", "/x/./y/..", "a/.", "..", "../.hidden", "g..", "/a//../b", "f?q=../x"])
def test_dot_segments(spark, link):
    row = spark.createDataFrame([("http://third.io/d/e", link)], "url string, link string").select(urls.node_of(urls._resolved(F.col("link"), F.col("url")))).first()
    assert row[0] == urljoin("http://third.io/d/e", link).removeprefix("http")


def test_aliases(spark):
    link = lambda u, rel="canonical": f'<link rel="{rel}" href="{u}">'
    rows = [
        (1, "http://third.io/d/e", link("../f")), (2, "http://third.io/f", link("http://z.com/en/a")),  # 1 reaches 2's block
        (3, "http://two.io/", link("http://nowhere.io/") + link("http://z.com/en/b")), (4, "http://three.io/", '<meta http-equiv=refresh content="0; url=/x"><meta http-equiv=refresh content="1; url=http://z.com/en/c">'),
        (5, "http://rel.io/", link("http://z.com/en/d", "alternate canonical")), (6, "http://not.io/", link("http://z.com/en/e", "alternate")), (7, "http://dots.io/a/../b", link("http://z.com/en/f")), (8, "http://dots.io/b", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judged(pages, urls.rule_table(spark)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "block", 8: "block"}
