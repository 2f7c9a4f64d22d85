from html.parser import HTMLParser

import pytest

from skein.functions import html


class Brute(HTMLParser):
    """The library's parser, with the same lines."""

    CDATA_CONTENT_ELEMENTS = html.RAW
    RCDATA_CONTENT_ELEMENTS = ()

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.raw, self.title, self.lines = None, None, [""]

    def handle_starttag(self, tag, attrs):
        self.raw = tag if tag in html.RAW else None
        if tag in html.BLOCKS:
            self.lines.append("")

    def handle_endtag(self, tag):
        self.raw = None
        if tag in html.BLOCKS:
            self.lines.append("")

    def handle_data(self, data):
        if self.raw == "title":
            self.title = (self.title or "") + data
        elif self.raw is None:
            self.lines[-1] += data

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def brute(page):
    p = Brute()
    p.feed(page)
    p.close()
    clean = lambda t: " ".join(html.references.unescape(t).replace("\f", " ").split(" ")).strip()
    lines = [" ".join(x for x in html._SPACE.sub(" ", html.references.unescape(t)).split(" ") if x) for t in p.lines]
    return clean(p.title or ""), "\n".join(x for x in lines if x)


@pytest.mark.parametrize("page", [
    "", "plain", "<p>a<p>b", "a<br>b<br/>c", "<div>a <b>b</b>c</div>d", "<ul><li>x<li>y</ul>", "<p title='a>b'>c</p>", '<a href="x>y">z</a>',
    "<script>var a = '<p>no</p>';</script>yes", "<style>p{}</style><p>s</p>", "<!-- <p>no</p> -->yes", "<!DOCTYPE html><html><body>t</body></html>",
    "a &amp; b &lt;c&gt; &eacute;&#233;&#xe9;", "<title>T &amp; t</title><body>x", "<p>un<i>closed", "x<h1>y</h1>z", "<TABLE><TR><TD>a<TD>b</TABLE>",
])
def test_pages_equal_the_librarys_parser(page):
    assert html.page_text(page) == brute(page)


def test_pages_of_the_given_table_equal_the_librarys_parser(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        if r.html.rstrip().endswith("</html>"):
            assert html.page_text(r.html) == brute(r.html)


@pytest.mark.parametrize("page, text", [
    ("a < b and c<3", "a < b and c<3"), ('<a href="open>text</a> more', "text more"), ("<p>text<a hre", "text"), ("x<!-- open", "x"), ("<script>open", ""),
    ("a</nothing>b", "ab"), ("a<>b", "a<>b"), ("&am", "&am"), ("&amp", "&"), (None, ""), ("<p>a</p><title>late</title>b", "a\nb"), ("a<?php x ?>b", "ab"),
])
def test_broken_markup(page, text):
    assert html.page_text(page)[1] == text


def test_long_pages_take_linear_time():
    for page in ("<" * 100_000, "<a '" * 20_000, "<!--" * 20_000, "<p>" * 100_000, "&" * 100_000, "<a b=\"" + "x" * 500_000):
        html.page_text(page)


def test_other_columns_are_kept(spark):
    df = spark.createDataFrame([(1, "<p>x", "mine"), (2, None, "t")], "page_id long, html string, TITLE string")
    assert sorted(tuple(r) for r in html.page_texts(df).collect()) == [(1, "", "x"), (2, "", "")]


def test_workers_get_and_give_pages_by_bytes(spark, monkeypatch):
    """However many rows a batch could have, a worker holds few pages at once, and every one is read."""
    monkeypatch.setattr(html, "BATCH", 4000)
    monkeypatch.setattr(html, "BYTES", 1000)
    page = "<title>t</title><p>" + "x" * 180
    real = html.pa.RecordBatch.from_arrays
    df = spark.createDataFrame([(k, page + str(k)) for k in range(400)] + [(400, None), (401, "<p>" + "y" * 9000)], "page_id long, html string").coalesce(1)
    got = {r.page_id: r.native_text for r in html.page_texts(df).collect()}
    assert got == {k: "x" * 180 + str(k) for k in range(400)} | {400: "", 401: "y" * 9000}
    sizes = df.mapInArrow(lambda batches: (real([html.pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert max(r.n for r in sizes) < 100 and sum(r.n for r in sizes) == 402
