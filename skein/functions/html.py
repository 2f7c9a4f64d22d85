"""Title and visible text of web pages.

A page is read from left to right: comments, declarations, tags with their attributes (a '>' within quotes doesn't end a tag),
elements whose content isn't markup, and text between them. Blocks begin new lines; other tags leave no trace. A tag without
its partner changes nothing else; a quote that is never closed ends with its tag; what a page breaks off in is read as far as
it goes. Character references count in text and titles.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = r"[a-zA-Z][^\s/>]*"
_TOKEN = re.compile(
    rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?:/?{_NAME}(?:[^>\"']|\"[^\"]*\"|'[^']*')*|/?{_NAME}[^>]*|[!?/][^>]*)(?:>|\Z)", re.S
)
_TAG = re.compile(rf"</?({_NAME})")
#: Elements whose content is no markup; of these only a title has text.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp")
#: Elements that begin and end lines.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
#: Bytes of pages that a worker is sent at once, and whose texts it holds at once.
BATCH, BYTES = 8 << 20, 1 << 20
_SPACE = re.compile(r"[ \t\r\n\f]+")


def pieces(page: str) -> Iterator[tuple[str, str]]:
    """(kind, value): text, start and end of elements by lower-case name, and raw content under the element's name."""
    at, n = 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            yield "text", page[at:]
            return
        token = _TOKEN.match(page, begin)
        if token is None:  # a '<' that begins no tag is text
            yield "text", page[at : begin + 1]
            at = begin + 1
            continue
        if begin > at:
            yield "text", page[at:begin]
        at = token.end()
        tag = _TAG.match(token.group())
        if tag is None:
            continue
        name, closing = tag.group(1).lower(), token.group()[1] == "/"
        yield ("end" if closing else "start"), name
        if not closing and name in _END:
            end = _END[name].search(page, at)
            stop = end.start() if end else n
            yield name, page[at:stop]
            at = stop


def page_text(page: str | None) -> tuple[str, str]:
    """(title, text): the first title on one line; lines of visible text without blanks around them, none empty."""
    title, out, run = None, [], []

    def line() -> None:
        if done := _SPACE.sub(" ", references.unescape("".join(run))).strip(" "):
            out.append(done)
        run.clear()

    for kind, value in pieces(page or ""):
        if kind == "text":
            run.append(value)
        elif kind == "title":
            title = _SPACE.sub(" ", references.unescape(value)).strip(" ") if title is None else title
        elif kind in ("start", "end") and value in BLOCKS:
            line()
    line()
    return title or "", "\n".join(out)


def page_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with title and native_text instead of their markup; a null page has empty ones. A worker gets pages of BATCH bytes at once, or
    one that is larger, and gives back the texts of BYTES of them at a time. The bound on batches stays in the session."""
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    kept = [c for c in pages.columns if c.lower() not in (html.lower(), "title", "native_text")]

    def run(batches):
        for batch in batches:
            size = pa.compute.fill_null(pa.compute.binary_length(batch.column("_html")), 0).to_pylist()
            a, held = 0, 0
            for b, n in enumerate([*size, 0]):
                if b > a and (held + n > BYTES or b == len(size)):
                    yield made(batch.slice(a, b - a))
                    a, held = b, 0
                held += n

    def made(batch):
        texts = [page_text(x.as_py()) for x in batch.column("_html")]
        columns = [*(batch.column(c) for c in kept), pa.array([t for t, _ in texts], pa.string()), pa.array([x for _, x in texts], pa.string())]
        return pa.RecordBatch.from_arrays(columns, [*kept, "title", "native_text"])

    schema = pages.select(*kept, F.lit("").alias("title"), F.lit("").alias("native_text")).schema
    return pages.select(*kept, F.col(html).alias("_html")).mapInArrow(run, schema)
