"""Queries over the web pages: their texts, and documents made of a host's pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import html
from skein.functions import text as tx
from skein.plans.queries import query
from skein.sources import ingest

_REFERENCES = ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")


def _referred(c: str) -> str:
    for sign, plain in _REFERENCES:
        c = f"replace({c}, '{sign}', '{plain}')"
    return f"regexp_replace({c}, '&amp;?', '&', 'g')"


_BLOCK = "|".join(sorted(html.BLOCKS, key=lambda b: (-len(b), b)))
_RAW = "|".join(f"<{r}(?:\\s[^>]*)?>.*?(?:</{r}\\s*>|\\z)" for r in ("script", "style"))
_TITLE = "<title>(.*?)</title>"
#: The markup of the given pages goes by regular expressions; a line break, chr(1), stands for a block's edge meanwhile.
_STRIPPED = f"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?(?:-->|\\z)|{_RAW}', '', 'g'), '(?is){_TITLE}', chr(1), 'g'), '(?i)</?(?:{_BLOCK})(?:[\\s/][^>]*)?(?:>|\\z)', chr(1), 'g')"
_PLAIN = _referred(f"regexp_replace({_STRIPPED}, '</?[a-zA-Z!][^>]*(?:>|\\z)', '', 'g')")
_LINES = f"list_filter(list_transform(string_split({_PLAIN}, chr(1)), lambda x: trim(regexp_replace(x, '[ \\t\\r\\n\\f]+', ' ', 'g'))), lambda x: x <> '')"
_TEXTS = f"SELECT page_id, url, trim({_referred(f"regexp_extract(html, '(?is){_TITLE}', 1)")}) AS title, array_to_string({_LINES}, chr(10)) AS t FROM pages"
_SOLID = r"length(regexp_replace(t, '\s', '', 'g'))::INT"
_ALNUM = r"length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g'))::INT"
_HOST = "lower(regexp_extract(url, '://([^/?#]*)', 1))"


@query("src_page_text", f"SELECT page_id, title, sha256(t) AS text_sha256, {_SOLID} AS solid, {_ALNUM} AS alnum, {_SOLID} >= 12 AND {_ALNUM} >= 8 AS usable FROM ({_TEXTS})")
def _(t):
    texts = html.page_texts(t("pages").select("page_id", "html"))
    return texts.select("page_id", "title", F.sha2("native_text", 256).alias("text_sha256"), tx.usability(F.col("native_text")).alias("u")).select("page_id", "title", "text_sha256", "u.*")


def host_pages(t):
    """The pages of each host as the pages of a document, numbered by page_id."""
    host = F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1))
    texts = html.page_texts(t("pages").select("page_id", host.alias("doc_id"), "html"))
    page = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_id"))
    return texts.select("doc_id", page.alias("page"), "native_text", F.lit(None).cast("string").alias("ocr_text"))


_CLEAN_PAGES = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(joined, '[\x00-\x08\x0b-\x1f]', '', 'g'), '[^\S\n]+(\n|\z)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), "
    r"'^\s+|\s+\z', '', 'g')"
)


@query("src_page_documents", f"""WITH p AS (SELECT {_HOST} AS doc_id, page_id, t, {_SOLID} >= 12 AND {_ALNUM} >= 8 AS usable FROM ({_TEXTS})),
d AS (SELECT doc_id, count(*)::INT AS page_count, count(*) FILTER (usable)::INT AS native_pages, count(*) FILTER (NOT usable)::INT AS ocr_pages,
  coalesce(sum(length(t)) FILTER (usable), 0) AS n, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY page_id) FILTER (usable), '') AS joined FROM p GROUP BY doc_id),
e AS (SELECT *, CASE WHEN page_count > {ingest.MOST_PAGES} THEN 'too_many_pages' WHEN ocr_pages > 0 AND page_count > {ingest.MOST_OCR_PAGES} THEN 'too_many_ocr_pages'
  WHEN n > {ingest.MOST_CHARS} THEN 'extracted_text_too_large' END AS error, {_CLEAN_PAGES} AS text FROM d)
SELECT doc_id, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, error, page_count, native_pages, ocr_pages, ocr_pages AS empty_pages,
  CASE WHEN native_pages > 0 AND ocr_pages > 0 THEN 'mixed' WHEN ocr_pages > 0 THEN 'ocr' ELSE 'native' END AS source,
  concat_ws(',', CASE WHEN error IS NULL AND text = '' THEN 'no_extractable_text' END, CASE WHEN ocr_pages > 0 THEN 'ocr_returned_no_usable_text' END) AS warnings,
  CASE WHEN error IS NULL THEN length(text) > 0 END AS has_text, CASE WHEN error IS NULL THEN sha256(text) END AS text_sha256 FROM e""")
def _(t):
    return ingest.extracted(host_pages(t)).drop("text")


@query("src_page_classes", f"""SELECT doc_id, count(*)::INT AS sampled_pages, count(*) FILTER (usable)::INT AS usable_pages, coalesce(sum(solid) FILTER (usable), 0)::BIGINT AS usable_chars,
  CASE WHEN coalesce(sum(solid) FILTER (usable), 0) >= 100 OR coalesce(sum(solid) FILTER (usable), 0) / count(*) >= 30 THEN 'probably_native' ELSE 'probably_scanned' END AS probable_source
FROM (SELECT {_HOST} AS doc_id, row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) AS page, {_SOLID} AS solid, {_SOLID} >= 12 AND {_ALNUM} >= 8 AS usable FROM ({_TEXTS}))
WHERE page <= 5 GROUP BY doc_id""")
def _(t):
    return ingest.sample_class(host_pages(t))
