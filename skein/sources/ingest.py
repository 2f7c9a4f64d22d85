"""From uploaded files to texts: checks of uploads, pages and their sources, tables and JSON files."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as tx

MOST_BYTES, CONTENT_TYPES = 10 * 1024 * 1024, ["application/pdf"]
MOST_PAGES, MOST_CHARS, MOST_OCR_PAGES, SAMPLE = 100, 1_000_000, 100, 5
PAGE_BYTES, DPI, MOST_PIXELS, POINTS = 5 * 1024 * 1024, 200, 20_000_000, 72


def safe_name(filename: Column) -> Column:
    """The last part of a path, with letters, digits, -, _ and dots only; names of more than 255 characters are cut."""
    last = F.substring_index(F.replace(F.coalesce(filename, F.lit("")), F.lit("\\"), F.lit("/")), "/", -1)
    plain = F.regexp_replace(F.replace(F.trim(last), F.lit(" "), F.lit("_")), r"(?U)[^-\w.]", "")
    name = F.regexp_replace(plain, r"^[ ._]+|[ ._]+$", "")
    short = F.concat(F.regexp_replace(F.substring(name, 1, 251), r"[ ._]+$", ""), F.lit(".pdf"))
    return F.when(F.length(name) > 255, short).otherwise(name)


def upload_error(filename: Column, content_type: Column, size: Column, content: Column) -> Column:
    """The first fault of an uploaded file; null if there is none. Whether a file is encrypted or has a catalogue is read from
    its text, not by a parser."""
    name, body = safe_name(filename), F.decode(content, "ISO-8859-1")
    case = F.when(name == "", "invalid_filename").when(~F.lower(name).rlike(r".\.pdf$"), "unsupported_extension")
    case = case.when(F.coalesce(size, F.lit(0)) <= 0, "empty_file").when(size > MOST_BYTES, "file_too_large")
    case = case.when(~F.coalesce(F.lower(content_type).isin(CONTENT_TYPES), F.lit(False)), "unsupported_content_type")
    case = case.when(content.isNull(), "unreadable_file").when(~body.startswith("%PDF-"), "invalid_pdf_header")
    return case.when(F.contains(body, F.lit("/Encrypt")), "encrypted_pdf").when(~F.contains(body, F.lit("/Root")), "invalid_pdf_structure")


def stored_path(owner: Column, name: Column | None = None) -> Column:
    """documents/user_<owner>/<32 hex digits>.pdf; the digits are random, or those of a name."""
    digits = F.md5(name) if name is not None else F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return F.concat(F.lit("documents/user_"), owner.cast("string"), F.lit("/"), digits, F.lit(".pdf"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, size, content of the files in a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("size"), "content")


def scan_pages(found: DataFrame, reader: Callable[[bytes], Iterable[tuple[str, int]]]) -> DataFrame:
    """path, page (from 1), native_text, page_bytes of files: `reader` gives text and content size of each page of a file."""
    def scan(batches):
        for batch in batches:
            rows = [(p, k, t, n) for p, c in zip(batch["path"], batch["content"], strict=True) for k, (t, n) in enumerate(reader(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "native_text", "page_bytes"])

    return found.select("path", "content").mapInPandas(scan, "path string, page int, native_text string, page_bytes long")


def page_bytes(streams: DataFrame) -> DataFrame:
    """doc_id, page, bytes, too_large of streams (doc_id, page, declared, raw, decoded): a page's size is the sum over its streams
    of the first of decoded, raw and declared sizes that is known."""
    size = F.coalesce("decoded", "raw", "declared", F.lit(0))
    sums = streams.groupBy("doc_id", "page").agg(F.sum(size).alias("bytes"))
    return sums.withColumn("too_large", F.col("bytes") > PAGE_BYTES)


def raster(width: Column, height: Column, rotation: Column, dpi: int = DPI) -> Column:
    """struct: width and height in pixels and whether the picture of a page would be too large; null for impossible sizes."""
    turned = F.pmod(rotation, F.lit(180)) != 0
    side = lambda a, b: F.greatest(F.ceil(F.when(turned, b).otherwise(a) / POINTS * dpi), F.lit(1)).cast("long")
    w, h = side(width, height), side(height, width)
    fine = (width > 0) & (height > 0) & (width < float("inf")) & (height < float("inf"))
    return F.when(fine, F.struct(w.alias("width"), h.alias("height"), (w * h > MOST_PIXELS).alias("too_large")))


def page_source(native: Column, ocr: Column) -> Column:
    """native, ocr or none: the first text that is usable."""
    usable = lambda c: tx.usability(tx.clean_text(F.coalesce(c, F.lit(""))))["usable"]
    return F.when(usable(native), "native").when(usable(ocr), "ocr").otherwise("none")


def sample_class(pages: DataFrame, sample: int = SAMPLE, total: int = 100, mean: int = 30) -> DataFrame:
    """doc_id, probable_source by the usable pages among the first ones: many characters in all, or on average over all sampled."""
    u = tx.usability(tx.clean_text(F.coalesce("native_text", F.lit(""))))
    first = pages.where(F.col("page") <= sample).select("doc_id", u.alias("u"))
    n = first.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("int").alias("sampled_pages"), F.count_if("u.usable").cast("int").alias("usable_pages"),
        F.coalesce(F.sum(F.when(F.col("u.usable"), F.col("u.solid"))), F.lit(0)).alias("usable_chars"),
    )
    native = (F.col("usable_chars") >= total) | (F.col("usable_chars") / F.col("sampled_pages") >= mean)
    return n.withColumn("probable_source", F.when(native, "probably_native").otherwise("probably_scanned"))


def extracted(pages: DataFrame, most_pages: int = MOST_PAGES, most_chars: int = MOST_CHARS, most_ocr: int = MOST_OCR_PAGES) -> DataFrame:
    """A row for each document of pages (doc_id, page, native_text, ocr_text): text of the chosen pages, counts, source, warnings,
    status, error and checksum."""
    chosen = pages.withColumn("from", page_source(F.col("native_text"), F.col("ocr_text")))
    chosen = chosen.withColumn("chosen", F.when(F.col("from") == "native", F.col("native_text")).when(F.col("from") == "ocr", F.col("ocr_text")))
    count = lambda kind: F.count_if(F.col("from") == kind).cast("int")
    rows = chosen.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("int").alias("page_count"), count("native").alias("native_pages"), F.count_if(F.col("from") != "native").cast("int").alias("ocr_pages"),
        count("none").alias("empty_pages"), F.coalesce(F.sum(F.length("chosen")), F.lit(0)).alias("n"),
    )
    error = F.when(F.col("page_count") > most_pages, "too_many_pages").when((F.col("ocr_pages") > 0) & (F.col("page_count") > most_ocr), "too_many_ocr_pages")
    error = error.when(F.col("n") > most_chars, "extracted_text_too_large")
    rows = rows.withColumn("error", error)
    fine = chosen.join(rows.where("error is null").select("doc_id"), "doc_id", "left_semi")  # only bounded texts are joined
    joined = fine.groupBy("doc_id").agg(F.expr("listagg(chosen, '\n\n') within group (order by page)").alias("joined"))
    rows = rows.join(joined, "doc_id", "left").withColumn("text", F.when(F.col("error").isNull(), tx.clean_text(F.coalesce("joined", F.lit("")))))
    source = F.when((F.col("native_pages") > 0) & (F.col("ocr_pages") > 0), "mixed").when(F.col("ocr_pages") > 0, "ocr").otherwise("native")
    warnings = F.concat_ws(",", F.when(F.col("text") == "", "no_extractable_text"), F.when(F.col("empty_pages") > 0, "ocr_returned_no_usable_text"))
    return rows.select(
        "doc_id", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), "error", "page_count", "native_pages", "ocr_pages", "empty_pages",
        source.alias("source"), warnings.alias("warnings"), "text", (F.length("text") > 0).alias("has_text"), F.sha2("text", 256).alias("text_sha256"),
    )


def questions(spark: SparkSession, path: str) -> DataFrame:
    """id, type, question, expected of a JSON file that holds one list."""
    return spark.read.schema("id int, type string, question string, expected string").option("multiLine", True).json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines; a folder that is there is replaced as a whole."""
    rows.write.mode("overwrite").json(path)


def report_path(folder: str, valid: bool, stamp: str) -> str:
    """Where a benchmark's results go: valid ones to one place, others beside it under their time."""
    return f"{folder}/results_final" if valid else f"{folder}/incident_{stamp}"


def parsed_vectors(rows: DataFrame, dimension: int) -> DataFrame:
    """rows (chunk_id, status, vector as JSON) with `embedding`; fails if a completed row's list is malformed."""
    v = F.from_json("vector", "array<double>")
    good = (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull())
    bad = F.raise_error(F.concat(F.lit("malformed vector of chunk "), F.col("chunk_id").cast("string"))).cast("array<double>")
    return rows.withColumn("embedding", F.when(F.coalesce(good, F.lit(False)), v).when(F.col("status") == "completed", bad))


def without(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of documents that are deleted or extracted anew."""
    return {k: t.join(gone.select("doc_id").distinct(), "doc_id", "left_anti") for k, t in tables.items()}
