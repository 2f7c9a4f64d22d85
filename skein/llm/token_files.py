"""Operator 9: token ids in files, as ranks by frequency in a byte-aligned variable-length code with separate control bytes.

1. Texts are sorted by range of doc_id, one range for each FILE_BYTES of text, and tokenised; each task leaves its ids,
   compressed, in the shared folder, and counts ids. 2. The counts of all documents give each id a rank, the most frequent 0 (a table of the vocabulary's
   size). 3. Each of those files is coded anew, one in a task: two bits of a control byte say how many bytes (1 to 4) a rank takes, the
   ranks' bytes follow the block's control bytes. 4. The files are read back: a table lookup from control bytes to
   lengths gives all places at once.

A file is MAGIC and blocks; a block is a header (numbers of documents, ids and data bytes), doc_ids, null flags, lengths,
control bytes, data bytes. Files are written under a task's own name and then renamed, so a repeated task does no harm;
the first files are removed once the second ones are complete.

Defined results: a null or empty text has only the end id; repeated doc_ids follow each other; a null doc_id comes first;
an empty table gives no rows; further columns play no part; special tokens in a text are what the library makes of them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common

MAGIC = b"RANKVB01"
END_ID = 0
#: Bytes of text in a file.
FILE_BYTES = 16 << 20
_FIELDS = "part int, path string, n_docs long, n_tokens long, id long, count long"

#: Control byte to the lengths of its four ranks, and to their sum.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of non-negative ranks below 2**32."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    size = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    start = np.cumsum(size) - size
    out = raw[start].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        out[more] |= raw[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _header(*numbers: int) -> bytes:
    return np.array(numbers, "<u4").tobytes()


def pack_block(doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, body: list[bytes]) -> bytes:
    head = _header(len(doc_ids), int(lengths.sum()), sum(map(len, body)))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), lengths.astype("<u4").tobytes(), *body])


def read_blocks(stream):
    """(doc_ids, nulls, lengths, number of ids, body) of each block."""
    assert stream.read(len(MAGIC)) == MAGIC, "not a token file"
    while head := stream.read(12):
        n, tokens, size = np.frombuffer(head, "<u4").tolist()
        doc_ids, nulls, lengths = (np.frombuffer(stream.read(w * n), t) for w, t in ((8, "<i8"), (1, bool), (4, "<u4")))
        yield doc_ids, nulls, lengths, tokens, stream.read(size)


class _Writer:
    """A file that appears under its name only when it is complete."""

    def __init__(self, folder: str, name: str):
        self.uri = f"{folder}/{name}"
        self.fs, self.path = pafs.FileSystem.from_uri(self.uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        task = TaskContext.get()
        self.own = f"{self.path}.{task.taskAttemptId() if task else 0}"
        self.out = self.fs.open_output_stream(self.own)
        self.out.write(MAGIC)

    def close(self) -> str:
        self.out.close()
        self.fs.move(self.own, self.path)
        return self.uri


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_stream(path)


def _one_a_task(spark, rows: list, schema: str) -> DataFrame:
    """Few rows (one for each file), each in a task of its own."""
    return spark.createDataFrame(rows, schema).repartitionByRange(max(1, len(rows)), "part")


def write_token_files(
    docs: DataFrame, tokenizer_path: str, folder: str, text: str = "text", end_id: int = END_ID, file_bytes: int = FILE_BYTES
) -> tuple[DataFrame, np.ndarray]:
    """Writes the files; returns a table of them (part, path, n_docs, n_tokens) and the id of each rank."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    common.tidy_shuffles(spark)
    common.bound_batches(spark)

    def tokenised(batches):
        part, tok = TaskContext.get().partitionId(), common.tokenizer(tokenizer_path)
        kind = tok.dtype.itemsize
        counts = np.zeros(max(tok.tokenizer.get_vocab_size(), end_id + 1), np.int64)
        docs_seen, tokens_seen, writer = 0, 0, None
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            for a, b in common.batches_of_bytes(texts):
                writer = writer or _Writer(f"{folder}/raw", f"part-{part:06d}")
                found = [np.append(x, tok.dtype.type(end_id)) for x in tok.ids(texts[a:b])]
                flat = np.concatenate(found)
                counts += np.bincount(flat, minlength=len(counts))
                some = ids.slice(a, b - a)
                body = pa.compress(flat.astype(f"<u{kind}").tobytes(), "zstd", asbytes=True)
                lengths = np.array([len(x) for x in found])
                writer.out.write(pack_block(some.fill_null(0).to_numpy(), np.array(some.is_null()), lengths, [bytes([kind]), body]))
                docs_seen, tokens_seen = docs_seen + b - a, tokens_seen + len(flat)
        if writer:
            used = np.flatnonzero(counts)
            col = lambda v, t, n=len(used): pa.array([v] * n, t)
            none = [col(None, pa.int64(), 1), col(None, pa.int64(), 1)]
            file = [pa.array([part], pa.int32()), pa.array([writer.close()]), pa.array([docs_seen]), pa.array([tokens_seen]), *none]
            yield pa.RecordBatch.from_arrays(file, names)
            same = [col(part, pa.int32()), col(None, pa.string()), col(None, pa.int64()), col(None, pa.int64())]
            yield pa.RecordBatch.from_arrays([*same, pa.array(used), pa.array(counts[used])], names)

    names = [x.split()[0] for x in _FIELDS.split(", ")]
    # rows of one id are dealt by hash of the text and row, so that they fill as many files as they need
    hashed, row = F.xxhash64(text).alias("hashed"), F.monotonically_increasing_id().alias("row")
    order = ["doc_id", "hashed", "row"]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text), hashed, row).repartitionByRange(max(1, -(-size // file_bytes)), *order).sortWithinPartitions(*order)
    ordered = ordered.select("doc_id", text)
    tables = common.Tables(spark)
    said = tables.write(ordered.mapInArrow(tokenised, _FIELDS), "token-counts")
    ranked = said.where("id is not null").groupBy("id").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "id").collect()  # a vocabulary at most
    id_of_rank = np.array([r["id"] for r in ranked], np.uint32)
    rank_of_id = np.zeros(int(id_of_rank.max(initial=0)) + 1, np.uint32)
    rank_of_id[id_of_rank] = np.arange(len(id_of_rank), dtype=np.uint32)
    table = spark.sparkContext.broadcast(rank_of_id)

    def recoded(batches):
        for batch in batches:
            paths = []
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("path").to_pylist(), strict=True):
                writer = _Writer(folder, f"part-{part:06d}.tok")
                with _open(raw) as stream:
                    for doc_ids, nulls, lengths, tokens, body in read_blocks(stream):
                        kind = body[0]
                        ids = np.frombuffer(pa.decompress(body[1:], tokens * kind, "zstd", asbytes=True), f"<u{kind}")
                        writer.out.write(pack_block(doc_ids, nulls, lengths, list(encode(table.value[ids]))))
                paths.append(writer.close())
            same = {c: batch.column(c) for c in ("part", "n_docs", "n_tokens")}
            yield pa.RecordBatch.from_pydict({"part": same["part"], "path": pa.array(paths, pa.string()), **same})

    schema = "part int, path string, n_docs long, n_tokens long"
    files = said.where("path is not null").select("part", "path", "n_docs", "n_tokens").collect()  # a row for each file
    made = common.written(_one_a_task(spark, files, schema).mapInArrow(recoded, schema), "token-files")
    common.remove(spark, f"{folder}/raw")
    tables.drop(said)
    return made, id_of_rank


def read_token_files(files: DataFrame, id_of_rank: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (binary, 4 bytes each) of every document, from the files."""
    spark = files.sparkSession
    begins, at = [], 0
    for r in files.select("part", "path", "n_tokens").orderBy("part").collect():  # a row for each file
        begins.append((r["part"], r["path"], at))
        at += r["n_tokens"]
    table = spark.sparkContext.broadcast(id_of_rank)

    def decoded(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with _open(path) as stream:
                    for doc_ids, nulls, lengths, tokens, body in read_blocks(stream):
                        control, lengths = -(-tokens // 4), lengths.astype(np.int64)
                        ids = np.ascontiguousarray(table.value[decode(body[:control], body[control:], tokens)], "<u4")
                        ends = np.cumsum(lengths)
                        each = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                        columns = [pa.array(doc_ids, mask=nulls), pa.array(start + ends - lengths), pa.array(lengths)]
                        columns += [pa.array([zlib.crc32(x) for x in each], pa.int64()), pa.array(each, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
                        start += tokens

    rows = _one_a_task(spark, begins, "part int, path string, start long")
    return rows.mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op9(spark, sf_dir: str) -> DataFrame:
    files, ids = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), common.byte_bpe(), common.table_path(spark, "tokens"))
    return read_token_files(files, ids).drop("ids")
