"""Helpers that the operators of this subpackage share: shared folder, materialisation, safe column names, tokenizer."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.hashing import hash_spans
from skein.shipping import ship

#: Where Spark takes the place of shared files from; every executor and the driver see this folder.
SHARED = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only on one machine (tests, local runs) may it be unset, then it is a temporary one."""
    found = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED)
    jsc = spark.sparkContext._jsc.sc()
    if not found and jsc.getCheckpointDir().isDefined():
        found = jsc.getCheckpointDir().get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SHARED} is unset: name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-skein-", dir="/tmp")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder: computed once, lineage cut, safe if executors go."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that Spark can reach."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Tables:
    """Tables of one job in the shared folder, which can be removed as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = table_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def follow(self, df: DataFrame, table: DataFrame) -> None:
        """df, made from the table, stands for it from now on."""
        self.paths[id(df)] = (df, self.paths.pop(id(table))[1])

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if found := self.paths.pop(id(df), None):
                remove(self.spark, found[1])


def tidy_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove a query's shuffle files when the query ends, so that many-step jobs don't pile them up. The setting stays in
    the session."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df doesn't have (in any case of letters), one for each stem."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_bucket(doc_id, n: int):
    """crc32 of the id's decimal text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(n)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


# --- tokenizer -----------------------------------------------------------------------------------------------------

#: Pieces of texts whose ids a worker remembers, and their bytes and ids; when full, it starts anew (results don't depend on it).
MEMORY_PIECES, MEMORY_IDS, LONGEST_PIECE = 400_000, 1 << 22, 64


def _bytes_of(*spans: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in spans:
        table[a : b + 1] = True
    return table


_LETTER = _bytes_of((65, 90), (97, 122))
#: Bytes that surely don't begin a space: printable ASCII, and lead bytes under which Unicode has no space.
_SOLID = _bytes_of((33, 126), (0xC3, 0xE0), (0xE4, 0xF4))
#: ASCII punctuation and the line's end.
_MARK = _bytes_of((10, 10), (33, 47), (58, 64), (91, 96), (123, 126))
_BEFORE_LINE = _LETTER | _bytes_of((44, 44), (46, 46), (48, 57), (95, 95))


class CachedTokenizer:
    """Ids of whole texts by a byte-level BPE of the tokenizers library.

    Such a vocabulary splits a text, before it merges anything, in front of a single space that no space follows, between
    a letter and a punctuation mark or line end, and between a line's end behind a word and a letter. So the pieces
    between those places can be encoded one by one, and each distinct piece once; pieces are told apart by 64-bit hashes.
    A text that has a special token of the vocabulary is encoded as a whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u4" if self.tokenizer.get_vocab_size() > 65536 else "<u2")
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True  # its sign for a space
        self.forget()

    def forget(self) -> None:
        self.hashes, self.row = np.empty(0, np.uint64), np.empty(0, np.int64)  # of the pieces that are known, sorted
        self.begin, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0

    def ids(self, texts) -> list[np.ndarray]:
        texts = [t or "" for t in texts]
        special = [any(x in t for x in self.specials) for t in texts]
        out = self._plain(["" if s else t for t, s in zip(texts, special, strict=True)])
        for k in np.flatnonzero(special).tolist():
            out[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, self.dtype)
        return out

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        parts = [utf8(t) for t in texts]
        edges = np.cumsum([0, *map(len, parts)])
        raw = b"".join(parts)
        if not raw:
            return [np.empty(0, self.dtype) for _ in texts]
        data = np.frombuffer(raw, np.uint8)
        start = self._cuts(data, edges)
        end = np.append(start[1:], len(raw))
        one_each, first, of = np.unique(hash_spans(data, start, end), return_index=True, return_inverse=True)
        if len(self.hashes) > MEMORY_PIECES or self.used > MEMORY_IDS:
            self.forget()
        at = self._places(raw, one_each, start[first], end[first])
        size = self.size[at][of]
        ends = np.cumsum(size)
        flat = self.flat[np.arange(ends[-1]) + np.repeat(self.begin[at][of] - ends + size, size)]
        bounds = np.concatenate(([0], ends))[np.searchsorted(start, edges)]
        return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    @staticmethod
    def _cuts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where pieces begin."""
        after = np.append(data[1:], 32).astype(np.uint8)
        after[edges[1:] - 1] = 32  # what follows in the next text doesn't count
        cut = (data == 32) & _SOLID[after]
        cut[1:] |= _LETTER[data[:-1]] & _MARK[data[1:]]
        cut[2:] |= _BEFORE_LINE[data[:-2]] & (data[1:-1] == 10) & _LETTER[data[2:]]
        cut[edges[:-1][edges[:-1] < len(data)]] = True
        return np.flatnonzero(cut)

    def _places(self, raw: bytes, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rows of begin and size for each piece; new pieces are encoded. Long ones are forgotten after this call."""
        found = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = found < len(self.hashes)
        known[inside] = self.hashes[found[inside]] == hashes[inside]
        at = np.full(len(hashes), -1, np.int64)
        at[known] = self.row[found[known]]
        rows, used = len(self.hashes), self.used
        spaces = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.uint8) == 32)))
        word = (spaces[end] - spaces[start] == 1) & (spaces[start + 1] - spaces[start] == 1) & (end - start > 1)
        short = end - start <= LONGEST_PIECE
        for kind in (short & word, short & ~word, ~short):  # long ones last, behind all that stays
            new = np.flatnonzero(~known & kind)
            if not len(new):
                continue
            pieces = [raw[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            sizes, ids = self._encoded(pieces, bool(word[new[0]]) and bool(short[new[0]]))
            need, total = rows + len(new), used + len(ids)
            if need > len(self.size):
                self.begin, self.size = (np.concatenate((x, np.zeros(need, np.int64))) for x in (self.begin, self.size))
            if total > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros(total, self.dtype)))
            self.begin[rows:need], self.size[rows:need] = used + np.cumsum(sizes) - sizes, sizes
            self.flat[used:total] = ids
            at[new] = np.arange(rows, need)
            if short[new[0]]:
                place = np.searchsorted(self.hashes, hashes[new])
                self.hashes, self.row = np.insert(self.hashes, place, hashes[new]), np.insert(self.row, place, at[new])
                self.used = total
            rows, used = need, total
        return at

    def _encoded(self, pieces: list[bytes], words: bool) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all ids). Words, which have one space each, in front, are encoded as one text: ids
        that stand for a space begin a word."""
        if words:
            text = b"".join(pieces).decode("utf-8", "surrogatepass")
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            begin = np.flatnonzero(self.spaced[ids])
            if len(begin) == len(pieces):
                return np.diff(np.append(begin, len(ids))), ids
        texts = [x.decode("utf-8", "surrogatepass") for x in pieces]
        each = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([len(x) for x in each], np.int64), np.array([x for ids in each for x in ids], self.dtype)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> CachedTokenizer:
    return CachedTokenizer(path)


def batches_of_bytes(texts, most: int = 1 << 20):
    """Cuts a list of texts into runs of about `most` characters; yields (from, to)."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text) if text is not None else 0
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def byte_bpe() -> str:
    """Where the public byte-level vocabulary lies; the file is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bounds the bytes of texts that a Python worker gets at once, and the rows that a Parquet reader holds, so that very long texts
    and arrays don't pile up. These settings stay in the session."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")
