"""Token ids in sorted-string-table shards.

A table holds documents in ascending key order in blocks of about ``BLOCK`` bytes. In a
block each key is stored as the length of the prefix it shares with the key before it and
the rest, then the number of ids and the ids, in 16 bits where all ids fit, else 32. After
the blocks come a sparse index (first key, place and checksum of each block), a Bloom filter
over the keys, and a footer of fixed size, so a lookup reads the footer, asks the filter,
searches the index by bisection, and reads one block. A file holds a few tables; each footer
says how long its table is, and files are rolled at a fixed number of tables. ``Shards`` looks
documents up by seeks: it reads the footers of all tables, and then a table's filter and
index and one block.

Defined cases: null or empty text: the end id alone. A null id: the row is left out. Rows
that repeat an id: the smallest text stays. Empty table: no tables, empty result. Other
input columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import scratch
from quillspark.llm.blobs import Files, read_blobs, write_blobs
from quillspark.llm.tokens import encoder, groups

END_ID = 2
BLOCK, TABLE = 64 << 10, 8 << 20
MAGIC = b"QSST0001"
FOOTER = struct.Struct(">QQQQQQQ8s")  # documents, ids, index at, filter at, filter hashes, length, first key, magic
INDEX = struct.Struct(">QQII")  # first key, place, length, checksum
_SIGN = 1 << 63


def key_bytes(doc_id: int) -> bytes:
    """Eight bytes that sort as the signed number does."""
    return struct.pack(">Q", doc_id + _SIGN)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _unvarint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.adler32(key[::-1]) * 2654435761 | 1
    return [(a + i * b) % bits for i in range(hashes)]


class TableWriter:
    """Collects (doc_id, ids) in ascending order; ``finish`` gives the table's bytes."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.index: list[tuple[int, int, int, int]] = []
        self.block = bytearray()
        self.keys: list[bytes] = []
        self.at = self.ids = 0
        self.first = 0
        self.last = b""

    def add(self, doc_id: int, ids: bytes) -> None:
        """``ids``: little-endian unsigned 32-bit."""
        key = key_bytes(doc_id)
        shared = 0
        if self.block:
            while shared < 8 and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = doc_id + _SIGN
        a = np.frombuffer(ids, "<u4")
        narrow = not len(a) or a.max() < 1 << 16
        self.block += bytes([shared]) + key[shared:] + _varint(len(a) << 1 | narrow)
        self.block += a.astype("<u2").tobytes() if narrow else ids
        self.last = key
        self.keys.append(key)
        self.ids += len(a)
        if len(self.block) >= BLOCK:
            self._close()

    def _close(self) -> None:
        if self.block:
            b = bytes(self.block)
            self.index.append((self.first, self.at, len(b), zlib.crc32(b)))
            self.parts.append(b)
            self.at += len(b)
            self.block = bytearray()

    def finish(self) -> bytes:
        self._close()
        hashes, bits = 7, max(64, 10 * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, np.uint8)
        for k in self.keys:
            bloom[_probes(k, bits, hashes)] = 1
        index = b"".join(INDEX.pack(*x) for x in self.index)
        filt = np.packbits(bloom).tobytes()
        size = self.at + len(index) + len(filt) + FOOTER.size
        return b"".join([*self.parts, index, filt, FOOTER.pack(len(self.keys), self.ids, self.at, self.at + len(index), hashes, size, self.index[0][0], MAGIC)])


class Table:
    """Reads a table; ``get`` looks one document up. ``read(at, n)`` gives ``n`` bytes from ``at``
    on in the table, whose ``length`` includes the footer."""

    def __init__(self, read: Callable[[int, int], bytes], length: int):
        self.read = read
        n, self.n_ids, at, filt, self.hashes, _, self.first, magic = FOOTER.unpack(read(length - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table")
        self.n_docs = n
        known = read(at, length - FOOTER.size - at)
        self.index = list(INDEX.iter_unpack(known[: filt - at]))
        self.starts = [x[0] for x in self.index]
        self.filter = np.frombuffer(known, np.uint8, offset=filt - at)

    @classmethod
    def of(cls, data: bytes) -> Table:
        """A table that is in memory as a whole."""
        view = memoryview(data)
        return cls(lambda at, n: view[at : at + n], len(data))

    def block(self, k: int) -> Iterator[tuple[int, np.ndarray]]:
        _, at, n, crc = self.index[k]
        b = bytes(self.read(at, n))
        if zlib.crc32(b) != crc:
            raise ValueError("a block's checksum is wrong")
        i, key = 0, b""
        while i < n:
            shared = b[i]
            key = key[:shared] + b[i + 1 : i + 9 - shared]
            m, i = _unvarint(b, i + 9 - shared)
            width = 2 if m & 1 else 4
            ids = np.frombuffer(b, "<u2" if m & 1 else "<u4", m >> 1, i).astype("<u4")
            i += (m >> 1) * width
            yield struct.unpack(">Q", key)[0] - _SIGN, ids

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def get(self, doc_id: int) -> np.ndarray | None:
        key = key_bytes(doc_id)
        if not all(self.filter[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(key, 8 * len(self.filter), self.hashes)):
            return None
        k = bisect.bisect_right(self.starts, doc_id + _SIGN) - 1
        return next((ids for i, ids in self.block(k) if i == doc_id), None) if k >= 0 else None


def _backwards(read: Callable[[int, int], bytes], size: int) -> list[tuple[int, int, int]]:
    """(place, length, first key) of a file's tables, in order; each is followed by a line feed."""
    out, end = [], size - 1
    while end > 0:
        x = FOOTER.unpack(read(end - FOOTER.size, FOOTER.size))
        out.append((end - x[5], x[5], x[6]))
        end -= x[5] + 1
    return out[::-1]


class Shards:
    """Lookups in written tables by seeks. One entry a table (of some megabytes) is kept."""

    def __init__(self, spark: SparkSession, path: str):
        self.files = Files(spark, path)
        found = [(first, name, at, n) for name, size in self.files.sizes().items() for at, n, first in _backwards(partial(self.files.read, name), size)]
        self.tables = sorted(found)
        self.firsts = [x[0] for x in self.tables]

    def get(self, doc_id: int) -> np.ndarray | None:
        k = bisect.bisect_right(self.firsts, doc_id + _SIGN) - 1
        if k < 0:
            return None
        _, name, at, n = self.tables[k]
        return Table(lambda i, m: self.files.read(name, at + i, m), n).get(doc_id)


def tables(content: bytes) -> list[memoryview]:
    """The tables of a file, in order."""
    view = memoryview(content)
    return [view[at : at + n] for at, n, _ in _backwards(lambda at, n: view[at : at + n], len(content))]


def _encode(path: str, keep_space: bool):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, keep_space)
        end = np.array([END_ID], "<u4").tobytes()
        table, size = TableWriter(), 0
        rows = ((i, t) for pdf in batches for i, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()))
        for ids, texts in groups(rows):
            for i, b in zip(ids, enc.encode(texts)):
                table.add(i, b + end)
                size += len(b) // 2
                if size >= TABLE:
                    yield pd.DataFrame({"blob": [table.finish()]})
                    table, size = TableWriter(), 0
        if size or table.keys:
            yield pd.DataFrame({"blob": [table.finish()]})

    return f


def write_tables(docs: DataFrame, out: str, path: str, keep_space: bool = True, key: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` and write them to ``out`` in ascending key order over its files."""
    spark = docs.sparkSession
    scratch.small_batches(spark)
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    d = scratch.one_row_per_id(d, "doc_id").repartitionByRange(scratch.parts(spark, docs), "doc_id").sortWithinPartitions("doc_id")
    write_blobs(d.mapInPandas(_encode(path, keep_space), "blob binary"), "blob", out)


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            for k, t in enumerate(tables(content)):
                n, ids, *_, first, _magic = FOOTER.unpack(t[-FOOTER.size :])
                out.append((path, k, first - _SIGN, n, ids))
        yield pd.DataFrame(out, columns=["path", "table", "first_key", "n_docs", "n_ids"])


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            for k, t in enumerate(tables(content)):
                out, start = [], 0
                for i, ids in Table.of(t):
                    out.append((path, k, i, start, len(ids), ids.tobytes()))
                    start += len(ids)
                    if len(out) >= 1000:
                        yield pd.DataFrame(out, columns=["path", "table", "doc_id", "start", "n_tokens", "ids"])
                        out = []
                yield pd.DataFrame(out, columns=["path", "table", "doc_id", "start", "n_tokens", "ids"])


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ``start`` counts the ids of all documents before."""
    files = read_blobs(spark, path)
    # one row a table of up to 8 MB of ids: the only rows that meet in one task
    heads = files.mapInPandas(_footers, "path string, table int, first_key long, n_docs long, n_ids long")
    before = F.sum("n_ids").over(Window.orderBy("first_key", "path", "table").rowsBetween(Window.unboundedPreceding, -1))
    heads = scratch.stage(heads.select("path", "table", F.coalesce(before, F.lit(0)).alias("before")), "heads")
    rows = files.mapInPandas(_documents, "path string, table int, doc_id long, start long, n_tokens long, ids binary")
    return rows.join(heads, ["path", "table"]).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def byte_pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_tables(spark, sf_dir: str) -> DataFrame:
    out = scratch.new_dir(spark, "tables")
    write_tables(scratch.table(spark, sf_dir, "documents"), out, byte_pieces_path())
    return read_tables(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
