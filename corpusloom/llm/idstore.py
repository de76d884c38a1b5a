"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

A file holds a run of documents in ascending ``doc_id`` order::

    magic, counts                    see HEADER
    Elias-Fano sequence              doc_id minus the smallest one of the file
    Elias-Fano sequence              ids up to the end of each document
    ids                              little-endian, 2 bytes each (4 if the vocabulary needs them)

An Elias-Fano sequence of n values below u takes about ``n * (2 + log2(u / n))`` bits: the low bits of each
value are packed, the high parts are a unary bit vector, and the place of every 256th set bit is sampled, so
``select`` finds any boundary by reading one sampled stretch; files are read back through it, a stretch at a
time.

Nulls and repeats: a null text is empty; null identifiers come first; rows of one identifier stay separate
documents, in the order of their texts' hashes, and as many of them as there may be are spread over tasks.  An
empty table gives no file and no rows; other columns are dropped.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, small_batches
from .files import put
from .tokens import encoder

#: magic, documents, documents without identifier, ids, bytes of an id, smallest doc_id
HEADER = struct.Struct("<8sQQQBq")
MAGIC = b"EFIDS\x00\x00\x01"
EF_HEADER = struct.Struct("<QQB")
SAMPLE = 256
#: Documents that are read back at a time.
STRETCH = 16 * SAMPLE
#: A file is closed once it has this many ids; one longer document makes one longer file.
FILE_IDS = 4 << 20


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
        parts = [np.packbits(low, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), places[::SAMPLE].astype("<u8").tobytes()]
        return EF_HEADER.pack(n, len(high), low_bits) + b"".join(parts)

    @classmethod
    def decode(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The sequence at the start of data, and the bytes that it takes."""
        n, length, low_bits = EF_HEADER.unpack_from(data)
        at = EF_HEADER.size
        sizes = ((n * low_bits + 7) // 8, (length + 7) // 8, 8 * -(-n // SAMPLE))
        ends = np.cumsum((at, *sizes)).tolist()
        low, high = (np.frombuffer(data[a:b], np.uint8) for a, b in zip(ends[:2], ends[1:3], strict=True))
        return cls(n, low_bits, low, high, np.frombuffer(data[ends[2] : ends[3]], "<u8")), ends[3]

    def select(self, i: int) -> int:
        """Value i, from one sampled stretch of the high bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place // 8
        bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")[place % 8 :]
        while left >= (ones := int(bits.sum())):
            left, byte = left - ones, byte + 1
            bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        start = byte * 8 + 8 - len(bits)
        place = start + int(np.flatnonzero(bits)[left])
        value = place - i
        for bit in reversed(range(i * self.low_bits, (i + 1) * self.low_bits)):
            value = value * 2 + (int(self.low[bit // 8]) >> bit % 8 & 1)
        return value

    def selects(self, first: int, last: int) -> np.ndarray:
        """Values first to last - 1, from the sampled stretches that hold them."""
        if not 0 <= first <= last <= self.n:
            raise IndexError((first, last))
        if first == last:
            return np.empty(0, np.int64)
        block, beyond = first // SAMPLE, -(-last // SAMPLE)
        start = int(self.samples[block]) // 8
        end = int(self.samples[beyond]) // 8 + 1 if beyond < len(self.samples) else len(self.high)
        places = np.flatnonzero(np.unpackbits(self.high[start:end], bitorder="little")) + 8 * start
        skipped = int(np.searchsorted(places, int(self.samples[block]))) + first - block * SAMPLE
        ranks = np.arange(first, last)
        out = places[skipped : skipped + last - first].astype(np.int64) - ranks
        if self.low_bits:
            byte = first * self.low_bits // 8
            bits = np.unpackbits(self.low[byte : (last * self.low_bits + 7) // 8], bitorder="little")
            own = bits[first * self.low_bits - 8 * byte :][: len(ranks) * self.low_bits].reshape(len(ranks), self.low_bits)
            out = (out << self.low_bits) + (own.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return out


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A file of documents in ascending order, those without identifier first."""
    nulls = sum(x is None for x in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    base = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(x) for x in ids]) if ids else np.empty(0, np.int64)
    width = ids[0].dtype.itemsize if ids else 2
    head = HEADER.pack(MAGIC, len(ids), nulls, int(ends[-1]) if ids else 0, width, base)
    apart = known.astype(np.uint64) - np.uint64(base & (1 << 64) - 1)
    return b"".join([head, EliasFano.encode(apart), EliasFano.encode(ends), *(x.tobytes() for x in ids)])


class IdFile:
    """The documents of one file's bytes."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, self.n, self.nulls, self.n_ids, width, self.base = HEADER.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        at = HEADER.size
        self.names, used = EliasFano.decode(view[at:])
        at += used
        self.ends, used = EliasFano.decode(view[at:])
        self.ids = np.frombuffer(view[at + used :], f"<u{width}")
        if len(self.ids) != self.n_ids:
            raise ValueError("a token-id file is cut short")

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.base + self.names.select(i - self.nulls)

    def document(self, i: int) -> np.ndarray:
        """The ids of document i, found through select alone."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def stretch(self, first: int, last: int) -> tuple[list[int | None], np.ndarray]:
        """Identifiers of documents first to last - 1, and their boundaries: one more than there are documents."""
        known = self.names.selects(max(0, first - self.nulls), max(0, last - self.nulls)) + self.base
        names = [None] * (last - first - len(known)) + known.tolist()
        before = [] if first else [0]
        return names, np.concatenate([before, self.ends.selects(max(0, first - 1), last)]).astype(np.int64)


def write_ids(docs: DataFrame, vocabulary: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes every text and writes the files; a row per file: its name, place in the order and ids.

    Texts are ranged by identifier before they are encoded, so that one shuffle of texts is all that moves.
    Rows of one identifier are ranged further, by their texts' hashes and, where these agree too, by their place.
    """
    small_batches(docs.sparkSession)
    put(f"{folder}/_STARTED", b"")
    keys = ["doc_id", "hash", "place"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"), F.monotonically_increasing_id().alias("place"))
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, end = TaskContext.get().partitionId(), encoder(vocabulary), np.array([end_id])
        names: list = []
        ids: list = []
        seq = held = 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:06d}-{seq:06d}.efids"
            put(f"{folder}/{name}", pack(names, ids))
            return pa.RecordBatch.from_pydict({"name": [name], "n_docs": [len(names)], "n_ids": [held]})

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held >= file_ids:
                    yield close()
                    names, ids, held, seq = [], [], 0, seq + 1
                names.append(name)
                ids.append(np.concatenate([encode.ids(text), end.astype(encode.width)]))
                held += len(ids[-1])
        if names:
            yield close()

    return materialize(ordered.mapInArrow(write, "name string, n_docs long, n_ids long"), "files")


def read_ids(docs: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """Reads the files back: a row per document with its place among all ids.

    ``files`` has one row per file, some tens of MB of ids each; the running sum over it is the only ordered step.
    """
    starts = files.select("name", (F.sum("n_ids").over(Window.orderBy("name")) - F.col("n_ids")).alias("base"))
    raw = docs.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.efids").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, name = IdFile(data.as_buffer()), path.rpartition("/")[2]
                for first in range(0, held.n, STRETCH):
                    names, edges = held.stretch(first, min(first + STRETCH, held.n))
                    sums = [zlib.crc32(held.ids[a:b].astype("<u4").tobytes()) for a, b in itertools.pairwise(edges.tolist())]
                    yield pa.RecordBatch.from_pydict({"name": [name] * len(names), "doc_id": pa.array(names, pa.int64()), "at": edges[:-1], "n_tokens": np.diff(edges), "ids_crc32": pa.array(sums, pa.int64())})

    rows = raw.select("path", "content").mapInArrow(read, "name string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, "name").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(docs: DataFrame, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Writes the ids of all documents, in files of ``folder``, and returns what the files say of each document."""
    folder = folder or f"{scratch(docs.sparkSession)}/ids"
    return read_ids(docs, write_ids(docs, vocabulary, folder, end_id, id_col, text_col), folder)
