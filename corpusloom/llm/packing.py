"""Sequence packing by Karmarkar-Karp multiway differencing.

A document's ids are cut where they are made: into whole sequences, and a rest in pieces of at most
``piece`` ids whose last ``tail`` or fewer are a piece of their own, for levelling.  The pieces, without ids,
are dealt by the place of the document among all rows to groups that fill about ``group_windows`` windows, so that
rows which repeat an identifier, or have none, spread like others.  Each group is partitioned
into windows by largest differencing: every piece starts as a partial partition of its own, the two partial
partitions with the largest imbalance are merged with their imbalances opposed, and so on until one is left.
Windows come out nearly equal; when the fullest exceeds the capacity, the window count rises and the group is
partitioned anew.

With a ``folder`` the tasks that make the ids also write them there, as token-id files (``idstore``), and a piece
has the name of its file and its place among that file's ids.

Null texts are empty documents of the end id alone; repeated identifiers are separate documents; no rows give
no pieces and no files; other columns are dropped.  A document's whole sequences take group-local numbers too, so
no step sees more than one group.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import idstore
from .common import materialize, small_batches
from .files import put
from .tokens import encoder

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"
#: Where a piece's ids are, if they are written.
PLACE = "file string, file_start long"


def cuts(n: int, capacity: int, piece: int, tail: int) -> list[int]:
    """Lengths of the pieces of n ids, in order."""
    whole, rest = divmod(n, capacity)
    out = [capacity] * whole
    small = rest % tail if rest > tail else 0
    rest -= small
    out += [piece] * (rest // piece)
    if rest % piece:
        out.append(rest % piece)
    return out + [small] * bool(small)


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of sizes in k parts of nearly equal sums."""
    if k == 1:
        return [list(range(len(sizes)))]
    # A partial partition: the sums above its smallest, ascending, as offsets; empty parts are left out.
    # nodes[i] is a pair of merged parts or a leaf.
    nodes: list = list(range(len(sizes)))
    heap = [(-size, i, np.array([size], np.int64), np.array([i], np.int64)) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(sizes)

    def spread(sums: np.ndarray) -> int:
        return int(sums[-1] - (sums[0] if len(sums) == k else 0))

    while len(heap) > 1:
        _, _, a_sums, a_parts = heapq.heappop(heap)
        _, _, b_sums, b_parts = heapq.heappop(heap)
        # The largest part of one meets the smallest of the other; empty parts are the smallest of all.
        over = max(0, len(a_sums) + len(b_sums) - k)
        sums = np.concatenate([a_sums[over:], b_sums[over:], a_sums[:over] + b_sums[:over][::-1]])
        made = []
        for x, y in zip(a_parts[:over].tolist(), b_parts[:over][::-1].tolist(), strict=True):
            nodes.append((x, y))
            made.append(len(nodes) - 1)
        parts = np.concatenate([a_parts[over:], b_parts[over:], np.array(made, np.int64)])
        order = np.argsort(sums, kind="stable")
        sums, parts = sums[order], parts[order]
        count += 1
        heapq.heappush(heap, (-spread(sums), count, sums, parts))
    out: list[list[int]] = []
    for root in heap[0][3].tolist() if heap else []:
        members, stack = [], [root]
        while stack:
            node = nodes[stack.pop()]
            if isinstance(node, tuple):
                stack.extend(node)
            else:
                members.append(node)
        out.append(sorted(members))
    return out


def windows(sizes: list[int], capacity: int, slack: int) -> list[list[int]]:
    """The fewest windows that differencing fills within the capacity, tried from a count with slack ids to spare each."""
    if not sizes:
        return []
    total = sum(sizes)
    least = k = max(1, -(-total // (capacity - slack)))
    if total <= capacity:
        return [list(range(len(sizes)))]
    while True:
        parts = differencing(sizes, k)
        if max(sum(sizes[i] for i in part) for part in parts) <= capacity:
            return parts
        k += max(1, (k - least) // 2, least // 500)


def pieces_of(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, piece: int, tail: int, id_col: str, text_col: str, folder: str | None = None) -> DataFrame:
    """Encodes every text and lists its pieces with the place of their document; the ids go to files, or no further."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    if folder and kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("token-id files name documents by integers")
    columns = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary), TaskContext.get().partitionId()
        serial, held, names, ids, waiting = part << 40, 0, [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            """Writes the documents held, in ascending order, and passes on their pieces."""
            order = sorted(range(len(names)), key=lambda i: (names[i] is not None, names[i] or 0))
            starts = np.zeros(len(names), np.int64)
            starts[order] = np.cumsum([0, *(len(ids[i]) for i in order)])[:-1]
            file = f"part-{part:06d}-{uuid.uuid4().hex}.efids"
            put(f"{folder}/{file}", idstore.pack([names[i] for i in order], [ids[i] for i in order]))
            for batch, docs_of in waiting:
                at = starts[docs_of] + batch.column(2).to_numpy()
                yield batch.append_column("file", pa.array([file] * batch.num_rows, pa.string())).append_column("file_start", pa.array(at, pa.int64()))

        for batch in batches:
            which, rows, first = [], [], len(names)
            for i, (name, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                own = np.append(encode.ids(text), encode.width.type(end_id))
                wide = own.astype("<u4")
                start = 0
                for n in cuts(len(own), capacity, piece, tail):
                    which.append(i)
                    rows.append((start, n, zlib.crc32(wide[start : start + n].tobytes()), len(own)))
                    start += n
                if folder:
                    names.append(name)
                    ids.append(own)
                    held += len(own)
            if not rows:
                continue
            made = {"doc_id": batch.column(0).take(pa.array(which, pa.int64())), "place": pa.array([serial + i for i in which], pa.int64())}
            made |= {k: pa.array(list(v), pa.int64()) for k, v in zip(columns, zip(*rows, strict=True), strict=True)}
            serial += batch.num_rows
            out = pa.RecordBatch.from_pydict(made)
            if not folder:
                yield out
                continue
            waiting.append((out, np.array(which) + first))
            if held >= idstore.FILE_IDS:
                yield from close()
                held, names, ids, waiting = 0, [], [], []
        if waiting:
            yield from close()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, place long, {PIECES}" + (f", {PLACE}" if folder else ""))


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = 0,
    capacity: int = 1024,
    piece: int = 256,
    tail: int = 64,
    slack: int = 4,
    group_windows: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str | None = None,
) -> DataFrame:
    """A row per piece: where it lies in its document and in its sequence, and in the files of ``folder`` if there is one.

    The number of groups follows the ids and pieces to place, so a group's work is bounded whatever the input.
    """
    pieces = materialize(pieces_of(docs, vocabulary, end_id, capacity, piece, tail, id_col, text_col, folder), "pieces")
    ids, count = pieces.where(F.col("length") < capacity).agg(F.sum("length"), F.count("*")).first()
    groups = max(1, (ids or 0) // (group_windows * capacity), count // (16 * group_windows))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("place"), F.lit(groups)))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "place", "start"], ascending=[False, True, True], kind="stable", ignore_index=True)
        sizes = pdf["length"].to_numpy()
        whole = int((sizes == capacity).sum())
        sequence, offset = np.arange(len(pdf), dtype=np.int64), np.zeros(len(pdf), np.int64)
        for w, members in enumerate(windows(sizes[whole:].tolist(), capacity, slack)):
            at = 0
            for i in members:
                sequence[whole + i], offset[whole + i] = whole + w, at
                at += int(sizes[whole + i])
        pdf["sequence_id"] = (np.int64(pdf["g"].iloc[0]) << 32) + sequence if len(pdf) else sequence
        pdf["offset"] = offset
        return pdf.drop(columns=["g", "place"])

    where = f", {PLACE}" if folder else ""
    return dealt.groupBy("g").applyInPandas(place, f"doc_id {kind}, {PIECES}{where}, sequence_id long, offset long")
