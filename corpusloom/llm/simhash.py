"""SimHash near-duplicates by anchor-point covering.

Fingerprints: 64 bits, bit b set if over half of a text's shingle hashes (XXH64, seed 42) have it set.

Candidates: two fingerprints within ``2 * r + 1`` bits differ by at most r in one of their 32-bit halves.  The
anchors of a half are the words of a covering code: the perfect Hamming code on 31 bits (covering radius 1)
with the last bit free.  Every fingerprint is *at home* at the one anchor within the covering radius of its
half, and is replicated to every anchor within the radius plus r: some 17 anchors for r = 1.  Whatever lies
within r of a fingerprint's half then meets it at that fingerprint's home, so comparing per anchor finds all
links.  Anchors with more than ``crowd`` rows are split: what meets there can differ by at most the threshold
in the other half too, so three blocks of that half, one of which must be equal, divide the crowd; what is still
crowded is split by blocks of the bits that are left, and so on until few are.

Links inside an anchor go out as a spanning forest, never as pairs, and components are joined by alternating
star contraction on edge tables, checkpointed to the shared folder each round; vertices with very many edges,
which are few, get their smallest neighbour by a broadcast, so that no task sees all edges of one.

Null and wordless texts have fingerprint zero and link like any other; rows without identifier get a
fingerprint and the component of their links (null if no linked row has one); repeated rows are one class; no
rows give none; other columns are dropped, or come along in ``row``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, materialize, small_batches

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Rows of one anchor that are compared at once; larger anchors are split by the other half.
CROWD = 4096
#: Edges of a vertex beyond which it is joined apart; with more edges in all, a 50,000th part of them.
HUB = 1_000_000
#: For each syndrome 1..31 the pairs of places of the Hamming code whose flips cancel it.
PAIRS = {s: [(i, i ^ s) for i in range(1, 32) if i < i ^ s] for s in range(1, 32)}


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a text's word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        hashes = [digest(line, 42)]
    else:
        hashes = [digest(line[a : b - 1], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    counts = np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64).astype("<u8")
    for at in range(0, n, 8192):  # a bounded matrix of bits at a time
        counts += np.unpackbits(values[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, carry: bool = False) -> DataFrame:
    """``doc_id``, ``place`` (a number of its own for every row) and ``fp``, the fingerprint as a signed 64-bit integer."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        serial = TaskContext.get().partitionId() << 40

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            nonlocal serial
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            place = np.arange(serial, serial + batch.num_rows)
            serial += batch.num_rows
            return {"doc_id": batch.column(0), "place": pa.array(place, pa.int64()), "fp": pa.array(found.view(np.int64))}

        return work

    return arrow_pass(docs, {"doc_id": F.col(id_col), "text": F.col(text_col)}, make, f"doc_id {kind}, place long, fp long", carry)


def _syndrome(half: np.ndarray) -> np.ndarray:
    """The Hamming syndrome of bits 0..30 of each value, as places 1..31."""
    out = np.zeros(len(half), np.uint32)
    for place in range(1, 32):
        out ^= np.where(half >> np.uint32(place - 1) & np.uint32(1), np.uint32(place), np.uint32(0))
    return out


def anchors_of(half: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, anchors and whether at home, for every anchor within 1 + r bits of each half (r 0 or 1)."""
    half = half.astype(np.uint32)
    syndrome = _syndrome(half)
    rows = np.arange(len(half))
    one = np.uint32(1)
    home = np.where(syndrome > 0, half ^ (one << (np.maximum(syndrome, 1) - one)), half)
    parts = [(rows, home, np.ones(len(half), bool))]
    last = one << np.uint32(31)
    if r >= 1:
        parts.append((rows, home ^ last, np.zeros(len(half), bool)))
        for s in range(1, 32):
            at = rows[syndrome == s]
            for i, j in PAIRS[s]:
                parts.append((at, half[at] ^ (one << np.uint32(i - 1)) ^ (one << np.uint32(j - 1)), np.zeros(len(at), bool)))
    else:
        at = rows[syndrome == 0]
        parts.append((at, home[at] ^ last, np.zeros(len(at), bool)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def replicas(distinct: DataFrame, threshold: int) -> DataFrame:
    """Every distinct fingerprint at its anchors: ``key`` (half and code word), ``fp``, ``home``, and ``free``, the other half's bits."""
    r = threshold // 2

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            bits = fps.view(np.uint64)
            for side in (0, 1):
                half = (bits >> np.uint64(32 * side)).astype(np.uint32)
                row, anchor, home = anchors_of(half, r)
                key = anchor.astype(np.int64) | np.int64(side) << np.int64(32)
                free = np.uint64(0xFFFFFFFF << 32 * (1 - side)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"key": key, "fp": fps[row], "home": home, "free": np.full(len(row), free)})

    return distinct.select("fp").mapInArrow(expand, "key long, fp long, home boolean, free long")


@functools.cache
def blocks_of(free: int, blocks: int) -> list[int]:
    """The bits of a mask, dealt to so many masks in order."""
    bits = [b for b in range(64) if free >> b & 1]
    ends = [len(bits) * i // blocks for i in range(blocks + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(ends, ends[1:], strict=False)]


def split(crowd: DataFrame, threshold: int) -> DataFrame:
    """Rows of crowded keys once for each block of their free bits; two within the threshold agree in one at least.

    A new key is a hash of the old one, the block and its bits: should two be equal by chance, more is compared.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp, home, free = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for mask in np.unique(free):
                own = free == mask
                for block in blocks_of(int(mask) & (1 << 64) - 1, threshold + 1):
                    bits = np.uint64(block).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"key": key[own], "fp": fp[own], "home": home[own], "free": np.full(own.sum(), mask & ~bits), "block": np.full(own.sum(), bits)})

    dealt = crowd.select("key", "fp", "home", "free").mapInArrow(deal, "key long, fp long, home boolean, free long, block long")
    return dealt.select(F.xxhash64("key", "block", F.col("fp").bitwiseAND(F.col("block"))).alias("key"), "fp", "home", "free")


class Forest:
    """Union-find over fingerprints; ``edges`` lists each member with its root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.up.get(root, root)) != root:
            root = up
        while self.up.get(x, x) != root:
            self.up[x], x = root, self.up[x]
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def edges(self) -> tuple[list[int], list[int]]:
        members = [x for x in self.up if self.find(x) != x]
        return members, [self.find(x) for x in members]


def _compare(keys: np.ndarray, fps: np.ndarray, home: np.ndarray, threshold: int, forest: Forest) -> None:
    """Links rows of equal key within the threshold, in blocks; at least one of two must be at home."""
    if not len(keys):
        return
    order = np.lexsort((~home, keys))
    keys, fps, home = keys[order], fps[order], home[order]
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(cut, len(keys)))
    homes = np.add.reduceat(home.astype(np.int64), cut)
    for start, size, at_home in zip(cut[keep := (sizes > 1) & (homes > 0)].tolist(), sizes[keep].tolist(), homes[keep].tolist(), strict=True):
        own = fps[start : start + size].view(np.uint64)
        label = np.arange(size)
        for i in range(at_home):
            near = label[np.bitwise_count(own ^ own[i]) <= threshold]
            if (near != label[i]).any():
                joined = np.unique(near)
                label[np.isin(label, joined)] = joined[0]
        for i in np.flatnonzero(label != np.arange(size)).tolist():
            forest.link(int(fps[start + i]), int(fps[start + label[i]]))


def _links(rows: DataFrame, threshold: int, crowd: int | None) -> DataFrame:
    """Compares rows that share ``key``, partition by partition.

    Gives a spanning forest of the links found (``fp``, ``b``), and as they are, with null ``b``, the rows of keys
    with more than ``crowd`` rows.
    """
    dealt = rows.select("key", "fp", "home", "free").repartition("key").sortWithinPartitions("key")

    def edges(forest: Forest) -> pa.RecordBatch:
        members, roots = forest.edges()
        none = pa.nulls(len(members), pa.int64())
        return pa.RecordBatch.from_pydict({"key": none, "fp": pa.array(members, pa.int64()), "home": pa.nulls(len(members), pa.bool_()), "free": none, "b": pa.array(roots, pa.int64())})

    def over(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(("key", "fp", "home", "free"), columns, strict=True)) | {"b": pa.nulls(len(columns[0]), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, crowded = Forest(), None
        held: list[list[np.ndarray]] = []
        size = 0

        def part(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            keys = columns[0]
            numbers = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))[: len(keys)]
            if crowd is not None and len(keys):
                many = np.bincount(numbers)[numbers] > crowd
                if crowded is not None:
                    many |= keys == crowded
                if many.any():
                    yield over([x[many] for x in columns])
                    columns, numbers = [x[~many] for x in columns], numbers[~many]
            _compare(numbers, columns[1], columns[2], threshold, forest)

        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            size += batch.num_rows
            if size < 32768:
                continue
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))  # all but the rows of the last key are complete
            yield from part([x[:cut] for x in columns])
            held, size = [[x[cut:] for x in columns]], len(columns[0]) - cut
            if crowd is not None and size > crowd:
                crowded = int(columns[0][-1])
                yield over(held[0])
                held, size = [], 0
            if len(forest.up) > 1 << 20:
                yield edges(forest)
                forest = Forest()
        if held:
            yield from part([np.concatenate(x) for x in zip(*held, strict=True)])
        yield edges(forest)

    return dealt.mapInArrow(run, "key long, fp long, home boolean, free long, b long")


def near_links(distinct: DataFrame, threshold: int = 2, crowd: int = CROWD) -> DataFrame:
    """Edges ``a``, ``b`` whose components are those of all links between distinct fingerprints.

    Where two of 32 bits are free, a key's fingerprints differ in these and in two bits of the other half or three:
    a few thousand at most, which are compared however small the crowd.
    """
    if not 0 <= threshold <= 2:
        raise ValueError("halves and their blocks are covered for thresholds 0 to 2")
    small_batches(distinct.sparkSession)
    found = materialize(_links(replicas(distinct, threshold), threshold, crowd), "links")
    links = found.where("b IS NOT NULL").select(F.col("fp").alias("a"), "b")
    while not (crowded := found.where("b IS NULL")).isEmpty():
        settled = crowded.agg(F.max(F.bit_count("free"))).first()[0] <= 4
        found = materialize(_links(split(crowded, threshold), threshold, None if settled else crowd), "links")
        links = links.unionByName(found.where("b IS NOT NULL").select(F.col("fp").alias("a"), "b"))
    return links


def with_least(rows: DataFrame, least: DataFrame, hub: int, of: str) -> DataFrame:
    """rows with ``m`` of their vertex in column ``of``; least is a table of ``v``, ``m`` and the number of rows of each vertex.

    Vertices with over ``hub`` rows, or over a 50,000th part of all rows, number 50,000 at most and are broadcast.
    """
    most, total = least.agg(F.max("n"), F.sum("n")).first()
    limit = max(hub, (total or 0) // 50_000)
    plain = least.select(F.col("v").alias(of), "m")
    if (most or 0) <= limit:
        return rows.join(plain, of)
    hubs = F.broadcast(least.where(F.col("n") > limit).select(F.col("v").alias(of), "m"))
    return rows.join(hubs, of).unionByName(rows.join(hubs, of, "left_anti").join(plain, of).select(*rows.columns, "m"), allowMissingColumns=False)


def components(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """``a`` and ``b``: every linked vertex but the smallest of its component, with that smallest one.

    Alternating star contraction: large stars hang greater neighbours on a vertex's smallest neighbour, small
    stars the others; a round that changes nothing has only stars left.
    """
    current = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before, done = None, 0
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"), F.count("*").alias("n")).select("v", F.least("v", "m").alias("m"), "n"), f"least-{done}")
        large = with_least(both, least, hub, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, f"large-{done}")
        down = materialize(large.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"), F.count("*").alias("n")), f"down-{done}")
        small = with_least(large, down, hub, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select(F.col("v").alias("a"), F.col("m").alias("b"))).distinct()
        current = materialize(small, f"round-{done}")
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            return current
        before, done = now, done + 1


def near_duplicates(docs: DataFrame, threshold: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest doc_id reachable by links."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    return label(rows, threshold)


def classes(rows: DataFrame, threshold: int = 2) -> DataFrame:
    """``fp``, ``root`` (the class) and ``component_id`` of the distinct fingerprints of rows ``doc_id, fp``, kept in a table."""
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    stars = components(near_links(distinct, threshold))
    member = distinct.join(stars.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialize(member.join(smallest, "root").select("fp", "root", "component_id"), "classes")


def label(rows: DataFrame, threshold: int = 2) -> DataFrame:
    """Each of rows ``doc_id, fp``, kept in a table, with its fingerprint in digits and its class."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(classes(rows, threshold), "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
