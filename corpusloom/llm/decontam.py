"""Benchmark decontamination with one Aho-Corasick automaton over normalised windows.

Words are runs of ASCII letters and digits and of any non-ASCII characters, in lower case (A-Z alone).  The
benchmark's words are numbered, and every window of ``window`` consecutive words of an item, or a whole shorter
item, is a pattern of numbers; documents become numbers too, are scanned once, and hits are mapped back to words
and to code points of the original text.

A null or wordless text has no words and is clean; a null item text is passed over.  An item without identifier
counts for hits and contamination, but can't be listed among items.  Repeated items count once; with an empty
benchmark every document is clean.  Rows are scanned on their own, so repeated identifiers simply give repeated
rows; other columns are dropped, or come along in ``row``.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, ddl, materialize, quoted, small_batches

#: One pass over UTF-8 bytes: word bytes stay, A-Z become lower case, all others become a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The same words in the original text.
ORIGINAL_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: Words whose windows one automaton may hold, some 200 MB of it in a worker; a larger benchmark is scanned for in blocks.
BLOCK_WORDS = 150_000
#: Words of one segment of an item; segments overlap by a window less a word, so they have the item's windows.
SEGMENT_WORDS = 20_000

SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
#: What is returned of a document: names, Spark's types and Arrow's.
RESULT = [
    ("n_words", "long", pa.int64()),
    ("n_hit", "long", pa.int64()),
    ("n_items", "long", pa.int64()),
    ("items_sha256", "string", pa.string()),
    ("contaminated", "boolean", pa.bool_()),
    ("items", "array<string>", pa.list_(pa.string())),
    ("spans", "array<struct<start:long,end:long>>", pa.list_(SPAN)),
]
#: What one block's scan leaves to the next.
STATE = [("seen", "array<boolean>", pa.list_(pa.bool_())), ("named", "array<string>", pa.list_(pa.string()))]

Segment = tuple[str | None, list[bytes]]
_machines: dict[str, Machine] = {}


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def segments_of(words: list[bytes], window: int, most: int = SEGMENT_WORDS) -> Iterator[list[bytes]]:
    """An item's words in stretches that together have its windows and no others."""
    for at in range(0, max(1, len(words) - window + 1), most):
        yield words[at : at + most + window - 1]


class Machine:
    """An automaton over numbered words.

    A word of the benchmark is three characters, the digits of its number, each from an alphabet of its own, and any
    other word is a fourth kind of character: so matches start and end with words, and no state of the automaton,
    which looks through its transitions one by one, has many.
    """

    def __init__(self, segments: list[Segment], window: int):
        numbers: dict[bytes, int] = {}
        for _, words in segments:
            for w in words:
                numbers.setdefault(w, len(numbers))
        base = 1 + round(len(numbers) ** (1 / 3))
        base += base**3 < len(numbers)
        self.code = {w: chr(1 + n // base**2) + chr(1 + base + n // base % base) + chr(1 + 2 * base + n % base) for w, n in numbers.items()}
        places: dict[str, int] = {}
        named: list[set[str]] = []
        for item, words in segments:
            line = "".join([self.code[w] for w in words])
            size = min(window, len(words))
            for k in range(len(words) - size + 1 if words else 0):
                at = places.setdefault(line[3 * k : 3 * (k + size)], len(places))
                if at == len(named):
                    named.append(set())
                if item is not None:
                    named[at].add(item)
        self.sizes = np.array([len(p) // 3 for p in places], np.int64)
        kinds: dict[frozenset, tuple[str, ...]] = {}
        self.items = [kinds.setdefault(key, tuple(key)) for key in map(frozenset, named)]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for pattern, at in places.items():
            self.machine.add_word(pattern, at)
        if places:
            self.machine.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are inside an occurrence of a pattern, and the items that those patterns belong to."""
        hit, items = np.zeros(len(words), bool), set()
        if len(self.sizes) and words:
            codes = list(map(self.code.get, words, itertools.repeat("\0")))
            found = list(self.machine.iter("".join(codes)))
            if found:
                last, at = np.array(found, np.int64).T
                ends = np.searchsorted(np.cumsum(list(map(len, codes))), last, side="right") + 1
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, ends - self.sizes[at], 1)
                np.add.at(edge, ends, -1)
                hit = np.cumsum(edge)[:-1] > 0
                for i in np.unique(at).tolist():
                    items.update(self.items[i])
        return hit, items


def machine_of(name: str, sent, window: int) -> Machine:
    """This worker's automaton of a block, made once; an earlier block's is let go."""
    if name not in _machines:
        _machines.clear()
        _machines[name] = Machine(sent.value, window)
    return _machines[name]


def spans_of(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as code points of the original text."""
    spans: list[dict] = []
    last = -2
    for i, m in enumerate(ORIGINAL_WORD.finditer(text)):
        if hit[i]:
            if last == i - 1:
                spans[-1]["end"] = m.end()
            else:
                spans.append({"start": m.start(), "end": m.end()})
            last = i
    return spans


def segmented(benchmark: DataFrame, item_col: str, item_text: str, window: int) -> DataFrame:
    """``item``, ``words`` (joined by spaces, in lower case) and ``n``, how many there are, of the items' segments."""
    small_batches(benchmark.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(body)
                if words:
                    parts = list(segments_of(words, window))
                    yield pa.RecordBatch.from_pydict({"item": pa.array([item] * len(parts), pa.string()), "words": pa.array([b" ".join(p) for p in parts], pa.binary()), "n": pa.array([len(p) for p in parts], pa.int64())})

    return benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("body")).mapInArrow(run, "item string, words binary, n long")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_words: int = BLOCK_WORDS,
    carry: bool = False,
) -> DataFrame:
    """A row per document: its hits among the benchmark's windows.

    The benchmark is the stated query set.  Its words are counted first; if one automaton may hold their windows, it
    does, and else their segments are dealt by hash to blocks, of which the driver and a worker hold one at a
    time, and documents pass through block after block, written to the shared folder in between.
    """
    parts = segmented(benchmark, item_col, item_text, window)
    words = parts.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-words // block_words))
    if blocks > 1:
        parts = materialize(parts, "segments")
    row = [F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row")] if carry else []
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind, _ in STATE]
    state = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *nothing, *row)
    for block in range(blocks):
        own = parts.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block)
        sent = docs.sparkSession.sparkContext.broadcast([(r["item"], bytes(r["words"]).split(b" ")) for r in own.collect()])
        last = block == blocks - 1
        state = _scan(state, sent, window, last)
        if not last:
            state = materialize(state, f"block-{block}")
    return state


def _result(text: str | None, hit: np.ndarray, items: list[str]) -> tuple:
    digest = hashlib.sha256(",".join(items).encode()).hexdigest()
    n_hit = int(hit.sum())
    return len(hit), n_hit, len(items), digest, n_hit > 0, items, spans_of(text, hit) if n_hit else []


def _state(text: str | None, hit: np.ndarray, items: list[str]) -> tuple:
    return (hit.tolist(), items) if hit.any() else (None, None)


def _scan(state: DataFrame, sent, window: int, last: bool) -> DataFrame:
    """One block's scan, added to what earlier blocks found; the last one makes the result."""
    fields, of = (RESULT, _result) if last else (STATE, _state)
    kept = [c for c in state.columns if c in ("doc_id", "row") or (c == "text" and not last)]
    name = uuid.uuid4().hex

    def make():
        machine = machine_of(name, sent, window)

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            rows = []
            for text, seen, named in zip(*(batch.column(c).to_pylist() for c in ("text", "seen", "named")), strict=True):
                hit, items = machine.hits(words_of(text))
                if seen is not None:
                    hit |= np.array(seen, bool)
                rows.append(of(text, hit, sorted(items.union(named or ()))))
            made = {name: pa.array(list(values), kind) for (name, _, kind), values in zip(fields, zip(*rows, strict=True), strict=True)}
            return {c: batch.column(c) for c in kept} | made

        return work

    schema = ", ".join([f"{c} {ddl(state.schema[c].dataType)}" for c in kept] + [f"{name} {kind}" for name, kind, _ in fields])
    return arrow_pass(state, {c: F.col(c) for c in state.columns}, make, schema)
