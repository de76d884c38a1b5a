"""Language-model scoring with a gated recurrent network and class-factored output.

Words are counted over all training documents, and documents become numbers once, in a table.  The ``vocabulary`` most frequent ones, seen ``LEAST`` times or
more, are held by every worker; each belongs to an output class made of the kind of document it is most typical of and its frequency.
All other words belong to a few tail classes, by their letters and endings.  A token's probability is that of
its class, by the network's softmax over classes given everything before it, times that of the word within its
class: a softmax over the words of the class whose logits are the logarithms of their counts, to which the network
adds, for the ``LEARNED`` most frequent words, what it has learned of them given the same state.  Each tail class
keeps the share of its words seen once for unknown words (Good and Turing's estimate), all unknown words of a class
being one outcome, and probabilities add up to one.

The network is a GRU in numpy, trained by truncated backpropagation.  It starts from the counts of all in its
class biases and from some steps on the driver over the ``sample_docs`` training documents of the smallest
identifier hashes that have ``SAMPLE_TOKENS`` tokens at most, which also settle the centres of the kinds of documents;
what kind a word is typical of is counted over all training documents, each of the kind of its nearest centre.
Then it goes on over all training documents, each once, in some rounds: a round's documents are dealt to shards by
the hash of their numbers, a task goes on from the round's network over the documents of its shard in the order of
these hashes, and what the shards reach is averaged by tokens, in a tree.  So the result doesn't follow the files or
partitions that documents come in; of texts that repeat very often, whose copies are dealt by their place, it may
differ by as little as a few copies' weight.  The number of shards grows with the tokens, up to ``MOST_SHARDS`` a
round; from there on shards grow.  Documents are scored whole: a worker runs many side by side in windows, carries
each one's state from window to window, and fills places that become free.

Tail words are looked up by a join with the count table, which may be of any size; frequent words never reach
it.  Null texts are the end token alone; rows without identifier train; repeated rows and identifiers are
scored apart; without training documents every score follows from the formula with zero counts; other columns are
dropped.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import heapq
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import crc_mod, materialize, one_thread, small_batches

VOCABULARY = 1 << 17
LEAST = 3
KINDS, BINS, TAIL = 8, 8, 16
CLASSES = KINDS * BINS + TAIL
#: Words with an input vector of their own, others enter as their class; and with an output vector of their own.
INPUTS = LEARNED = 2048
HIDDEN = 32
ALPHA = 0.1
#: Words that a counting task holds, distinct ones of each batch, before it adds them up and passes them on.
HELD_WORDS = 1_600_000
#: Streams and steps of a window while training, and the tokens that a task takes up at a time.
STREAMS, STEPS, CHUNK = 512, 24, 512 * 24 * 8
#: Rounds of the training, tokens of a shard, shards of a round, and the shards that make another round worth it.
ROUNDS, SHARD_TOKENS, MOST_SHARDS, LEAST_SHARDS = 4, 1 << 20, 4096, 4
RATE = 0.004
#: Tokens of a document that the driver's sample may have.
SAMPLE_TOKENS = 1 << 13
#: Rows with the same text beyond which they are dealt by their place; with more rows in all, a 10,000th part of them.
COPIES = 256
#: Documents side by side, and steps of a window, while scoring.
PLACES, WINDOW = 256, 32
#: Rows of a softmax at a time, and tokens of documents that are read ahead.
BLOCK, AHEAD = 1024, 1 << 19
#: Rows of a key beyond which they are summed by a product of their own.
MANY_ROWS = 16


@functools.cache
def keep_memory() -> None:
    """Has a worker keep the arrays' memory that it frees, since asking the system for it again costs a fifth of the time; elsewhere than with glibc all stays as it is."""
    with contextlib.suppress(OSError, AttributeError):
        mallopt = ctypes.CDLL("libc.so.6").mallopt
        for option, size in ((-3, 32 << 20), (-1, 256 << 20)):  # the sizes from which on blocks are mapped, and free memory is given back
            mallopt(option, size)


def _endings() -> bytes:
    """What a word's last byte says of it, as 0 to 6: a letter or above ASCII, a full stop, a comma, a loud end, a digit, a sign, all else."""
    kinds = [(b".", 1), (b",", 2), (b"!?", 3), (b"0123456789", 4), (b"#$%&*|", 5)]
    return bytes(0 if b >= 128 or chr(b).isalpha() else next((k for ends, k in kinds if b in ends), 6) for b in range(256))


ENDING = _endings()


def tail_class(word: bytes) -> int:
    """0 to 15: by whether a word is ASCII, and by its last character."""
    return 15 if not word else ENDING[word[-1]] + (0 if word.isascii() else 8)


def tail_classes(words: pa.Array) -> np.ndarray:
    """The tail class of each of many words (string or binary, none null)."""
    if not len(words):
        return np.zeros(0, np.int32)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32, len(words) + 1, 4 * words.offset)
    held = np.diff(ends) > 0
    out = np.full(len(words), 15, np.int32)
    out[held] = np.frombuffer(ENDING, np.uint8)[np.frombuffer(data or b"\0", np.uint8)[ends[1:][held] - 1]]
    out[held & ~pc.string_is_ascii(words.cast(pa.string())).to_numpy(zero_copy_only=False)] += 8
    return out


@dataclass
class Tables:
    """What every worker knows of the frequent words and of the classes."""

    class_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    in_class: np.ndarray = field(default_factory=lambda: np.zeros(0))  # natural log of a word's share of its class
    tail_known: np.ndarray = field(default_factory=lambda: np.zeros(TAIL))  # log10 of what one count of a tail word is worth
    tail_unknown: np.ndarray = field(default_factory=lambda: np.zeros(TAIL))  # log10 of the unknown words' share
    mass: np.ndarray = field(default_factory=lambda: np.full(CLASSES, ALPHA))
    # The learned words by class: where each is, where classes begin, shares of the class, and what is left of it.
    slot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    begin: np.ndarray = field(default_factory=lambda: np.zeros(KINDS * BINS + 1, np.int64))
    share: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    rest: np.ndarray = field(default_factory=lambda: np.ones(KINDS * BINS, np.float32))

    def classes(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.class_of):
            return KINDS * BINS - 1 - ids
        return np.where(ids >= 0, self.class_of[np.maximum(ids, 0)], KINDS * BINS - 1 - ids)

    def fed(self, docs: list[np.ndarray]) -> np.ndarray:
        """Documents end to end as three rows: what the network reads before each token (the token before it, or the start), classes, words."""
        ids = np.concatenate(docs).astype(np.int64)
        classes = self.classes(ids)
        own = np.where((ids >= 0) & (ids < INPUTS), ids, INPUTS + classes)
        x = np.concatenate([[0], own[:-1]])
        x[np.cumsum([0, *(len(d) for d in docs[:-1])])] = INPUTS + CLASSES
        return np.stack([x, classes, ids])


def split(texts: pa.Array) -> pa.Array:
    """The words of each text in lower case, and empty ones beside blanks at its ends."""
    return pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))


@dataclass
class Numbered:
    """Documents as word numbers, or -1 - tail class, end to end; where each begins and the last one ends; and the tail words of each, with their counts."""

    ids: np.ndarray
    begin: np.ndarray
    words: pa.Array
    numbers: np.ndarray  # of words
    tail_begin: np.ndarray
    tail: np.ndarray  # places in words
    tail_counts: np.ndarray

    def __iter__(self) -> Iterator[np.ndarray]:
        return map(self.ids.__getitem__, itertools.starmap(slice, itertools.pairwise(self.begin.tolist())))


def all_numbered(lists: pa.Array, number: dict[bytes, int] | pa.Array) -> Numbered:
    """Documents, given as lists of words, with their ends; each distinct word is looked up once among the numbers, or among an array of words in their order."""
    found = lists.flatten().dictionary_encode()
    if isinstance(number, dict):
        number = pa.array(sorted(number, key=number.__getitem__), pa.binary())
    named = pa.concat_arrays([found.dictionary.cast(pa.binary()), pa.array([b""])])
    words = len(named)
    empty = pc.index(named, pa.scalar(b"", pa.binary())).as_py()
    codes = found.indices.to_numpy()
    held = codes != empty
    begin = np.concatenate([[0], np.cumsum(held)])[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])]
    # Each word's new place: the ends of the documents before it come in between.
    sizes = np.diff(begin)
    begin = begin + np.arange(len(begin))
    own = np.ones(begin[-1], bool)
    own[begin[1:] - 1] = False
    kept, codes = codes[held], np.full(len(own), words - 1, codes.dtype)
    codes[own] = kept
    numbers = pc.fill_null(pc.index_in(named, value_set=number), -1).to_numpy().astype(np.int32)
    rare = np.flatnonzero(numbers < 0)
    numbers[rare] = -1 - tail_classes(named.take(pa.array(rare)))
    ids = numbers[codes]
    rest = np.flatnonzero(ids < 0)
    doc = np.repeat(np.arange(len(sizes)), sizes + 1)[rest]
    pairs, counts = np.unique(doc * words + codes[rest], return_counts=True)
    return Numbered(ids, begin, named, numbers, np.searchsorted(pairs, np.arange(len(begin)) * words), pairs % words, counts)


def numbered(words: list[bytes], number: dict[bytes, int]) -> tuple[np.ndarray, Counter]:
    """The numbers of one document and its end, and its tail words with their counts."""
    found = all_numbered(pa.array([words], pa.list_(pa.binary())), number)
    return found.ids, Counter(dict(zip(found.words.take(pa.array(found.tail)).to_pylist(), found.tail_counts.tolist(), strict=True)))


def summed(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys (small numbers) that occur, in order, and the sum of the rows of each: many rows of a key by one product, few by adding the next row of every key that has one."""
    order = np.argsort(keys.astype(np.int16), kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    begin = np.flatnonzero(new)
    count = np.diff(begin, append=len(keys))
    by = np.argsort(-count, kind="stable")
    begin_by, count_by = begin[by], count[by]
    many = int((count > MANY_ROWS).sum())
    out = np.empty((len(begin), rows.shape[1]), rows.dtype)
    ones = np.ones(int(count.max(initial=0)), rows.dtype)
    for i, (at, n) in enumerate(zip(begin_by[:many].tolist(), count_by[:many].tolist(), strict=True)):
        np.dot(ones[:n], np.take(rows, order[at : at + n], axis=0), out=out[i])
    few, at, left = out[many:], begin_by[many:], count_by[many:]
    few[:] = np.take(rows, order[at], axis=0)
    for k in range(1, int(left.max(initial=0))):
        n = int((left > k).sum())
        few[:n] += np.take(rows, order[at[:n] + k], axis=0)
    back = np.empty_like(by)
    back[by] = np.arange(len(by))
    return keys[begin], np.take(out, back, axis=0)


class Network:
    """A GRU over input vectors, with a softmax over classes and one over the words of each class."""

    def __init__(self, mass: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "inputs": rng.normal(0, 0.1, (INPUTS + CLASSES + 1, 3 * HIDDEN)).astype(np.float32),
            "hidden": rng.normal(0, 0.5 / math.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN)).astype(np.float32),
            "out": np.zeros((HIDDEN, CLASSES), np.float32),
            "bias": np.log(np.maximum(mass, 1e-9) / mass.sum()).astype(np.float32),
            "words": np.zeros((LEARNED, HIDDEN), np.float32),
        }
        one_thread()
        keep_memory()
        self.moments: tuple[dict, dict, int] | None = None
        self.spaces: dict[tuple, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"spaces": {}, "moments": None}

    def space(self, name: str, *shape: int) -> np.ndarray:
        """An array that is used again, with whatever it holds."""
        key = (name, shape, self.p["hidden"].dtype)
        if key not in self.spaces:
            if len(self.spaces) > 64:
                self.spaces.clear()
            self.spaces[key] = np.empty(shape, key[2])
        return self.spaces[key]

    def by_gates(self) -> tuple[np.ndarray, np.ndarray]:
        """The parameters of the gates, of z and r the negatives, as their logistic functions want them."""
        u, vectors = (self.p[k].reshape(-1, 3, HIDDEN).transpose(1, 0, 2).copy() for k in ("hidden", "inputs"))
        u[:2] *= -1
        vectors[:2] *= -1
        return u, vectors

    def states(self, x: np.ndarray, h: np.ndarray, keep: dict | None = None, gates: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """The states after each of the inputs x (steps x rows), from h; ``keep`` gets what backpropagation needs.

        Each gate has arrays of its own, of rows by features, so that all of them are contiguous and none is turned.
        """
        u, vectors = gates or self.by_gates()
        steps, rows = x.shape
        x = np.ascontiguousarray(x, np.intp)
        out = self.space("states", steps, rows, HIDDEN)
        held = steps if keep is not None else 1
        gates, new, inner, before = (self.space(name, held, *n, rows, HIDDEN) for name, n in (("gates", (2,)), ("new", ()), ("inner", ()), ("before", ())))
        gx = self.space("gx", 3, rows, HIDDEN)
        fresh = x == INPUTS + CLASSES
        any_fresh = fresh.any(axis=1)
        for t in range(steps):
            i = t if keep is not None else 0
            zr, n, ghn, old = gates[i], new[i], inner[i], before[i]
            old[:] = h
            if any_fresh[t]:
                old[fresh[t]] = 0
            np.take(vectors, x[t], axis=1, out=gx, mode="clip")
            np.matmul(old, u[:2], out=zr)
            zr += gx[:2]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.matmul(old, u[2], out=ghn)
            np.multiply(zr[1], ghn, out=n)
            n += gx[2]
            np.tanh(n, out=n)
            h = out[t]
            np.subtract(old, n, out=h)
            h *= zr[0]
            h += n
        if keep is not None:
            keep.update(gates=gates, new=new, inner=inner, before=before, fresh=fresh)
        return out

    def of_classes(self, states: np.ndarray, y: np.ndarray, g: dict | None = None, back: np.ndarray | None = None, share: float = 1.0) -> np.ndarray:
        """Log probabilities of the classes y (0 where y is negative) after states (rows x hidden).

        Adds gradients of their negative sum, times ``share``, to ``g``, and puts those of the states into ``back``.  Rows are taken some at a time.
        """
        out, bias = self.p["out"], self.p["bias"]
        # No logit is above this, and if none can be far below it, no row needs its own largest one.
        top = float((bias + np.abs(out).sum(axis=0)).max())
        near = top - float((bias - np.abs(out).sum(axis=0)).min()) < 80
        logs = np.empty(len(states), np.float64)
        for a in range(0, len(states), BLOCK):
            own, target = states[a : a + BLOCK], y[a : a + BLOCK]
            e = np.matmul(own, out, out=self.space("classes", len(own), CLASSES))
            e += bias - top if near else bias
            if not near:
                e -= e.max(axis=1, keepdims=True)
            at = np.arange(len(own)), np.maximum(target, 0)
            picked = e[at]
            np.exp(e, out=e)
            total = e @ np.ones(CLASSES, e.dtype)
            logs[a : a + BLOCK] = np.where(target >= 0, picked - np.log(total), 0)
            if g is not None:
                # A row's weight goes to its narrow side.
                e[at] -= total
                weight = (np.where(target >= 0, share, 0) / total).astype(e.dtype)
                g["out"] += (own * weight[:, None]).T @ e
                g["bias"] += weight @ e
                some = np.matmul(e, out.T, out=back[a : a + BLOCK])
                some *= weight[:, None]
        return logs

    def of_words(self, states: np.ndarray, y: np.ndarray, words: np.ndarray, tables: Tables, g: dict | None = None, back: np.ndarray | None = None, share: float = 1.0) -> np.ndarray:
        """Log probabilities of words within their classes y, by number (0 where it is negative); adds gradients as above, to ``back`` as well."""
        vectors = self.p["words"]
        logs = np.zeros(len(states), np.float64)
        frequent = np.flatnonzero(words >= 0)
        order = frequent[np.argsort(y[frequent].astype(np.int8), kind="stable")]
        edges = np.searchsorted(y[order], np.arange(KINDS * BINS + 1)).tolist()
        named, ranked = words[order], np.take(states, order, axis=0)
        logits = tables.in_class[named]
        # The rows of learned words, and each one's column among the learned words of its class.
        slot = tables.slot[named]
        learned = np.flatnonzero(slot >= 0)
        column = slot[learned] - tables.begin[y[order[learned]]]
        begin = tables.begin.tolist()
        totals = np.ones(len(order), states.dtype)
        if g is not None:
            turned = np.zeros_like(ranked)
        for k in range(KINDS * BINS):
            first, last = begin[k], begin[k + 1]
            if first == last:
                continue
            part, own = tables.share[first:last], vectors[first:last]
            for a in range(edges[k], edges[k + 1], BLOCK):
                rows = slice(a, min(a + BLOCK, edges[k + 1]))
                some = slice(*np.searchsorted(learned, (a, rows.stop)).tolist())
                at = learned[some] - a, column[some]
                e = ranked[rows] @ own.T
                logits[learned[some]] += e[at]
                np.exp(e, out=e)
                total = e @ part
                total += tables.rest[k]
                totals[rows] = total
                if g is not None:
                    e *= part
                    e *= (share / total).astype(e.dtype)[:, None]
                    e[at] -= share
                    g["words"][first:last] += e.T @ ranked[rows]
                    np.matmul(e, own, out=turned[rows])
        logs[order] = logits - np.log(totals)
        if g is not None:
            back[order] += turned
        return logs

    def gradients(self, x: np.ndarray, y: np.ndarray, words: np.ndarray, h: np.ndarray, tables: Tables) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Truncated backpropagation over one window (steps x rows); also the last state and the mean loss."""
        kept: dict = {}
        states = self.states(x, h, kept)
        flat, target = states.reshape(-1, HIDDEN), y.ravel()
        count = max(1, int((target >= 0).sum()))
        g = {k: self.space(f"g {k}", *v.shape) for k, v in self.p.items()}
        for v in g.values():
            v.fill(0)
        back = self.space("back", *flat.shape)
        loss = self.of_classes(flat, target, g, back, 1 / count).sum() + self.of_words(flat, target, words.ravel(), tables, g, back, 1 / count).sum()
        steps, rows = x.shape
        coming, u = back.reshape(states.shape), self.p["hidden"].T.copy()
        # What comes to z, r and n's input, and n's part of the state: the input has the first three, the state all but n's input.
        read, inner = self.space("read", steps, rows, 3 * HIDDEN), self.space("read inner", steps, rows, HIDDEN)
        dh = np.zeros((rows, HIDDEN), states.dtype)
        some, dz, dr = (self.space(name, rows, HIDDEN) for name in ("some", "dz", "dr"))
        any_fresh = kept["fresh"].any(axis=1)
        for t in reversed(range(steps)):
            n, (z, r), old = kept["new"][t], kept["gates"][t], kept["before"][t]
            to_z, to_r, to_n = (read[t, :, k : k + HIDDEN] for k in range(0, 3 * HIDDEN, HIDDEN))
            dn = inner[t]
            dh += coming[t]
            np.subtract(1, z, out=some)
            some *= dh  # what comes through 1 - z
            np.subtract(old, n, out=dz)
            dz *= some
            np.multiply(dz, z, out=to_z)
            np.multiply(n, n, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= some
            to_n[:] = dn
            dn *= r
            np.subtract(1, r, out=dr)
            dr *= dn
            np.multiply(dr, kept["inner"][t], out=to_r)
            dh *= z
            dh += np.matmul(read[t, :, : 2 * HIDDEN], u[: 2 * HIDDEN], out=some)
            dh += np.matmul(dn, u[2 * HIDDEN :], out=some)
            if any_fresh[t]:
                dh[kept["fresh"][t]] = 0
        flat, before = read.reshape(-1, 3 * HIDDEN), kept["before"].reshape(-1, HIDDEN).T
        g["hidden"][:, : 2 * HIDDEN] = before @ flat[:, : 2 * HIDDEN]
        g["hidden"][:, 2 * HIDDEN :] = before @ inner.reshape(-1, HIDDEN)
        seen, sums = summed(flat, x.ravel())
        g["inputs"][seen] = sums
        return g, states[-1].copy(), -loss / count

    def train(self, streams: np.ndarray, tables: Tables, steps: int | None = None, rate: float = 0.01, decay: bool = True) -> list[float]:
        """Adam over the windows of parallel streams, in order, once or for so many steps; states are carried along."""
        x, y, words = streams
        zeros = lambda: {k: np.zeros_like(v) for k, v in self.p.items()}
        m, v, done = self.moments or (zeros(), zeros(), 0)
        h = np.zeros((len(x), HIDDEN), np.float32)
        steps = -(-x.shape[1] // STEPS) if steps is None else steps
        at, losses = 0, []
        for step in range(1, steps + 1):
            if at >= x.shape[1]:
                at, h = 0, np.zeros_like(h)
            g, h, loss = self.gradients(*(a[:, at : at + STEPS].T for a in (x, y, words)), h, tables)
            at, done = at + STEPS, done + 1
            norm = math.sqrt(sum(float((k * k).sum()) for k in g.values()))
            now = rate * (min(1.0, 2 * (1 - step / (steps + 1))) if decay else min(1.0, done / 20))
            now *= math.sqrt(1 - 0.99**done) / (1 - 0.9**done)
            for k, d in g.items():
                d *= min(1.0, 1.0 / max(norm, 1e-9))
                m[k] *= 0.9
                m[k] += 0.1 * d
                v[k] *= 0.99
                d *= d
                d *= 0.01
                v[k] += d
                np.sqrt(v[k], out=d)
                d += 1e-8
                np.divide(m[k], d, out=d)
                d *= now
                self.p[k] -= d
            losses.append(loss)
        self.moments = (m, v, done)
        return losses

    def packed(self) -> bytes:
        return b"".join(self.p[k].astype("<f4").tobytes() for k in sorted(self.p))

    def unpacked(self, data: bytes) -> Network:
        """A network of the same shape with other parameters."""
        out, flat, at = Network(np.ones(CLASSES)), np.frombuffer(data, "<f4"), 0
        for k in sorted(self.p):
            out.p[k] = flat[at : at + self.p[k].size].reshape(self.p[k].shape).astype(np.float32)
            at += self.p[k].size
        return out


def count_words(texts: DataFrame) -> DataFrame:
    """``word``, its tail class and its count over ``text``; each document ends with an empty word."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.StructArray] = []

        def out(docs: int) -> pa.RecordBatch:
            ends = pa.StructArray.from_arrays([pa.array([""]), pa.array([docs], pa.int64())], ["values", "counts"])
            parts = pa.Table.from_struct_array(pa.chunked_array([pa.StructArray.from_arrays([x.field("values").cast(pa.string()), x.field("counts")], ["values", "counts"]) for x in [*held, ends]]))
            summed = parts.group_by("values", use_threads=False).aggregate([("counts", "sum")]).combine_chunks()
            words = summed["values"].combine_chunks()
            return pa.RecordBatch.from_pydict({"word": words, "k": pa.array(tail_classes(words)), "n": summed["counts_sum"].combine_chunks()})

        docs = 0
        for batch in batches:
            # Blanks at the ends of texts leave empty words, which are no ends.
            found = split(batch.column(0)).flatten().dictionary_encode()
            counts = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
            found = pa.StructArray.from_arrays([found.dictionary, pa.array(counts, pa.int64())], ["values", "counts"])
            held.append(found.filter(pc.not_equal(found.field("values"), "")))
            docs += batch.num_rows
            if sum(map(len, held)) > HELD_WORDS:
                yield out(docs)
                held, docs = [], 0
        if docs:
            yield out(docs)

    return texts.select("text").mapInArrow(run, "word string, k int, n long").groupBy("word").agg(F.min("k").alias("k"), F.sum("n").alias("c"))


def levels(counts: DataFrame) -> list[Row]:
    """A histogram of counts on a logarithmic scale by tail classes, of bounded size: words, tokens and words that occur once."""
    return counts.groupBy("k", _level().alias("at")).agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.count_if(F.col("c") == 1).alias("once")).collect()


def _level() -> Column:
    return F.floor(F.log2("c") * 64)


def frequent(counts: DataFrame, most: int, found: list[Row]) -> list[tuple[bytes, int, int]]:
    """The most frequent words, in order: those above a count that at most ``most`` words reach.

    The histogram gives that count, so no task sends more to the driver than its part of the result.
    """
    words = Counter()
    for r in found:
        words[r["at"]] += r["n"]
    level, held, least = 0, 0, math.floor(math.log2(LEAST) * 64)
    for at in sorted((at for at in words if at >= least), reverse=True):
        held += words[at]
        if held > most:
            level = at + 1
            break
    rows = counts.where((F.col("c") >= LEAST) & (_level() >= level)).collect()
    return sorted(((r["word"].encode(), r["k"], r["c"]) for r in rows), key=lambda x: (-x[2], x[0]))


def shares(docs: list[np.ndarray], top: int) -> np.ndarray:
    """The roots of each document's shares of the ``top`` most frequent words."""
    ids, sizes = np.concatenate(docs).astype(np.int64), np.array([len(d) for d in docs])
    held = np.flatnonzero((ids >= 0) & (ids < top))
    counts = np.bincount(np.repeat(np.arange(len(docs)), sizes)[held] * top + ids[held], minlength=len(docs) * top)
    return np.sqrt(counts.reshape(len(docs), top) / np.maximum(1, sizes)[:, None])


def doc_centres(docs: list[np.ndarray], words: int, rounds: int = 12) -> np.ndarray:
    """Centres of documents by their shares of the most frequent words (k-means from far-apart seeds)."""
    top = min(256, words)
    rows = shares(docs, top)
    centres = rows[[0]]
    while len(centres) < min(KINDS, len(rows)):
        apart = ((rows[:, None] - centres) ** 2).sum(axis=2).min(axis=1)
        centres = np.vstack([centres, rows[apart.argmax()]])
    for _ in range(rounds):
        kind = ((rows[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([rows[kind == k].mean(axis=0) if (kind == k).any() else centres[k] for k in range(len(centres))])
    return centres


class KindCounts:
    """How often each frequent word occurs in documents of each kind, the nearest centre's."""

    def __init__(self, centres: np.ndarray, words: int):
        self.centres = centres
        self.counts = np.zeros(words * KINDS, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, docs: list[np.ndarray]) -> None:
        rows = shares(docs, self.centres.shape[1])
        kinds = np.column_stack([((rows - c) ** 2).sum(axis=1) for c in self.centres]).argmin(axis=1)
        ids, kinds = np.concatenate(docs), np.repeat(kinds, [len(d) for d in docs])
        known = ids >= 0
        self.held.append(ids[known].astype(np.int64) * KINDS + kinds[known])
        self.size += len(self.held[-1])
        if self.size > len(self.counts):
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.counts += np.bincount(np.concatenate(self.held), minlength=len(self.counts))
        self.held, self.size = [], 0

    def table(self) -> np.ndarray:
        self.flush()
        return self.counts.reshape(-1, KINDS)


def typical(counts: np.ndarray) -> np.ndarray:
    """For each word the kind of document that it is most typical of."""
    return ((counts + 0.01) / (counts.sum(axis=0) + 1)).argmax(axis=1)


def doc_kinds(docs: list[np.ndarray], words: int) -> np.ndarray:
    """For each frequent word its kind, by these documents alone."""
    if not docs or not words:
        return np.zeros(words, np.int64)
    found = KindCounts(doc_centres(docs, words), words)
    found.add(docs)
    return typical(found.table())


def corpus_kinds(rows: DataFrame, docs: list[np.ndarray], words: int) -> np.ndarray:
    """For each frequent word its kind, by all training documents; ``docs`` give the centres alone.

    A task sends a row of ``KINDS`` counts a frequent word, and the driver gets as many rows as there are words.
    """
    if not docs or not words:
        return np.zeros(words, np.int64)
    centres = doc_centres(docs, words)
    names = [f"n{k}" for k in range(KINDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = KindCounts(centres, words)
        for batch in batches:
            if batch.num_rows:
                found.add([np.frombuffer(ids, "<i4") for ids in batch.column(0).to_pylist()])
        table = found.table()
        seen = np.flatnonzero(table.any(axis=1))
        for at in range(0, len(seen), 1 << 14):
            part = seen[at : at + (1 << 14)]
            yield pa.RecordBatch.from_pydict({"word": pa.array(part, pa.int64())} | {n: pa.array(table[part, k], pa.int64()) for k, n in enumerate(names)})

    schema = ", ".join(f"{n} long" for n in ["word", *names])
    summed = rows.where("not held_out").select("ids").mapInArrow(run, schema).groupBy("word").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    counts = np.zeros((words, KINDS), np.int64)
    counts[summed["word"].to_numpy()] = np.column_stack([summed[n].to_numpy() for n in names])
    return typical(counts)


def tables_of(top: list[tuple[bytes, int, int]], tail_counts: np.ndarray, total: float, distinct: int, kinds: np.ndarray) -> Tables:
    """Classes of the frequent words (word, tail class, count) in order, by their kinds, and what all counts say of them."""
    out = Tables()
    c = np.array([n for _, _, n in top], np.float64)
    # A kind has bins by its mass, one at least, and they hold about equal mass, the most frequent words first.
    out.class_of, first = np.zeros(len(top), np.int64), 0
    held = np.bincount(kinds, c, KINDS) if len(top) else np.zeros(KINDS)
    free = KINDS * BINS - KINDS
    for k in range(KINDS):
        bins = 1 + int(free * held[k] / max(held[k:].sum(), 1))
        free -= bins - 1
        own = np.flatnonzero(kinds == k)
        if len(own):
            out.class_of[own] = first + np.minimum((np.cumsum(c[own]) - c[own]) * bins // c[own].sum(), bins - 1)
        first += bins
    mass = np.bincount(out.class_of, c, CLASSES) if len(top) else np.zeros(CLASSES)
    out.in_class = np.log(c / mass[out.class_of]) if len(top) else np.zeros(0)
    own = out.class_of[:LEARNED]
    order = np.argsort(own, kind="stable")
    out.slot = np.full(len(top), -1, np.int64)
    out.slot[order] = np.arange(len(order))
    out.begin = np.searchsorted(own[order], np.arange(KINDS * BINS + 1))
    shares_of = np.exp(out.in_class[order])
    out.share = shares_of.astype(np.float32)
    out.rest = np.maximum(1 - np.bincount(own[order], shares_of, KINDS * BINS), 0).astype(np.float32)
    tokens, once = tail_counts[:, 0], tail_counts[:, 1]
    unknown = np.where(tokens > 0, np.clip(once / np.maximum(tokens, 1), 1 / (tokens + 2), 1 - 1 / (tokens + 2)), 1)
    out.tail_known = np.log10(np.maximum(1 - unknown, 1e-300) / np.maximum(tokens, 1))
    out.tail_unknown = np.log10(unknown)
    mass[KINDS * BINS :] = tokens + ALPHA
    out.mass = np.maximum(mass, 1e-3)
    return out


def streams_of(docs: list[np.ndarray], tables: Tables, rows: int = STREAMS) -> np.ndarray:
    """Documents end to end, dealt to parallel streams: inputs, target classes and words, negative where a stream has ended."""
    flat = tables.fed(docs)
    n = flat.shape[1]
    rows = max(1, min(rows, n // STEPS))
    length = -(-n // rows)
    out = np.full((3, rows * length), -1, np.int64)
    out[0] = INPUTS + CLASSES
    out[:, :n] = flat
    return out.reshape(3, rows, length)


def shards(rows: DataFrame, tokens: int, documents: int) -> tuple[int, int, DataFrame]:
    """Rounds, shards of a round, and the training documents' ids with their ``round``, ``shard`` and ``hash``.

    Documents that repeat beyond a bound, 10,000 of them at most, are dealt by their place and not by their hash alone.
    """
    whole = max(1, -(-tokens // SHARD_TOKENS))
    rounds = max(1, min(ROUNDS, whole // LEAST_SHARDS))
    each = min(MOST_SHARDS, -(-whole // rounds))
    texts = rows.where("not held_out").select("ids", F.xxhash64("ids").alias("hash"), F.col("uid").alias("place"))
    often = materialize(texts.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > max(COPIES, documents // 10_000)).select("hash", F.lit(1).alias("often")), "copies")
    dealt = texts.join(F.broadcast(often), "hash", "left").withColumn("deal", F.pmod(F.xxhash64("hash", F.when(F.col("often") == 1, F.col("place"))), F.lit(rounds * each)).cast("int"))
    return rounds, each, dealt.select((F.col("deal") / each).cast("int").alias("round"), F.pmod("deal", F.lit(each)).alias("shard"), "hash", "ids")


def refined(rows: DataFrame, network: Network, tables: Tables, tokens: int, documents: int, fan: int = 16) -> Network:
    """The network after all training documents: in each round the mean of what the shards make of it.

    A task holds one stretch of tokens at a time; parameters, about 1 MB a shard, meet ``fan`` at a time.
    """
    small_batches(rows.sparkSession)
    rounds, each, dealt = shards(rows, tokens, documents)
    schema = "part long, tokens double, data binary"

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        weight = pdf["tokens"].to_numpy()
        flat = sum(w * np.frombuffer(d, "<f4").astype(np.float64) for w, d in zip(weight / weight.sum(), pdf["data"], strict=True))
        return pd.DataFrame({"part": [pdf["part"].iloc[0] // fan], "tokens": [weight.sum()], "data": [flat.astype("<f4").tobytes()]})

    for number in range(rounds):
        own = dealt.where(F.col("round") == number).select("shard", "hash", "ids").repartitionById(each, "shard").sortWithinPartitions("shard", "hash")
        parts = materialize(own.select("shard", "ids").mapInArrow(_training(rows, network, tables), schema), "parameters")
        last = parts.agg(F.max("part")).first()[0]
        while last:
            parts = materialize(parts.groupBy(F.floor(F.col("part") / fan)).applyInPandas(mean, schema), "parameters")
            last //= fan
        found = parts.select("data").collect()
        network = network.unpacked(bytes(found[0]["data"])) if found else network
    return network


def _training(rows: DataFrame, network: Network, tables: Tables):
    """What a task does with the sorted documents of its shards."""
    sent = rows.sparkSession.sparkContext.broadcast((network.packed(), tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, tables = sent.value
        now, own, seen, held, size = None, None, 0, [], 0

        def learn() -> None:
            nonlocal seen, held, size
            if size:
                own.train(streams_of(held, tables), tables, rate=RATE, decay=False)
            seen, held, size = seen + size, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if own is not None:
                learn()
                yield pa.RecordBatch.from_pydict({"part": pa.array([now], pa.int64()), "tokens": [float(seen)], "data": pa.array([own.packed()], pa.binary())})

        for batch in batches:
            for shard, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != now:
                    yield from done()
                    now, own, seen = shard, Network(np.ones(CLASSES)).unpacked(data), 0
                held.append(np.frombuffer(ids, "<i4"))
                size += len(held[-1])
                if size >= CHUNK:
                    learn()
        yield from done()

    return run


class Scorer:
    """Runs documents side by side, each through all its windows."""

    def __init__(self, network: Network, tables: Tables):
        self.network, self.tables = network, tables
        self.gates = network.by_gates()
        self.h = np.zeros((PLACES, HIDDEN), np.float32)
        self.doc: list = [None] * PLACES
        self.at = [0] * PLACES
        self.total = [0.0] * PLACES
        self.key: list = [None] * PLACES

    def run(self, docs: Iterator[tuple[object, np.ndarray]]) -> Iterator[tuple[object, float]]:
        """Documents as (key, inputs, classes and words in three rows) to (key, summed natural log of probabilities)."""
        busy, serial = 0, 0
        # Documents read ahead, the longest first, so that no long one is left to run alone at the end.
        ahead: list[tuple[int, int, object, np.ndarray]] = []
        room, more = AHEAD, True
        while True:
            while more and room > 0:
                found = next(docs, None)
                if found is None:
                    more = False
                    break
                serial += 1
                room -= found[1].shape[1]
                heapq.heappush(ahead, (-found[1].shape[1], serial, *found))
            for i in range(PLACES):
                if ahead and self.doc[i] is None:
                    size, _, self.key[i], self.doc[i] = heapq.heappop(ahead)
                    room -= size
                    self.at[i], self.total[i] = 0, 0.0
                    busy += 1
            if not busy:
                return
            active = [i for i in range(PLACES) if self.doc[i] is not None]
            lengths = [min(WINDOW, self.doc[i].shape[1] - self.at[i]) for i in active]
            steps = max(lengths)
            window = np.empty((3, len(active), steps), np.int64)
            window[0], window[1:] = INPUTS + CLASSES, -1
            for j, (i, n) in enumerate(zip(active, lengths, strict=True)):
                window[:, j, :n] = self.doc[i][:, self.at[i] : self.at[i] + n]
            x, y, words = window.transpose(0, 2, 1)
            states = self.network.states(x, self.h[active], gates=self.gates)
            self.h[active] = states[-1]
            flat, y, words = states.reshape(-1, HIDDEN), y.ravel(), words.ravel()
            logs = self.network.of_classes(flat, y) + self.network.of_words(flat, y, words, self.tables)
            for i, n, s in zip(active, lengths, logs.reshape(steps, -1).sum(axis=0).tolist(), strict=True):
                self.total[i] += s
                self.at[i] += n
                if self.at[i] >= self.doc[i].shape[1]:
                    yield self.key[i], self.total[i]
                    self.doc[i] = None
                    busy -= 1


def score(docs: DataFrame, sample_docs: int = 2000, steps: int = 200, vocabulary: int = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base and the model's log10 probability of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(crc_mod(id_col, 10) == 0, F.lit(False)).alias("held_out"))
    counts = materialize(count_words(rows.where("not held_out")), "counts")
    found = levels(counts)
    total, distinct = sum(r["c"] for r in found), sum(r["n"] for r in found)
    top = frequent(counts, vocabulary, found)
    tail = np.zeros((TAIL, 2))
    for r in found:
        tail[r["k"]] += r["c"], r["once"]
    for _, k, c in top:
        tail[k] -= c, 0
    base = np.log10((np.array([c for _, _, c in top], np.float64) + ALPHA) / (total + ALPHA * (distinct + 1)))
    tokens = materialize(_tokens(rows, [w for w, _, _ in top], base), "tokens")
    short = tokens.where(~F.col("held_out") & (F.col("n_tokens") <= SAMPLE_TOKENS))
    picked = short.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    found = short.join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("ids")).limit(sample_docs).select("ids").collect()
    sample = [np.frombuffer(r["ids"], "<i4") for r in found]
    tables = tables_of(top, tail, total, distinct, corpus_kinds(tokens, sample, len(top)))
    network = Network(tables.mass)
    if sample:
        network.train(streams_of(sample, tables), tables, steps)
    if total:
        documents = next((c for w, _, c in top if not w), 0)
        network = refined(tokens, network, tables, total, documents)
    scored = materialize(_scored(tokens, network, tables), "scored")
    unknown = math.log10(ALPHA / (total + ALPHA * (distinct + 1)))
    return _with_tail(scored, tokens, counts, tables, unknown, total, distinct)


def _tokens(rows: DataFrame, frequent: list[bytes], base: np.ndarray) -> DataFrame:
    """A row per document: its word numbers, 4 bytes each, what the frequent ones say, and its tail words with their counts."""
    small_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast((pa.array(frequent, pa.binary()), base))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def tails(found: Numbered) -> pa.Array:
        flat = pa.StructArray.from_arrays([found.words.cast(pa.string()).take(pa.array(found.tail)), pa.array(-1 - found.numbers[found.tail], pa.int32()), pa.array(found.tail_counts, pa.int64())], ["word", "k", "n"])
        return pa.ListArray.from_arrays(pa.array(found.tail_begin, pa.int32()), flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, base = sent.value
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = all_numbered(split(batch.column(1)), number)
            if not batch.num_rows:
                continue
            begin, known = found.begin[:-1], found.ids >= 0
            base_of = np.zeros(len(known))
            base_of[known] = base[found.ids[known]]
            ends = pa.py_buffer((found.begin * 4).astype(np.int32))
            yield pa.RecordBatch.from_pydict({
                "uid": pa.array(range(serial, serial + batch.num_rows), pa.int64()),
                "doc_id": batch.column(0),
                "held_out": batch.column(2),
                "n_tokens": pa.array(np.diff(found.begin), pa.int64()),
                "n_top": pa.array(np.add.reduceat(known, begin, dtype=np.int64)),
                "base_top": pa.array(np.add.reduceat(base_of, begin)),
                "ids": pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, ends, pa.py_buffer(found.ids.astype("<i4"))]),
                "tail": tails(found),
            })
            serial += batch.num_rows

    schema = f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_top long, base_top double, ids binary, tail array<struct<word:string,k:int,n:long>>"
    return rows.select("doc_id", "text", "held_out").mapInArrow(run, schema)


def _scored(tokens: DataFrame, network: Network, tables: Tables) -> DataFrame:
    """``uid`` and the sum of a document's log10 probabilities of classes, and of its frequent words within them."""
    small_batches(tokens.sparkSession)
    sent = tokens.sparkSession.sparkContext.broadcast((network, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        keep_memory()
        network, tables = sent.value

        def feed() -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                if batch.num_rows:
                    docs = [np.frombuffer(x, "<i4") for x in batch.column(1).to_pylist()]
                    parts = np.split(tables.fed(docs).astype(np.int32), np.cumsum([len(d) for d in docs])[:-1], axis=1)
                    yield from zip(batch.column(0).to_pylist(), parts, strict=True)

        done = Scorer(network, tables).run(feed())
        while part := list(itertools.islice(done, 4096)):
            yield pa.RecordBatch.from_pydict({"uid": pa.array([k for k, _ in part], pa.int64()), "score_top": pa.array([x / math.log(10) for _, x in part], pa.float64())})

    return tokens.select("uid", "ids").mapInArrow(run, "uid long, score_top double")


def _with_tail(scored: DataFrame, tokens: DataFrame, counts: DataFrame, tables: Tables, unknown: float, total: int, distinct: int) -> DataFrame:
    """Adds the tail words' part, by a join with the counts."""
    known, new = (F.get(F.array(*[F.lit(float(x)) for x in logs]), F.col("k")) for logs in (tables.tail_known, tables.tail_unknown))
    found = tokens.select("uid", F.explode("tail").alias("t")).select("uid", "t.word", "t.k", "t.n").join(counts.select("word", "c"), "word", "left")
    c = F.coalesce("c", F.lit(0)).cast("double") + ALPHA
    base = F.when(F.col("c").isNull(), F.lit(unknown)).otherwise(F.log10(c / F.lit(total + ALPHA * (distinct + 1))))
    model = F.when(F.col("c").isNull(), new).otherwise(F.log10("c") + known)
    tail = found.groupBy("uid").agg(F.sum(F.col("n") * base).alias("base_tail"), F.sum(F.col("n") * model).alias("score_tail"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_tail"))
    return tokens.drop("ids", "tail").join(scored, "uid").join(tail, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_top") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_top") + F.coalesce("base_tail", F.lit(0.0))).alias("base_score"),
        (F.col("score_top") + F.coalesce("score_tail", F.lit(0.0))).alias("score"),
    )
