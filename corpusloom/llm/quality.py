"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words, in lower case and hashed to ``WORDS`` buckets, and its form: three-byte windows over
12 classes of bytes (letters in either case, digits, kinds of punctuation, white space, line ends, non-ASCII), and
how often words and lines repeat, which tell junk from prose in any language.  Square roots of term frequencies,
centred, are projected on the leading singular directions, of words and form together, of a bounded sample of labelled rows (``sample`` of them, by the order of their identifiers'
hashes, outside the held-out fold).  The sample's vectors and labels, a few hundred kB whatever the corpus,
are broadcast; every document's cosines with all of them are computed exactly, block by block, and its
nearest ``neighbours`` vote with their similarities.

Null and empty texts, and texts like nothing in the sample, score the mean label; without labels that is 0.5.
Repeated rows score alike; rows of a null label teach nothing; of rows that repeat a labelled identifier the
smallest text is learned from, with the mean of its labels; identifiers are never looked at by a score.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, crc_mod, one_thread

CLASSES = 12
EXTRA = 4
#: Buckets of words, and what they weigh beside the form.
WORDS, WEIGHT = 1024, 0.5


def _classes() -> np.ndarray:
    out = np.full(256, 11, np.uint16)
    for i, members in enumerate([b" ", b"\n", b"aeiouy", b"bcdfghjklmnpqrstvwxz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;", b"!?", b"|", b"#*$%&<>", b"'\"()[]{}-_/=:+@\\^~`"]):
        out[list(members)] = i
    return out


CLASS_OF = _classes()
FORM = CLASSES**3 + EXTRA
TERMS = FORM + WORDS


def terms(text: str | None) -> np.ndarray:
    """Square roots of a text's term frequencies, of unit length (zero for an empty text)."""
    both = np.zeros(TERMS, np.float32)
    if not text:
        return both
    out = both[:FORM]
    raw = text.encode("utf-8", "surrogatepass")
    c = CLASS_OF[np.frombuffer(b" " + raw + b" ", np.uint8)]
    windows = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
    out[: FORM - EXTRA] = np.bincount(windows, minlength=FORM - EXTRA) / len(windows)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    pairs = list(zip(words, words[1:], strict=False))
    out[-4] = 1 - len(set(words)) / max(1, len(words)) if words else 0
    out[-3] = 1 - len(set(pairs)) / max(1, len(pairs)) if pairs else 0
    out[-2] = 1 - len(set(lines)) / max(1, len(lines)) if lines else 0
    out[-1] = 1 / (1 + len(words))
    out[-4:] *= 0.25
    np.sqrt(out, out)
    out /= np.linalg.norm(out)
    if words:
        buckets = np.fromiter(map(zlib.crc32, raw.lower().split()), np.int64, len(words)) % WORDS
        both[FORM:] = WEIGHT * np.sqrt(np.bincount(buckets, minlength=WORDS) / len(words))
    return both / np.linalg.norm(both)


@dataclass
class Model:
    mean: np.ndarray
    basis: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled rows x dimensions, unit length
    labels: np.ndarray
    prior: float
    neighbours: int

    def project(self, rows: np.ndarray) -> np.ndarray:
        out = (rows - self.mean) @ self.basis
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Votes of the nearest labelled rows, for a block of term rows."""
        out = np.full(len(rows), self.prior)
        full = rows.any(axis=1)
        if not len(self.vectors) or not full.any():
            return out
        cosine = self.project(rows[full]) @ self.vectors.T
        k = min(self.neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** 4
        total = weight.sum(axis=1)
        vote = (weight * self.labels[near]).sum(axis=1)
        out[full] = np.where(total > 0, np.clip(vote / np.maximum(total, 1e-12), 0, 1), self.prior)
        return out


def leading(rows: np.ndarray, dimensions: int, rounds: int = 6) -> np.ndarray:
    """The leading right singular directions of rows, by subspace iteration."""
    one_thread()
    k = min(dimensions, *rows.shape)
    start = np.random.default_rng(0).normal(size=(rows.shape[1], min(k + 16, *rows.shape)))
    basis = np.linalg.qr(start)[0]
    for _ in range(rounds):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    _, turn = np.linalg.eigh((found := rows @ basis).T @ found)
    return (basis @ turn)[:, ::-1][:, :k]


def fit_rows(rows: np.ndarray, labels: np.ndarray, dimensions: int, neighbours: int) -> Model:
    if not len(rows):
        return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5, neighbours)
    mean = rows.mean(axis=0)
    centred = (rows - mean).astype(np.float64)
    model = Model(mean, leading(centred, dimensions).astype(np.float32), np.zeros((0, 1), np.float32), labels.astype(np.float64), float(labels.mean()), neighbours)
    model.vectors = model.project(rows)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4096, dimensions: int = 48, neighbours: int = 25, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model of at most ``sample`` labelled rows."""
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("mark")).dropna().where(crc_mod("doc_id", 4) != 2)
    # Rows that repeat an identifier are one: their mean label, and the first of their texts.
    picked = marked.groupBy("doc_id").agg(F.avg("mark").alias("mark")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "mark").agg(F.min("text").alias("text"))

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            return {"doc_id": batch.column(0), "mark": batch.column(1), "terms": pa.array([terms(t).astype(np.float16).tobytes() for t in batch.column(2).to_pylist()], pa.binary())}

        return work

    kind = texts.schema["doc_id"].dataType.simpleString()
    inputs = {"doc_id": F.col("doc_id"), "mark": F.col("mark"), "text": F.col("text")}
    found = sorted(arrow_pass(texts, inputs, make, f"doc_id {kind}, mark double, terms binary").collect(), key=lambda r: (r[0], r[1]))
    rows = np.array([np.frombuffer(r["terms"], np.float16) for r in found], np.float32).reshape(len(found), TERMS)
    return fit_rows(rows, np.array([r["mark"] for r in found]), dimensions, neighbours)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        held = sent.value

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            out = np.empty(batch.num_rows)
            for at in range(0, batch.num_rows, 256):
                out[at : at + 256] = held.scores(np.array([terms(t) for t in batch.column(1).slice(at, 256).to_pylist()]))
            return {"doc_id": batch.column(0), "score": pa.array(out), "predicted": pa.array((out >= threshold).astype(np.int32))}

        return work

    return arrow_pass(docs, {"doc_id": F.col(id_col), "text": F.col(text_col)}, make, f"doc_id {kind}, score double, predicted int", carry)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Every document's score, and whether its row was held out of learning."""
    rows = score(docs, fit(docs, labels), threshold)
    return rows.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
