"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a vector of tf-idf weights over hashed terms: its words in lower case, three-grams of its shape (letters
reduced to one mark per case and run) and repetition marks (equal neighbouring words, equal lines, few
different words). A singular value decomposition of the sample gives the latent space. The vectors
of the labelled sample are broadcast; every document is compared with all of them by exact
blocked products of unit vectors, and the labels of its nearest neighbours are
weighted by similarity.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwise.llm.common import attach, remainder, table
from postwise.llm.toxicity import sample

# Bound of the labelled sample: rows of each class (its texts are bounded as well).
SAMPLE_ROWS = 1024
GRAMS = 4032
MARKS = 64
WORDS = 4096
TERMS = GRAMS + MARKS + WORDS
# Weight of a word beside a three-gram: shapes recur in texts of any wording, so a word counts for less.
WORD_SCALE = 0.25
RANK = 48
NEIGHBOURS = 15
THRESHOLD = 0.3

SHAPE = bytes(
    0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x39 if 0x30 <= b <= 0x39 else b
    for b in range(256)
)
LETTERS = re.compile(rb"([aA])\1+")


def _mark(vector: np.ndarray, first: int, share: float) -> None:
    """Terms for a share: one more for each step that it reaches, from 1 % to over 70 %."""
    for k, step in enumerate((0.01, 0.03, 0.08, 0.15, 0.25, 0.4, 0.55, 0.7)):
        if share >= step:
            vector[GRAMS + first + k] = 100.0


def term_weights(body: bytes) -> np.ndarray:
    """Unscaled term weights of a whole text: sublinear in the share of each term."""
    out = np.zeros(TERMS, np.float32)
    shape = LETTERS.sub(rb"\1", body.translate(SHAPE))
    codes = np.frombuffer(shape, np.uint8).astype(np.uint32)
    if len(codes) >= 3:
        grams = (codes[:-2] * np.uint32(0x9E3779B1)) ^ (codes[1:-1] * np.uint32(0x85EBCA6B)) ^ (codes[2:] * np.uint32(0xC2B2AE35))
        slots = ((grams * np.uint32(0x27D4EB2F)) >> np.uint32(8)) % np.uint32(GRAMS)
        out[:GRAMS] = np.bincount(slots, minlength=GRAMS) * (1000.0 / len(grams))
    words = body.split()
    if words:
        # One equal pair happens by chance.
        _mark(out, 0, (sum(map(eq, words, words[1:])) - 1) / len(words))
        # Few different words say more the longer the text is.
        _mark(out, 8, max(0.0, 1 - len(set(words)) / len(words) - 0.1 * np.log10(len(words))))
        lines = body.split(b"\n")
        _mark(out, 16, 1 - len(set(lines)) / len(lines))
    weights = np.log1p(out)
    counts = Counter(words)
    if counts:
        slots = np.fromiter((zlib.crc32(w.lower()) % WORDS for w in counts), np.int64, len(counts))
        shares = np.bincount(slots, np.fromiter(counts.values(), np.float64, len(counts)), WORDS) * (1000.0 / len(words))
        weights[GRAMS + MARKS :] = WORD_SCALE * np.log1p(shares)
    return weights


@dataclass(frozen=True)
class Neighbours:
    """Term scales, the latent axes, the labelled unit vectors and the share of label 1."""

    scale: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def place(self, weights: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; a text without known terms stays zero."""
        found = (weights * self.scale) @ self.axes
        norms = np.linalg.norm(found, axis=1, keepdims=True)
        return np.divide(found, norms, out=np.zeros_like(found), where=norms > 1e-6)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Shares of label 1 among the nearest, weighted by similarity; the prior without a similar text."""
        if not len(self.vectors):
            return np.full(len(weights), self.prior)
        near = self.place(weights) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        # The k-th similarity and all ties with it vote, so the order of the sample does not matter.
        edge = np.partition(near, -k, axis=1)[:, -k]
        votes = np.where((near >= edge[:, None] - 1e-6) & (near > 0), near, 0).astype(np.float64)
        total = votes.sum(axis=1)
        ones = votes @ self.labels
        return np.where(total > 0, ones / np.where(total > 0, total, 1), self.prior)


def fit(texts: list[bytes], labels: np.ndarray) -> Neighbours:
    """The latent space of the sample; without rows every score is one half."""
    if not texts:
        nothing = np.zeros((0, RANK), np.float32)
        return Neighbours(np.zeros(TERMS, np.float32), np.zeros((TERMS, RANK), np.float32), nothing, labels, 0.5)
    weights = np.stack([term_weights(t) for t in texts])
    scale = np.log((1 + len(texts)) / (1 + (weights > 0).sum(axis=0))).astype(np.float32)
    scaled = weights * scale
    # The right singular vectors through the smaller Gram matrix.
    values, left = np.linalg.eigh((scaled @ scaled.T).astype(np.float64))
    top = np.argsort(values)[::-1][:RANK]
    top = top[values[top] > 1e-9 * max(values.max(), 1e-12)]
    axes = (scaled.T @ left[:, top] / np.sqrt(values[top])).astype(np.float32)
    bare = Neighbours(scale, axes, np.zeros((0, axes.shape[1]), np.float32), labels, float(labels.mean()))
    return Neighbours(scale, axes, bare.place(weights), labels.astype(np.float64), float(labels.mean()))


def train(docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, training: Column) -> Neighbours:
    """Neighbours from a bounded sample of the rows of ``labels`` for which ``training`` holds.

    A doubly labelled id counts as 1 if any of its labels is; other labels than 0 and 1 are left out.
    """
    chosen = labels.filter(training & F.col(label).isin(0, 1) & F.col(id_column).isNotNull())
    rows = chosen.groupBy(id_column).agg(F.max(label).alias(label))
    picked = sample(rows, docs.select(id_column, text), id_column, text, label, SAMPLE_ROWS)
    # At most 2 x SAMPLE_ROWS whole texts of at most 16 MB together.
    found = picked.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(label).cast("int").alias("y")).toArrow()
    texts = [t.encode() for t in found.column("t").to_pylist()]
    return fit(texts, np.array(found.column("y").to_pylist(), dtype=np.float64))


def classify(
    df: DataFrame, model: Neighbours, text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None
) -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Null and empty texts resemble nothing and get the share of label 1 in the sample. Equal texts get
    equal scores. Input columns named like the new ones are replaced.
    """
    # Arrays, not the object: what is broadcast is unpickled by workers that may lack this package.
    parts = (model.scale, model.axes, model.vectors, model.labels, model.prior)
    shared = df.sparkSession.sparkContext.broadcast(parts)

    def make():
        neighbours = Neighbours(*shared.value)

        def run(texts: list[bytes]) -> list:
            scores = np.concatenate(
                [
                    neighbours.scores(np.stack([term_weights(t) for t in texts[at : at + 128]]))
                    for at in range(0, len(texts), 128)
                ]
            )
            scores = np.clip(scores, 0, 1)
            return [scores, (scores >= threshold).astype(np.int32)]

        return run

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return attach(df, text, fields, make, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document scored for quality; learned from rows that are not held out."""
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), remainder("doc_id", 5) == 0
    model = train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality", ~held_out)
    return classify(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")
