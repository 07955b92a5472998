"""Quality classifier with supervised subword embeddings.

A document is the mean of its words, a word the mean of the vectors of the word itself and of its
character n-grams, hashed into a fixed number of buckets; a word equal to the one before it adds
one shared feature, the bucket of repeated pairs. A softmax layer follows. Vectors and layer are
trained with numpy by stochastic gradient descent on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import text_slices, texts_of
from shelfwise.llm.pretoken import span_hashes
from shelfwise.llm.words import Words

BUCKETS = 1 << 13
GRAMS = (3, 4)
SIZE = 16
#: Labelled documents that the model is trained on, at most; chosen by the hash of their id.
SAMPLE = 3000
EPOCHS = 30
THRESHOLD = 0.3
REPEATED = 0  # the bucket of a word that follows itself


def gram_buckets(words: Words, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the words numbered ``first``, and how many each word has."""
    starts, ends = words.starts[first], words.ends[first]
    sizes = ends - starts + 2
    bounds = np.cumsum(sizes) - sizes
    values = np.full(int(sizes.sum()), 0x3E, np.uint8)
    values[bounds] = 0x3C
    inner = np.repeat(starts - bounds - 1, sizes) + np.arange(len(values))
    inside = np.ones(len(values), bool)
    inside[bounds] = inside[bounds + sizes - 1] = False
    values[inside] = words.raw[inner[inside]]
    owner = np.repeat(np.arange(len(first)), sizes)
    last = np.repeat(bounds + sizes, sizes)
    at = np.arange(len(values))
    parts, owners = [span_hashes(values, bounds, bounds + sizes)], [np.arange(len(first))]
    for n in GRAMS:
        begin = at[at + n <= last]
        parts.append(span_hashes(values, begin, begin + n))
        owners.append(owner[begin])
    own = np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    found = 1 + (np.concatenate(parts)[order] % np.uint64(BUCKETS - 1)).astype(np.int64)
    return found, np.bincount(own, minlength=len(first))


def distinct_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    codes, distinct = pd.factorize(words.hashes)
    first = np.empty(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, first


def repeats(words: Words) -> np.ndarray:
    """Whether each word equals the word before it in its text."""
    same = np.zeros(len(words.hashes), bool)
    same[1:] = words.hashes[1:] == words.hashes[:-1]
    begins = words.doc_ends[:-1]
    same[begins[begins < len(same)]] = False
    return same


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets and their weights; the weights of a text with words add up to 1,
    and up to 1 more by repeated words."""
    words = Words(texts)
    codes, first = distinct_words(words)
    if not len(codes):
        return [(np.zeros(0, np.int32), np.zeros(0, np.float32))] * len(texts)
    grams, sizes = gram_buckets(words, first)
    begins = np.cumsum(sizes) - sizes
    same = repeats(words)
    out = []
    for row in range(len(texts)):
        part = words.of(row)
        own, counts = np.unique(codes[part], return_counts=True)
        weight = np.zeros(BUCKETS)
        if len(own):
            n = sizes[own]
            at = np.repeat(begins[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            total = part.stop - part.start
            np.add.at(weight, grams[at], np.repeat(counts / n / total, n))
            weight[REPEATED] = same[part].mean()
        at = np.flatnonzero(weight)
        out.append((at.astype(np.int32), weight[at].astype(np.float32)))
    return out


@dataclass
class Model:
    """``vectors`` (buckets x size), ``layer`` (size x 2), ``bias`` (2)."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def margins(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the margin of label 1, as softmax and mean are applied to
        sums of vectors; and the constant part."""
        return self.vectors @ (self.layer[:, 1] - self.layer[:, 0]), float(self.bias[1] - self.bias[0])


def train(
    docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 4.0, seed: int = 7
) -> Model:
    """Stochastic gradient descent over small batches; ``docs`` has buckets and weights of each
    document, which are spread out for one batch at a time."""
    rng = np.random.default_rng(seed)
    model = Model(
        rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32),
        rng.uniform(-1, 1, (SIZE, 2)).astype(np.float32),
        np.zeros(2, np.float32),
    )
    batch, steps = 16, 0
    total = max(1, epochs * -(-len(docs) // batch))
    target = np.eye(2, dtype=np.float32)[labels]
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for a in range(0, len(docs), batch):
            rows = order[a : a + batch]
            used, at = np.unique(np.concatenate([docs[r][0] for r in rows]), return_inverse=True)
            x = np.zeros((len(rows), len(used)), np.float32)
            owner = np.repeat(np.arange(len(rows)), [len(docs[r][0]) for r in rows])
            x[owner, at] = np.concatenate([docs[r][1] for r in rows])
            hidden = x @ model.vectors[used]
            raw = hidden @ model.layer + model.bias
            raw = np.exp(raw - raw.max(axis=1, keepdims=True))
            error = (raw / raw.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            step = np.float32(rate * (1 - steps / total))
            back = error @ model.layer.T
            model.layer -= step * (hidden.T @ error)
            model.bias -= step * error.sum(axis=0)
            model.vectors[used] -= step * (x.T @ back)
            steps += 1
    return model


def held_out(doc_id):
    """One document in five, by the checksum of its id, is kept out of training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model of ``labels.quality`` from at most ``sample`` labelled documents outside the
    held-out part. Null labels are left out; of repeated ones the largest counts. Without any
    labelled document the model is neutral (score 0.5)."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col("quality").cast("int")).alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in text_slices(texts):
                found = features(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array([f.tobytes() for f, _ in found], pa.binary()),
                        pa.array([w.tobytes() for _, w in found], pa.binary()),
                    ],
                    ["doc_id", "quality", "buckets", "weights"],
                )

    # at most ``sample`` rows, a bounded size, so the texts stay where they are
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = own.select("doc_id", "quality", "text").mapInArrow(
        run, "doc_id long, quality int, buckets binary, weights binary"
    )
    # repeated ids of the sample come out more than once: the smallest features count
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("buckets", "weights", "quality")).alias("r"))
    rows = sorted((r[0], *r[1]) for r in rows.collect())
    x = [(np.frombuffer(b, np.int32), np.frombuffer(w, np.float32)) for _, b, w, _ in rows]
    y = np.array([min(max(q, 0), 1) for *_, q in rows], np.int64)
    if not len(rows):
        return Model(np.zeros((BUCKETS, SIZE)), np.zeros((SIZE, 2)), np.zeros(2))
    return train(x, y)


def margins(texts: pa.Array, model_margins: np.ndarray, bias: float) -> np.ndarray:
    """The margin of label 1 for each text of a slice."""
    words = Words(texts)
    codes, first = distinct_words(words)
    if not len(codes):
        return np.full(len(texts), bias)
    grams, sizes = gram_buckets(words, first)
    each = np.add.reduceat(model_margins[grams], np.cumsum(sizes) - sizes) / sizes
    value = each[codes] + model_margins[REPEATED] * repeats(words)
    row = np.repeat(np.arange(len(texts)), np.diff(words.doc_ends))
    sums = np.bincount(row, weights=value, minlength=len(texts))
    return bias + sums / np.maximum(np.diff(words.doc_ends), 1)


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text.

    A text without words scores the prior; null texts count as empty, null ids stay null and are
    not held out; repeated rows are scored each; other columns are ignored.
    """
    per_bucket, bias = model.margins()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "text")
            for a, b in text_slices(texts):
                value = margins(texts.slice(a, b - a), per_bucket, bias)
                scores = 1 / (1 + np.exp(-np.clip(value, -500, 500)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array(scores),
                        pa.array((scores >= threshold).astype(np.int32)),
                    ],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, SCORED)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``."""
    per_bucket, bias = model.margins()
    least = float(np.log(threshold / (1 - threshold)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).fill_null("")
            for a, b in text_slices(texts):
                good = margins(texts.slice(a, b - a), per_bucket, bias) >= least
                yield batch.slice(a, b - a).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
