"""Near-duplicate documents: MinHash bands propose, odd sketches sift, full sets confirm.

The samples of a document's MinHash are folded into a parity bitmap: each sample flips one bit.
The bits in which two bitmaps differ estimate the samples that differ, precisely so at high
similarity, and decide whether a pair from a band is compared on its full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import linking
from shelfwise.llm.common import text_slices, texts_of, written
from shelfwise.llm.pretoken import mix
from shelfwise.llm.words import PLAIN, Words

#: A pair of similarity 0.8 misses all bands with a probability of (1 - 0.8**4)**24 = 3e-6.
BANDS, ROWS = 24, 4
SAMPLES = BANDS * ROWS
SKETCH_WORDS = 4
SKETCH_BITS = 64 * SKETCH_WORDS
#: A pair passes the sketch from this estimate on. At a true similarity of 0.8 the estimate has
#: a standard deviation of about 0.07, so about one such pair in 100,000 fails.
ESTIMATE = 0.5
PERCENT = 80

_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADDED = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of a slice of texts, and how many come before each text.

    A text with fewer words has one shingle, its whole sequence; without words it has none.
    """
    words = Words(texts, PLAIN, lower=True)
    counts = np.diff(words.doc_ends)
    has = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    ends = np.concatenate([[0], np.cumsum(has)])
    at = np.repeat(words.doc_ends[:-1] - ends[:-1], has) + np.arange(ends[-1])
    stop = np.repeat(words.doc_ends[1:], has)
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        inside = at + k < stop
        value = np.where(inside, words.hashes[np.where(inside, at + k, 0)], 0) if len(at) else out
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + value + np.uint64(k + 1))
    return out, ends


def minima(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The MinHash samples (texts x samples) of the shingles of each text; none has all ones."""
    out = np.full((len(ends) - 1, SAMPLES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        x = (values >> np.uint64(32)).astype(np.uint32)
        for i in range(SAMPLES):
            out[full, i] = np.minimum.reduceat(x * FACTORS[i] + ADDED[i], ends[full])
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    out = np.zeros((len(samples), BANDS), np.uint64)
    out += np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        out = mix(out * np.uint64(31) + samples[:, r::ROWS])
    return out.astype(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """The parity bitmap of each row of samples, as 64-bit numbers."""
    at = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)
    bit = (mix(samples.astype(np.uint64) | at) % np.uint64(SKETCH_BITS)).astype(np.int64)
    row = np.arange(len(samples))[:, None] * SKETCH_BITS
    flips = np.bincount((row + bit).ravel(), minlength=len(samples) * SKETCH_BITS) & 1
    packed = np.packbits(flips.astype(np.uint8).reshape(-1, SKETCH_BITS), axis=1, bitorder="little")
    return packed.view("<i8").reshape(-1, SKETCH_WORDS)


def most_different_bits(estimate: float) -> int:
    """The differing bits of two sketches at which the similarity estimate is ``estimate``."""
    apart = 4 * SAMPLES * (1 - estimate) / SKETCH_BITS
    return int(SKETCH_BITS / 2 * (1 - math.exp(-apart)))


def sketches_match(a, b) -> Column:
    bits = sum(
        (F.bit_count(a(f"s{i}").bitwiseXOR(b(f"s{i}"))) for i in range(SKETCH_WORDS)), F.lit(0)
    )
    return bits <= most_different_bits(ESTIMATE)


SIGNED = (
    "doc_id long, n long, h1 long, h2 long, "
    + ", ".join(f"s{i} long" for i in range(SKETCH_WORDS))
    + ", keys array<long>"
)


def signed(docs: DataFrame, size: int) -> DataFrame:
    """Set size, set hash, odd sketch and band keys of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SIGNED.split(", ")]
        for batch in batches:
            texts = texts_of(batch)
            for a, b in text_slices(texts):
                values, ends = shingles(texts.slice(a, b - a), size)
                n, hashes = [], []
                for x, y in zip(ends[:-1], ends[1:], strict=True):
                    own = np.unique(values[x:y])
                    n.append(len(own))
                    hashes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                pair = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                samples = minima(values, ends)
                bits = odd_sketches(samples)
                keys = pa.array(band_keys(samples).ravel())
                offsets = pa.array(np.arange(0, (b - a + 1) * BANDS, BANDS), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(n, pa.int64()),
                        pa.array(pair[:, 0].copy()),
                        pa.array(pair[:, 1].copy()),
                        *[pa.array(bits[:, i].copy()) for i in range(SKETCH_WORDS)],
                        pa.ListArray.from_arrays(offsets, keys),
                    ],
                    names,
                )

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """``id, h1, items``: the sorted shingle set of every whole text and its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in text_slices(texts):
                values, ends = shingles(texts.slice(a, b - a), size)
                own = [np.unique(values[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
                hashes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in own]
                first = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)[:, 0]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in own])])
                items = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.array(np.concatenate(own).view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(first.copy()), items], ["id", "h1", "items"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "id long, h1 long, items array<long>")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents are linked when their sets of ``size``-word shingles (words between ASCII white
    space, A to Z in lower case) have ``percent`` of their union in common. component_id is
    the smallest doc_id that links reach; kept marks the document that has it. Texts without
    words are linked with nothing. Rows that share a doc_id count as one document of
    several texts; rows without a doc_id are linked with nothing, have no component and are
    kept. Other columns are ignored; an empty table gives no rows.
    """
    rows = written(signed(docs, size))
    real = rows.where("n > 0 and doc_id is not null")
    classes = written(
        real.groupBy("h1", "h2").agg(
            F.min("doc_id").alias("id"),
            F.min(F.struct("doc_id", *[f"s{i}" for i in range(SKETCH_WORDS)], "keys")).alias("r"),
        )
    )
    sketch = [F.col(f"r.s{i}").alias(f"s{i}") for i in range(SKETCH_WORDS)]
    keyed = classes.select("id", F.explode("r.keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = written(keyed.join(shared, "key", "left_semi"))
    involved = met.select("id").distinct()
    members = written(met.join(classes.select("id", *sketch), "id"))
    wanted = classes.select("id", "h1").join(involved, "id", "left_semi")
    texts = docs.select("doc_id", "text").join(
        wanted.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"
    )
    sets = full_sets(texts, size).join(wanted, ["id", "h1"], "left_semi")
    sets = written(sets.select("id", "items"))
    bits = [f"s{i}" for i in range(SKETCH_WORDS)], most_different_bits(ESTIMATE)
    roots = linking.link(members, sets, percent, sketches_match, bits)
    # a doc_id that comes with several texts joins their classes
    twice = real.groupBy("doc_id").agg(
        F.min(F.struct("h1", "h2")).alias("x"), F.max(F.struct("h1", "h2")).alias("y")
    ).where("x <> y")
    by_class = classes.select("h1", "h2", "id").join(roots, "id", "left")
    by_class = by_class.select("h1", "h2", F.coalesce("root", "id").alias("root"))
    if not twice.isEmpty():
        by_class = _joined_by_id(real, by_class)
    own = rows.join(by_class, ["h1", "h2"], "left")
    root = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("root"))
    return own.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce(root, F.col("doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce(root, F.col("doc_id")), F.lit(True)).alias("kept"),
    )


def _joined_by_id(real: DataFrame, by_class: DataFrame) -> DataFrame:
    """Class roots after joining the classes that the texts of one doc_id lie in."""
    met = real.select("doc_id", "h1", "h2").join(by_class, ["h1", "h2"]).select("doc_id", "root")
    links = met.select(F.least("doc_id", "root").alias("a"), F.greatest("doc_id", "root").alias("b"))
    top = linking.components(links).select(F.col("id").alias("root"), F.col("root").alias("top"))
    found = by_class.join(top, "root", "left")
    return found.select("h1", "h2", F.coalesce("top", "root").alias("root"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs``, all columns, without the documents that are not the kept one of their component.

    Rows without a doc_id stay. Of rows that share a doc_id the smallest stays, in the order of
    the columns.
    """
    found = near_duplicates(docs, size, percent)
    gone = written(found.where("not kept").select("doc_id").distinct())
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    twice = written(twice)
    if twice.isEmpty():
        return left
    many = left.join(twice, "doc_id", "left_semi").groupBy("doc_id")
    one = many.agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return left.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(one)
