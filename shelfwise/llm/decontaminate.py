"""Benchmark decontamination: windows of benchmark words are found in training texts.

The distinct windows of all benchmark items are hashed; their set goes to all tasks, in parts of
a bounded size with one pass over the texts for each. A window of a text whose hash is in the
set is compared by its words, and the words inside true occurrences are hit. Texts or only their
hit words can then be removed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import text_slices, texts_of, whole_row, written
from shelfwise.llm.pretoken import powers
from shelfwise.llm.words import LETTERS, Words

WINDOW = 10
#: Bytes of window words and item ids in a part of the set; a larger set goes in several parts.
PART_BYTES = 16 << 20
#: Bits by which most windows of a text are passed over without a search.
SIEVE_BITS = 20


def window_hashes(hashes: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows of ``length`` words that start at ``first``."""
    power, inverse = powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[:-1], out=sums[1:])
    return (sums[first + length] - sums[first]) * inverse[first]


def lines(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words of a slice joined by one blank, and where each starts and ends there."""
    sizes = words.ends - words.starts
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    line = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    shift = np.repeat(words.starts - starts, sizes)
    at = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    line[at] = words.raw[at + shift]
    return line.tobytes(), starts, ends


WINDOWS = "item_id long, length int, hash long, words binary"


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """The windows of every whole item text; an item of fewer words, but not none, is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in text_slices(texts):
                words = Words(texts.slice(a, b - a), LETTERS, lower=True)
                line, starts, ends = lines(words)
                out = []
                for row in range(b - a):
                    own = words.of(row)
                    n = own.stop - own.start
                    length = min(n, size)
                    first = np.arange(own.start, own.stop - length + 1) if n else np.zeros(0, np.int64)
                    names = window_hashes(words.hashes, first, length).astype(np.int64)
                    for i, h in zip(first.tolist(), names.tolist(), strict=True):
                        out.append((batch.column(0)[a + row].as_py(), length, h, line[starts[i] : ends[i + length - 1]]))
                columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    [f.split()[0] for f in WINDOWS.split(", ")],
                )

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, WINDOWS)


class WindowSet:
    """A part of the windows: the hashes by length, and the items of the words behind each."""

    def __init__(self, rows: list):
        self.items = {bytes(r.words): tuple(r.items) for r in rows}
        self.lengths = []
        for length in sorted({r.length for r in rows}):
            known = np.unique(np.array([r.hash for r in rows if r.length == length], np.int64).view(np.uint64))
            sieve = np.zeros(1 << SIEVE_BITS, bool)
            sieve[known >> np.uint64(64 - SIEVE_BITS)] = True
            self.lengths.append((length, known, sieve))

    def search(self, words: Words) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(first word, length, items) of every true occurrence in a slice of texts."""
        text = None
        counts = np.diff(words.doc_ends)
        for length, known, sieve in self.lengths:
            has = np.maximum(counts - length + 1, 0)
            ends = np.cumsum(has)
            first = np.repeat(words.doc_ends[:-1] - (ends - has), has) + np.arange(int(has.sum()))
            h = window_hashes(words.hashes, first, length)
            some = np.flatnonzero(sieve[h >> np.uint64(64 - SIEVE_BITS)])
            h = h[some]
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            for i in first[some[known[at] == h]].tolist():
                if text is None:
                    text, starts, stops = lines(words)
                items = self.items.get(text[starts[i] : stops[i + length - 1]])
                if items is not None:
                    yield i, length, items


def window_sets(items: DataFrame, size: int, part_bytes: int) -> list[DataFrame]:
    """The distinct windows of all items with the ids of theirs, in parts of about ``part_bytes``."""
    windows = item_windows(items, size).groupBy("length", "hash", "words")
    known = written(windows.agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    weight = F.sum(F.octet_length("words") + F.size("items") * 8 + 64)
    parts = max(1, math.ceil((known.agg(weight).first()[0] or 0) / part_bytes))
    part = F.pmod(F.xxhash64("length", "hash"), F.lit(parts))
    return [known.where(part == k) for k in range(parts)]


def marked(
    docs: DataFrame,
    items: DataFrame,
    size: int = WINDOW,
    keep: list[str] | None = None,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``row`` (the columns ``keep`` of ``docs``, or all), ``n_words``, ``runs`` and ``items``.

    ``runs`` are the hit words as (first word, word after the last) pairs in a flat list, sorted
    and apart from each other; ``items`` are the ids of the items with windows that occur, sorted.
    Words are runs of letters, digits and characters beyond ASCII, A to Z in lower case. Null or
    empty texts have no words; items without an id hit words but are not listed; of items that
    share an id the windows are put together; an empty table of items hits nothing.
    """
    nothing = F.lit(None).cast("array<long>")
    held = docs.select(whole_row(docs.select(keep or docs.columns)), "text", nothing.alias("runs"), nothing.alias("items"))
    parts = window_sets(items, size, part_bytes)
    for k, part in enumerate(parts):
        known = docs.sparkSession.sparkContext.broadcast(WindowSet(part.collect()))
        last = k == len(parts) - 1
        held = _searched(held, known, [] if last else ["text"])
        if not last:
            held = written(held)
    return held


def _searched(held: DataFrame, shared, more: list[str]) -> DataFrame:
    """``held`` with the runs and items of one part of the windows added to those it has."""
    names = ["row", *more, "n_words", "runs", "items"]
    schema = held.withColumn("n_words", F.lit(0).cast("long")).select(names).schema
    lists = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = texts_of(batch)
            for a, b in text_slices(texts):
                words = Words(texts.slice(a, b - a), LETTERS, lower=True)
                edge = np.zeros(len(words.hashes) + 1, np.int64)
                found: list[set[int]] = [set() for _ in range(b - a)]
                columns = {n: batch.column(i).slice(a, b - a) for i, n in enumerate(batch.schema.names)}
                for i, length, ids in known.search(words):
                    edge[i] += 1
                    edge[i + length] -= 1
                    found[int(np.searchsorted(words.doc_ends, i, side="right")) - 1].update(ids)
                for row, runs in enumerate(columns["runs"].to_pylist()):
                    start = words.doc_ends[row]
                    for x, y in zip((runs or ())[::2], (runs or ())[1::2], strict=True):
                        edge[start + x] += 1
                        edge[start + y] -= 1
                hit = np.cumsum(edge[:-1]) > 0
                runs = [_runs(hit[words.of(r)]) for r in range(b - a)] if hit.any() else [[]] * (b - a)
                ids = [sorted(f.union(x or ())) for f, x in zip(found, columns["items"].to_pylist(), strict=True)]
                columns |= {"runs": pa.array(runs, lists), "items": pa.array(ids, lists)}
                columns["n_words"] = pa.array(np.diff(words.doc_ends), pa.int64())
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return held.mapInArrow(run, schema)


def _runs(hit: np.ndarray) -> list[int]:
    """Where runs of true values start and end, in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).tolist()


def hit_report(docs: DataFrame, items: DataFrame, size: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs``.

    items_sha256 is that of the ids of the items, sorted as strings and joined by commas.
    """
    found = marked(docs, items, size, ["doc_id"], part_bytes)
    signed = F.transform("runs", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda s, x: s + x)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def drop_documents(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs``, all columns, without the documents in which any window of an item occurs."""
    return marked(docs, items, size).where(F.size("runs") == 0).select("row.*")


def drop_spans(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs``, all columns, with the hit words cut out of the texts, from the first letter of a
    run of hit words to the last; other texts are left as they are."""
    found = marked(docs, items, size)
    schema = found.schema["row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_struct_array(batch.column(0))
            texts, runs = texts_of(rows), batch.column(1).to_pylist()
            clean = rows.column(rows.schema.get_field_index("text")).to_pylist()
            for i, own in enumerate(runs):
                if own:
                    words = Words(texts.slice(i, 1), LETTERS, lower=True)
                    raw, at, kept = texts[i].as_py().encode(), 0, []
                    for x, y in zip(own[::2], own[1::2], strict=True):
                        kept.append(raw[at : words.starts[x]])
                        at = int(words.ends[y - 1])
                    clean[i] = b"".join([*kept, raw[at:]]).decode()
            columns = [
                pa.array(clean, pa.string()) if n == "text" else rows.column(i)
                for i, n in enumerate(rows.schema.names)
            ]
            yield pa.RecordBatch.from_arrays(columns, rows.schema.names)

    return found.select("row", "runs").mapInArrow(run, schema)
