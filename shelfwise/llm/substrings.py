"""Repeated passages: an FM-index per shard finds the windows of words that start earlier.

A window is a fixed number of words. Its rarest-looking short word sequence (the one with the
smallest hash, the leftmost of equal ones) is its anchor; equal windows have equal anchors, so
only the stretches of text around anchors that occur twice are looked at. Equal stretches are
one, with the place of the first. The distinct stretches are sharded by their anchors; each
shard is indexed by a wavelet matrix over its Burrows-Wheeler transform, the stretches are streamed
against it from right to left, and each window of full match length learns its first place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import discard, text_slices, texts_of, whole_row, written
from shelfwise.llm.pretoken import mix, powers
from shelfwise.llm.words import Words

WINDOW = 20
ANCHOR = 4
#: Stretches in a shard, and stretches of one anchor that stay together; the windows of an anchor
#: with more are dealt over several shards.
SHARD_ROWS, ANCHOR_ROWS = 10_000, 5_000


class Stretches:
    """Runs of windows with one anchor in a slice of texts.

    ``first`` is the index of a run's first window (its first word) in the slice, ``count`` its
    number of windows, ``row`` its text, ``anchor`` the hash of the anchor.
    """

    def __init__(self, words: Words, length: int):
        grams = length - ANCHOR + 1
        h = words.hashes
        gram = np.zeros(max(len(h) - ANCHOR + 1, 0), np.uint64)
        for k in range(ANCHOR):
            gram = mix(gram * np.uint64(31) + h[k : k + len(gram)] + np.uint64(k))
        windows = np.maximum(np.diff(words.doc_ends) - length + 1, 0)
        total = int(windows.sum())
        shift = words.doc_ends[:-1] - (np.cumsum(windows) - windows)
        at = np.repeat(shift, windows) + np.arange(total)
        row = np.repeat(np.arange(len(windows)), windows)
        if total:
            near = np.lib.stride_tricks.sliding_window_view(gram, grams)[at].argmin(axis=1) + at
        else:
            near = at
        new = np.ones(total, bool)
        new[1:] = (near[1:] != near[:-1]) | (row[1:] != row[:-1])
        start = np.flatnonzero(new)
        self.first, self.row = at[start], row[start]
        self.count = np.diff(np.append(start, total))
        self.anchor = gram[near[start]].astype(np.int64) if total else at
        self.inset = near[start] - at[start]

    def contents(self, words: Words, length: int) -> np.ndarray:
        """Hashes of the word sequences of the runs, with the anchor's place in them."""
        power, inverse = powers(len(words.hashes) + 1)
        sums = np.zeros(len(words.hashes) + 1, np.uint64)
        np.cumsum(words.hashes * power[:-1], out=sums[1:])
        end = self.first + self.count + length - 1
        raw = mix((sums[end] - sums[self.first]) * inverse[self.first])
        return mix(raw + (self.inset * 64 + self.count).astype(np.uint64)).astype(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """The key of a document: its id, null before all others, and the hash of its text, which is
    left at 0 where no id is there twice."""
    out = docs.withColumn("d", F.coalesce("doc_id", F.lit(-(1 << 63))))
    if out.groupBy("d").count().where("count > 1").isEmpty():
        return out.withColumn("h", F.lit(0).cast("long"))
    return out.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """``d, h, anchors``: the anchors of each document, twice if it has them more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in text_slices(texts):
                found = Stretches(Words(texts.slice(a, b - a)), length)
                order = np.lexsort((found.anchor, found.row))
                row, anchor = found.row[order], found.anchor[order]
                third = np.zeros(len(row), bool)
                third[2:] = (row[2:] == row[:-2]) & (anchor[2:] == anchor[:-2])
                row, anchor = row[~third], anchor[~third]
                ends = np.searchsorted(row, np.arange(b - a + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(anchor))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], ["d", "h", "anchors"]
                )

    rows = docs.select("d", "h", "text").mapInArrow(run, "d long, h long, anchors array<long>")
    return rows.where(F.size("anchors") > 0)


def matched(rows: np.ndarray, names: np.ndarray, lists: pa.Array, base: int) -> np.ndarray:
    """Whether each pair (row of a slice, number) is in the list of that row."""
    sizes = np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(lists)), sizes) - base
    values = lists.flatten().to_numpy(zero_copy_only=False)
    known = np.sort(mix(values.astype(np.int64).view(np.uint64) ^ mix(owner.astype(np.int64).view(np.uint64))))
    asked = mix(names.view(np.uint64) ^ mix(rows.astype(np.int64).view(np.uint64)))
    if not len(known):
        return np.zeros(len(rows), bool)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return known[at] == asked


def list_column(batch: pa.RecordBatch, i: int, kind: pa.DataType) -> pa.Array:
    column = batch.column(i)
    empty = pa.array([[]], pa.list_(kind))
    return pa.concat_arrays([column.cast(pa.list_(kind)).fill_null(empty[0])]) if len(column) else column


STRETCH = "anchor long, content long, d long, h long, start int, words string"


def repeated_stretches(marked: DataFrame, length: int) -> DataFrame:
    """The stretches around the repeated anchors of each document (d, h, text, anchors); equal
    ones of a slice of documents come once, from the first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in STRETCH.split(", ")]
        for batch in batches:
            texts = texts_of(batch)
            d, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(batch.schema.get_field_index("anchors"))
            for a, b in text_slices(texts):
                words = Words(texts.slice(a, b - a))
                found = Stretches(words, length)
                hit = np.flatnonzero(matched(found.row, found.anchor, lists.slice(a, b - a), 0))
                content = found.contents(words, length)[hit]
                start = found.first[hit] - words.doc_ends[found.row[hit]]
                row = found.row[hit] + a
                order = np.lexsort((start, h[row], d[row], content, found.anchor[hit]))
                same = np.zeros(len(order), bool)
                same[1:] = (content[order][1:] == content[order][:-1]) & (
                    found.anchor[hit][order][1:] == found.anchor[hit][order][:-1]
                )
                pick = order[~same]
                run_ = hit[pick]
                low = words.starts[found.first[run_]]
                high = words.ends[found.first[run_] + found.count[run_] + length - 2]
                raw = words.raw.tobytes()
                pieces = [raw[x:y] for x, y in zip(low.tolist(), high.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.anchor[run_]),
                        pa.array(content[pick]),
                        pa.array(d[row[pick]]),
                        pa.array(h[row[pick]]),
                        pa.array(start[pick], pa.int32()),
                        pa.array(pieces, pa.binary()).cast(pa.string()),
                    ],
                    names,
                )

    return marked.select("d", "h", "anchors", "text").mapInArrow(run, STRETCH)


WINDOWS = "shard long, value long, d long, h long, start int, words string"


def pieces(stretches: DataFrame, length: int) -> DataFrame:
    """The stretches with the key of their shard; those of an anchor with very many stretches are
    cut into their windows, dealt by what the windows hold. Equal windows are one, with the first
    place, before they are dealt: copies may be any share of all documents."""
    often = stretches.groupBy("anchor").agg(F.count("*").alias("n"))
    split = often.where(F.col("n") > ANCHOR_ROWS).select(
        "anchor", F.ceil(F.col("n") / ANCHOR_ROWS).cast("int").alias("parts")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in WINDOWS.split(", ")]
        for cut in batches:
            texts = texts_of(cut, "words")
            anchor, parts = cut.column(0).to_numpy(), cut.column(1).to_numpy()
            for a, b in text_slices(texts):
                words = Words(texts.slice(a, b - a))
                windows = np.diff(words.doc_ends) - length + 1
                row = np.repeat(np.arange(b - a), windows)
                offset = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
                at = words.doc_ends[row] + offset
                value = np.zeros(len(row), np.uint64)
                for k in range(length):
                    value = mix(value * np.uint64(31) + words.hashes[at + k])
                part = (value % parts[a + row].astype(np.uint64)).astype(np.uint64)
                shard = mix(anchor[a + row].view(np.uint64) + mix(part + np.uint64(1))).astype(np.int64)
                low, high = words.starts[at], words.ends[at + length - 1]
                raw = words.raw.tobytes()
                # blanks in place of other white space, so that equal windows are equal texts
                text = [b" ".join(raw[x:y].split()) for x, y in zip(low.tolist(), high.tolist(), strict=True)]
                pick = pa.array(a + row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard),
                        pa.array(value.view(np.int64)),
                        cut.column(2).take(pick),
                        cut.column(3).take(pick),
                        pa.array(cut.column(4).to_numpy()[a + row] + offset, pa.int32()),
                        pa.array(text, pa.binary()).cast(pa.string()),
                    ],
                    names,
                )

    rows = stretches.join(written(split), "anchor", "left")  # few rows: stretches stay where they are
    whole = rows.where("parts is null").select(F.col("anchor").alias("shard"), "d", "h", "start", "words")
    cut = rows.where("parts is not null").select("anchor", "parts", "d", "h", "start", "words")
    first = F.min(F.struct("d", "h", "start")).alias("first")
    single = cut.mapInArrow(run, WINDOWS).groupBy("shard", "value", "words").agg(first)
    return whole.unionByName(single.select("shard", "first.*", "words"))


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(len(bits) // 64 * 64 + 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones are before each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class Wavelet:
    """A wavelet matrix: for each bit of the symbols, from the top, a bit vector with ranks."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.levels = []
        for bit in range(depth - 1, -1, -1):
            ones = (symbols >> bit) & 1
            self.levels.append((bit, Bits(ones)))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def range(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """The range of a symbol's occurrences within [low, high) in the last level's order."""
        for bit, bits in self.levels:
            a, b = bits.ones(low), bits.ones(high)
            one = ((symbol >> bit) & 1).astype(bool)
            low = np.where(one, bits.zeros + a, low - a)
            high = np.where(one, bits.zeros + b, high - b)
        return low, high


class Index:
    """An FM-index over word symbols, ordered by their next ``length`` symbols.

    Backward search over such an order is exact for patterns of up to ``length`` symbols.
    """

    def __init__(self, symbols: np.ndarray, length: int):
        n = len(symbols)
        self.depth = max(1, int(symbols.max(initial=0)).bit_length())
        ranks, size, have = symbols.astype(np.int64), 1, {1: symbols.astype(np.int64)}
        while 2 * size <= length - 1:
            ranks = self._joined(ranks, ranks, size)
            size *= 2
            have[size] = ranks
        for step in sorted(have, reverse=True):  # on to length - 1 symbols
            while size + step <= length - 1:
                ranks = self._joined(ranks, have[step], size)
                size += step
        full = self._joined(ranks, have[1], size)
        self.order = np.argsort(full, kind="stable")
        # rows that agree in length - 1, and in length symbols, are next to each other
        self.near_low, self.near_high, _ = self._groups(ranks[self.order])
        self.low, self.high, group = self._groups(full[self.order])
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        self.earliest = np.minimum.reduceat(self.order, first)[group]
        last = symbols[self.order - 1]
        self.wavelet = Wavelet(last, self.depth)
        counts = np.bincount(symbols, minlength=1 << self.depth)
        self.begins = np.cumsum(counts) - counts
        # where a symbol's occurrences begin in the order of the wavelet's last level
        values = np.arange(1 << self.depth)
        self.base, _ = self.wavelet.range(values, np.zeros(len(values), np.int64), np.zeros(len(values), np.int64))
        self.n = n

    @staticmethod
    def _joined(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
        """Ranks by ``left`` here and ``right`` shift symbols on; beyond the end comes first."""
        beyond = np.zeros(len(left), np.int64)
        beyond[: max(len(left) - shift, 0)] = right[shift:] + 1
        return np.unique(left * (len(left) + int(right.max(initial=0)) + 2) + beyond, return_inverse=True)[1]

    @staticmethod
    def _groups(ranks: np.ndarray):
        new = np.append(True, ranks[1:] != ranks[:-1])
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        after = np.append(first[1:], len(ranks))
        return first[group], after[group], group

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """The rows that start with the symbol and go on with what the rows [low, high) have."""
        a, b = self.wavelet.range(symbol, low, high)
        return self.begins[symbol] + a - self.base[symbol], self.begins[symbol] + b - self.base[symbol]


def first_places(symbols: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """For each place of each sequence (symbols up to ``ends``, each closed by a 0) at which a
    window starts, the first place at which the same window starts; -1 elsewhere.

    All sequences are streamed at once, from right to left: the matched rows are kept at one
    word less than a window, each word extends them to a window and they are widened again.
    """
    out = np.full(len(symbols), -1, np.int64)
    begins = np.append(0, ends[:-1] + 1)
    live = np.flatnonzero(ends - begins >= length)
    if not len(live):
        return out
    index = Index(symbols, length)
    at = ends[live]
    low, high = np.zeros(len(live), np.int64), np.full(len(live), index.n)
    for _ in range(length - 1):
        at = at - 1
        low, high = index.extend(symbols[at], low, high)
    left = begins[live]
    while len(at):
        at = at - 1
        low, high = index.extend(symbols[at], low, high)
        out[at] = index.earliest[low]
        low, high = index.near_low[low], index.near_high[low]
        more = at > left
        at, left, low, high = at[more], left[more], low[more], high[more]
    return out


KEPT = "d long, h long, kept array<int>"


def first_windows(cut: DataFrame, length: int, shards: int) -> DataFrame:
    """``d, h, kept``: the windows (their first words) that start nowhere earlier."""

    def search(rows: pa.Table) -> pa.Table:
        d, h = rows["d"].to_numpy(), rows["h"].to_numpy()
        start = rows["start"].to_numpy()
        order = np.lexsort((start, h, d))
        texts = rows["words"].combine_chunks().take(pa.array(order))
        words = Words(texts if len(texts) else pa.array([], pa.string()))
        sizes = np.diff(words.doc_ends)
        ends = np.cumsum(sizes + 1) - 1
        symbols = np.zeros(int(len(words.hashes) + len(sizes)), np.int64)
        inside = np.ones(len(symbols), bool)
        inside[ends] = False
        symbols[inside] = np.unique(words.hashes, return_inverse=True)[1] + 1
        place = first_places(symbols, ends, length)
        own = np.flatnonzero(place == np.arange(len(symbols)))
        piece = np.searchsorted(ends, own)
        offset = own - (ends - sizes)[piece]
        source = order[piece]
        lists = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(piece, np.arange(len(order) + 1)), pa.int32()),
            pa.array(start[source] + offset, pa.int32()),
        )
        return pa.table([pa.array(d[order]), pa.array(h[order]), lists], names=["d", "h", "kept"])

    unit = F.pmod("shard", F.lit(shards)).alias("unit")
    dealt = cut.select(unit, "d", "h", "start", "words").groupBy("unit").applyInArrow(search, KEPT)
    return dealt.where(F.size("kept") > 0).groupBy("d", "h").agg(F.flatten(F.collect_list("kept")).alias("kept"))


def marks(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """``d, h, anchors, kept`` of each document with a repeated anchor, as a written table: its
    repeated anchors, and those windows around them that are the first of their kind."""
    own = written(anchors(docs, length))
    single = own.select("d", "h", F.explode("anchors").alias("anchor"))
    # rows of one document that come twice are one document
    twice = single.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    twice = written(twice)
    lists = written(
        single.join(twice, "anchor", "left_semi")
        .groupBy("d", "h")
        .agg(F.collect_set("anchor").alias("anchors"))
    )
    discard(own, twice)
    marked = docs.select("d", "h", "text").join(lists, ["d", "h"])
    # written before they are grouped, so that the moved texts need not be kept meanwhile
    found = written(repeated_stretches(marked, length))
    single = found.groupBy("anchor", "content").agg(
        F.min(F.struct("d", "h", "start", "words")).alias("first")
    )
    stretches = written(single.select("anchor", "first.*"))
    discard(found)
    cut = written(pieces(stretches, length))
    discard(stretches)
    shards = max(1, math.ceil(cut.count() / SHARD_ROWS))
    out = written(lists.join(first_windows(cut, length, shards), ["d", "h"], "left"))
    discard(lists, cut)
    return out


def covered(words: Words, lists: pa.Array, kept: pa.Array, length: int) -> np.ndarray:
    """Whether each word of a slice of texts lies in a window that started before."""
    found = Stretches(words, length)
    hit = matched(found.row, found.anchor, lists, 0)
    count = found.count[hit]
    window = np.repeat(found.first[hit] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    row = np.repeat(found.row[hit], count)
    sizes = np.diff(kept.offsets.to_numpy())
    own = kept.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    own = own + np.repeat(words.doc_ends[:-1], sizes)
    repeated = window[~np.isin(window, own)] if len(row) else window
    change = np.bincount(repeated, minlength=len(words.hashes) + 1)
    change -= np.bincount(repeated + length, minlength=len(words.hashes) + 1)[: len(change)]
    return np.cumsum(change)[: len(words.hashes)] > 0


def kept_texts(batch: pa.RecordBatch, length: int, texts: pa.Array):
    """For slices (first row, end) of a batch: words, removed words and the kept text of each row."""
    lists = list_column(batch, batch.schema.get_field_index("anchors"), pa.int64())
    kept = list_column(batch, batch.schema.get_field_index("kept"), pa.int32())
    for a, b in text_slices(texts):
        words = Words(texts.slice(a, b - a))
        gone = covered(words, lists.slice(a, b - a), kept.slice(a, b - a), length)
        raw = words.raw.tobytes()
        n, removed, left = [], [], []
        for row in range(b - a):
            part = words.of(row)
            out = gone[part]
            n.append(part.stop - part.start)
            removed.append(int(out.sum()))
            stay = np.flatnonzero(~out) + part.start
            spans = zip(words.starts[stay].tolist(), words.ends[stay].tolist(), strict=True)
            left.append(b" ".join([raw[x:y] for x, y in spans]))
        yield a, b, n, removed, left


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def dedup_digest(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of ``docs``.

    Words are between ASCII white space. A word goes if a window over it also starts earlier, in
    a document with a smaller doc_id (null first; of equal ids the smaller text hash) or earlier
    in its own. Wholly equal rows count as one document and are all returned. Null texts have no
    words; other columns are ignored; an empty table gives no rows.
    """
    import hashlib

    rows = keyed(docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in DIGEST.split(", ")]
        for batch in batches:
            for a, b, n, removed, left in kept_texts(batch, length, texts_of(batch)):
                digests = [hashlib.sha256(x).hexdigest() for x in left]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(n, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(digests, pa.string()),
                    ],
                    names,
                )

    marked = rows.join(marks(rows, length), ["d", "h"], "left")
    return marked.select("doc_id", "text", "anchors", "kept").mapInArrow(run, DIGEST)


def remove_repeats(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """``docs``, all columns, with repeated windows cut out of ``text`` (the rest joined by single
    blanks); texts without any stay as they are, and ``n_chars`` follows if it is there."""
    names = docs.columns
    rows = keyed(docs.select(whole_row(docs), "doc_id", "text"))
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            for a, b, _, removed, left in kept_texts(batch, length, columns[at].fill_null("")):
                own = [c.slice(a, b - a) for c in columns]
                pairs = zip(own[at].to_pylist(), removed, left, strict=True)
                after = [x.decode() if gone else old for old, gone, x in pairs]
                if count is not None:
                    old = own[count].to_pylist()
                    new = [len(t) if gone else o for t, gone, o in zip(after, removed, old, strict=True)]
                    own[count] = pa.array(new, own[count].type)
                own[at] = pa.array(after, pa.string())
                yield pa.RecordBatch.from_arrays(own, names)

    marked = rows.join(marks(rows, length), ["d", "h"], "left")
    return marked.select("row", "anchors", "kept").mapInArrow(run, docs.schema)
