"""Best-fit packing of token pieces by exact-complement hashing.

Lengths are bounded by the sequence length, so the pieces are packed by their counts per length:
the plan looks up which single length, pair or triple of lengths fills a gap exactly and uses it
as often as all of its lengths are there; what no combination fills goes best-fit. The plan has
a bounded number of patterns, each for many sequences. Rows get their place by their rank among
the rows of the same length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.bpe import TOGETHER, encoder
from shelfwise.llm.common import gathered, texts_of, written

CAPACITY = 2048
#: Rows numbered together in one task.
UNIT_ROWS = 200_000


class Lengths:
    """How many pieces of each length are left, with an index of the sums they can make."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = [0] * (capacity + 1)
        for length, n in counts.items():
            self.left[length] = n
        self.capacity = capacity
        self.here = sum(1 << x for x, n in enumerate(self.left) if n)  # bit x: length x is left
        self.mirror = sum(1 << capacity - x for x, n in enumerate(self.left) if n)

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            self.here ^= 1 << length
            self.mirror ^= 1 << self.capacity - length

    def longest(self, most: int) -> int:
        """The longest length left that is no longer than ``most``; 0 if there is none."""
        return max((self.here & ((1 << most + 1) - 1)).bit_length() - 1, 0)

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """Two lengths left, none above ``most``, that add up to ``total``; the longest first."""
        # bit x: length x and its complement are both left
        both = self.here & (self.mirror >> self.capacity - total) & ((1 << min(most, total - 1) + 1) - 1)
        while both:
            a = both.bit_length() - 1
            b = total - a
            if b > a:
                return None
            if b > 0 and (a != b or self.left[a] > 1):
                return a, b
            both ^= 1 << a
        return None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        a = self.longest(total - 2)
        while a:
            rest = self.pair(total - a, a)
            if rest and self.there((a, *rest)):
                return a, *rest
            a = self.longest(a - 1) if 3 * (a - 1) >= total else 0
        return None

    def there(self, lengths: tuple[int, ...]) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in set(lengths))

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths left that fill the gap exactly."""
        if self.left[gap]:
            return (gap,)
        return self.pair(gap, gap) or self.triple(gap)


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a sequence, number of sequences) that use every piece once."""
    left = Lengths({k: n for k, n in counts.items() if n}, capacity)
    out: list[tuple[list[int], int]] = []
    while left.here:
        top = left.longest(capacity)
        gap = capacity - top
        if not gap:
            out.append(([top], left.left[top]))
            left.take(top, left.left[top])
            continue
        left.take(top, 1)  # the combination must not use the last piece of this length itself
        fill = left.exact(gap)
        left.left[top] += 1
        if left.left[top] == 1:
            left.here ^= 1 << top
            left.mirror ^= 1 << capacity - top
        if fill:
            lengths = (top, *fill)
            n = min(left.left[x] // lengths.count(x) for x in set(lengths))
            out.append((list(lengths), n))
            for x in lengths:
                left.take(x, n)
            continue
        # no exact fill: best fit, here the longest that goes in, until nothing does
        lengths = [top]
        while True:
            left.take(lengths[-1], 1)
            nxt = left.longest(gap)
            if not nxt:
                break
            fill = left.exact(gap) if len(lengths) > 1 else None
            if fill:
                lengths += fill
                for x in fill:
                    left.take(x, 1)
                gap = 0
                break
            lengths.append(nxt)
            gap -= nxt
        rest = {x: lengths.count(x) for x in set(lengths)}
        more = min(left.left[x] // k for x, k in rest.items())
        for x, k in rest.items():
            if more:
                left.take(x, k * more)
        out.append((lengths, 1 + more))
    return out


def place_rows(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, pieces a sequence, offset) of each part.

    A pattern that has a length k times takes k pieces for each of its sequences in turn.
    """
    used: dict[int, int] = {}
    sequence = 0
    out = []
    for lengths, n in patterns:
        offset = 0
        for x in sorted(set(lengths), reverse=True):
            k = lengths.count(x)
            first = used.get(x, 0)
            out.append((x, first + 1, first + k * n, sequence, k, offset))
            used[x] = first + k * n
            offset += x * k
        sequence += n
    return out


def pack(pieces: DataFrame, keys: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` (any numbers) and ``offset`` (gapless from 0 in each).

    ``pieces`` is a written table with a ``length`` of 1 to ``capacity`` in every row; ``keys``
    order the rows of one length. A length may hold any share of the rows: its rows are numbered
    in units whose number follows the table's size, and one row for each length and unit is
    added up. Only the counts per length reach the driver.
    """
    total = pieces.count()
    units = max(1, math.ceil(total / UNIT_ROWS))
    unit = F.pmod(F.xxhash64(*keys), F.lit(units)).cast("int")
    rows = pieces.withColumn("_unit", unit)
    counted = rows.groupBy("length", "_unit").agg(F.count("*").alias("_n"))
    own = Window.partitionBy("length").orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select(
        "length", "_unit", F.coalesce(F.sum("_n").over(own), F.lit(0)).alias("_before")
    )
    sums = {r[0]: r[1] for r in counted.groupBy("length").agg(F.sum("_n")).collect()}
    parts = pieces.sparkSession.createDataFrame(
        place_rows(plan_patterns(sums, capacity)),
        "length bigint, _lo bigint, _hi bigint, _first bigint, _each bigint, _offset bigint",
    )
    numbered = rows.withColumn(
        "_own", F.row_number().over(Window.partitionBy("length", "_unit").orderBy(*keys))
    )
    ranked = numbered.join(before, ["length", "_unit"]).withColumn(
        "_rank", F.col("_own") + F.col("_before")
    )
    # One row for each length of a pattern; patterns are bounded by the lengths, not the data.
    found = ranked.join(F.broadcast(parts), "length").where(
        F.col("_rank").between(F.col("_lo"), F.col("_hi"))
    )
    at = F.col("_rank") - F.col("_lo")
    return found.select(
        *pieces.columns,
        (F.col("_first") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(at, F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The token pieces of every whole text, an end token (id 0) after each document.

    ``path`` is the tokenizer's JSON file. A null or empty text is its end token alone. Only a
    longer document is cut, the first piece is the one that may be shorter.
    """
    schema = PIECES + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in gathered(batches, TOGETHER):
            known = batch.column(0).to_pylist()
            for a, b, ids, ends in coder.encode(texts_of(batch)):
                out: list[tuple] = []
                kept: list[np.ndarray] = []
                for row in range(a, b):
                    own = np.append(ids[ends[row - a] : ends[row - a + 1]], 0).astype("<u4")
                    bounds = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                    for i, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        out.append((known[row], i, x, y - x, zlib.crc32(own[x:y].tobytes())))
                        if keep_ids:
                            kept.append(own[x:y].astype(np.int32))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                if keep_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """All pieces of all documents with their sequence and offset.

    Null ids stay null and repeated rows are packed each; other columns are ignored; an empty
    table gives no rows. With ``keep_ids`` the pieces carry their token ids.
    """
    pieces = written(cut_pieces(docs, path, capacity, keep_ids))
    return pack(pieces, ["doc_id", "piece", "start", "ids_crc32"], capacity)
