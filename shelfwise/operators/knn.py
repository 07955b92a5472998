"""Exact k nearest neighbours by cosine.

Rows are put into an order in which near ones stand together: sparse rows by their heaviest columns,
dense ones by the nearest of a bounded number of pivots. In that order a query first meets the rows
around it, which gives a k-th best similarity that it will reach. Then queries are dealt to a
bounded number of groups, and all rows stream past each group in blocks. Two bounds skip blocks that
cannot hold anything better: the largest value of each column, and the triangle inequality on
angles around the middle of a block. What is left is compared in single precision, and only rows
that may count are compared exactly. No pair of vectors is ever written out, and the rows are
shuffled once for each group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import cut
from .meet import groups_for, keep_best, lists, meet, padded, stretches
from .sampling import dense_index

CHUNK_ROWS = 2048
MAX_PIVOTS = 256
PLACES = 6

# Rows of a block that streams past the queries, and queries that one group holds at most.
BLOCK_ROWS = 512
GROUP_ROWS = 50_000

# Values that are gathered at once to compare candidates exactly.
MOST_VALUES = 4_000_000

# Heaviest columns that order a sparse row.
HEAVIEST = 6

# Larger than the rounding step of the similarities, so that rounding never prunes a tie; the second
# one also covers single precision.
SLACK = 2e-6
SLACK_SINGLE = 2e-5

# A key orders by similarity in steps, then by the number of the id.
_STEPS = 10**PLACES
_IDS = 1 << 40
_NONE = np.iinfo(np.int64).min

_FOUND = "id string, neighbor string, similarity double"
_ROW = "id string, num bigint, idx array<int>, val array<double>, sig array<int>"


def unit_vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, idx, val of unit length from a dense array column; a zero vector becomes empty."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    val = F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(
        F.array().cast("array<double>")
    )
    return df.select(
        F.col(id_col).cast("string").alias("id"),
        F.array().cast("array<int>").alias("idx"),
        val.alias("val"),
    )


class _Rows:
    """Vectors of a batch: row, column and value of each entry. A row without columns is dense."""

    def __init__(self, rows: pa.RecordBatch):
        self.n = rows.num_rows
        self.row, self.value = lists(rows.column("val"), np.float64)
        if len(rows.column("idx").flatten()) == len(self.row):
            self.col = lists(rows.column("idx"), np.int64)[1]
        else:
            # Dense rows, or both kinds: a dense entry's column is its place.
            idx = rows.column("idx")
            sizes = np.asarray(rows.column("val").value_lengths().fill_null(0))
            self.col = np.arange(len(self.row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            sparse = np.asarray(idx.value_lengths().fill_null(0)) > 0
            self.col[sparse[self.row]] = np.asarray(idx.flatten(), dtype=np.int64)
        self.columns = np.unique(self.col)

    def dense(self, columns: np.ndarray, dtype=np.float64) -> np.ndarray:
        """Rows as a dense matrix over the given columns; values elsewhere are left out."""
        out = np.zeros((self.n, len(columns)), dtype=dtype)
        if len(columns):
            at = np.minimum(np.searchsorted(columns, self.col), len(columns) - 1)
            ok = columns[at] == self.col
            out[self.row[ok], at[ok]] = self.value[ok]
        return out


def _place(pivots: _Rows):
    """Sets the order of dense rows: the number of the pivot at the smallest angle."""
    matrix = pivots.dense(pivots.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            cells = [
                (_Rows(rows.slice(s, CHUNK_ROWS)).dense(pivots.columns) @ matrix.T).argmax(axis=1)
                for s in range(0, rows.num_rows, CHUNK_ROWS)
            ]
            cells = np.concatenate([np.empty(0, dtype=np.int64), *cells]).astype(np.int32)
            sig = pa.ListArray.from_arrays(pa.array(np.arange(rows.num_rows + 1, dtype=np.int32)), pa.array(cells))
            yield rows.set_column(rows.schema.get_field_index("sig"), "sig", sig)

    return run


def _first_bound(k: int, chunk: int):
    """Deals queries to the group of their range, with the k-th best similarity among the rows of
    the same chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, chunk):
                rows = batch.slice(start, chunk)
                data = np.asarray(rows.column("data"))
                asked = np.flatnonzero(np.asarray(rows.column("query")))
                tau = np.full(len(asked), -2.0)
                if len(asked) and data.sum() >= k:
                    vectors = _Rows(rows)
                    matrix = vectors.dense(vectors.columns)
                    sims = matrix[asked] @ matrix[data].T
                    tau = np.partition(sims, sims.shape[1] - k, axis=1)[:, -k]
                kept = rows.take(pa.array(asked))
                columns = [kept.column(c) for c in ("lo", "id", "num", "idx", "val", "sig")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(tau)], names=["lo", "id", "num", "idx", "val", "sig", "tau"]
                )

    return run


class _Block(_Rows):
    """Rows that stream past: their matrix, its largest values, and for dense rows the mean direction
    and the largest angle to it."""

    def __init__(self, rows: pa.RecordBatch, sparse: bool):
        super().__init__(rows)
        self.matrix = self.dense(self.columns)
        self.high = self.matrix.max(axis=0, initial=0)
        self.positive = not (self.value < 0).any()
        self.middle = None if sparse else self._middle()

    def _middle(self) -> tuple[np.ndarray, float] | None:
        center = self.matrix.sum(axis=0)
        norm = np.sqrt(center @ center)
        if not norm > 0:
            return None
        center = center / norm
        return center, np.arccos(np.clip(self.matrix @ center, -1.0, 1.0)).max()


class _Part:
    """Queries that meet the blocks together."""

    def __init__(self, rows: pa.RecordBatch, first: int, k: int, sparse: bool):
        self.first = first
        self.vectors = _Rows(rows)
        matrix = self.vectors.dense(self.vectors.columns)
        self.high, self.low = matrix.max(axis=0, initial=0), matrix.min(axis=0, initial=0)
        self.matrix = None if sparse else matrix
        self.floor = np.array(rows.column("tau"))
        self.key = np.full((rows.num_rows, k), _NONE)

    def see(self, block: _Block, numbers: np.ndarray) -> None:
        # Columns that both sides have, by their places in each.
        common, mine, theirs = np.intersect1d(
            self.vectors.columns, block.columns, assume_unique=True, return_indices=True
        )
        asked = self.vectors.dense(common) if self.matrix is None else self.matrix[:, mine]
        if block.positive and not (self.low < 0).any():
            bound = asked @ block.high[theirs]
        else:
            bound = np.full(len(self.key), np.inf)
        if block.middle is not None:
            center, radius = block.middle
            angle = np.arccos(np.clip(asked @ center[theirs], -1.0, 1.0))
            bound = np.minimum(bound, np.cos(np.maximum(angle - radius, 0.0)))
        rows = np.flatnonzero(bound >= self.floor - SLACK)
        if not len(rows):
            return
        data = block.matrix[:, theirs]
        sims = asked[rows].astype(np.float32) @ data.T.astype(np.float32)
        near = sims >= (self.floor[rows] - SLACK_SINGLE).astype(np.float32)[:, None]
        some = near.any(axis=1)
        if not some.any():
            return
        rows, near = rows[some], near[some]
        # Lines of few candidates apart from those of many, which would widen all.
        few = near.sum(axis=1) <= 64
        for part in (few, ~few):
            places = np.flatnonzero(part)
            for start in range(0, len(places), 256):
                at = places[start : start + 256]
                self._merge(rows[at], near[at], asked[rows[at]], data, numbers)

    def _merge(self, rows, near, asked, data, numbers) -> None:
        cols, filled = padded(near)
        if cols.shape[1] * 4 > len(data) or cols.size * data.shape[1] > MOST_VALUES:
            exact = np.take_along_axis(asked @ data.T, cols, 1)
        else:
            exact = np.einsum("rc,rnc->rn", asked, data[cols])
        keys = np.rint(exact * _STEPS).astype(np.int64) * _IDS + (_IDS - 1 - numbers[cols])
        keep_best(self.key, rows, np.where(filled, keys, _NONE), [])
        worst = self.key[rows].min(axis=1)
        reached = np.where(worst > _NONE, (worst // _IDS) / _STEPS, -2.0)
        self.floor[rows] = np.maximum(self.floor[rows], reached)


class _Group:
    """The parts of one group, and the largest value of each column in each of them."""

    def __init__(self, waiting: list[pa.RecordBatch], k: int, step: int, sparse: bool):
        table = pa.Table.from_batches(waiting).combine_chunks()
        self.ids = table.column("id").combine_chunks()
        self.parts = [
            _Part(table.slice(s, step).combine_chunks().to_batches()[0], s, k, sparse)
            for s in range(0, table.num_rows, step)
        ]
        self.columns = np.unique(np.concatenate([p.vectors.columns for p in self.parts]))
        self.high = np.zeros((len(self.parts), len(self.columns)))
        for high, p in zip(self.high, self.parts, strict=True):
            high[np.searchsorted(self.columns, p.vectors.columns)] = p.high
        self.positive = not any((p.low < 0).any() for p in self.parts)
        self.floor = np.array([p.floor.min() for p in self.parts])

    def see(self, block: _Block, numbers: np.ndarray) -> None:
        near = range(len(self.parts))
        if self.positive and block.positive:
            _, mine, theirs = np.intersect1d(self.columns, block.columns, assume_unique=True, return_indices=True)
            near = np.flatnonzero(self.high[:, mine] @ block.high[theirs] >= self.floor - SLACK)
        for i in near:
            self.parts[i].see(block, numbers)
            self.floor[i] = self.parts[i].floor.min()

    def found(self) -> Iterator[pa.RecordBatch]:
        for part in self.parts:
            row, col = np.nonzero(part.key > _NONE)
            key = part.key[row, col]
            yield pa.RecordBatch.from_arrays(
                [self.ids.take(pa.array(part.first + row)), pa.array(_IDS - 1 - key % _IDS),
                 pa.array(key // _IDS / _STEPS + 0.0)],
                names=["id", "num", "similarity"],
            )


def _nearest(k: int, chunk: int, sparse: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, waiting, group = None, [], None
        step = min(chunk, BLOCK_ROWS) if sparse else chunk
        for now, side, rows in stretches(batches):
            if now != lo:
                if group:
                    yield from group.found()
                lo, waiting, group = now, [], None
            if side == 0:
                waiting.append(rows)
                continue
            if not waiting:
                continue
            group = group or _Group(waiting, k, step, sparse)
            for start in range(0, rows.num_rows, step):
                piece = rows.slice(start, step)
                group.see(_Block(piece, sparse), np.asarray(piece.column("num"), dtype=np.int64))
        if group:
            yield from group.found()

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbor")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _heaviest() -> Column:
    """The columns of the largest values, largest first."""
    entries = F.arrays_zip(F.transform("val", lambda x: -x).alias("v"), F.col("idx").alias("i"))
    return F.slice(F.transform(F.array_sort(entries), lambda x: x["i"]), 1, HEAVIEST)


def knn_join(queries: DataFrame, data: DataFrame, k: int, chunk: int = CHUNK_ROWS) -> DataFrame:
    """id, neighbor, similarity, rank: the k nearest of ``data`` for each query, ties by id.

    Both tables hold id, idx, val with unit or empty vectors; an empty idx means a dense vector.
    Similarities are rounded before ranking.
    """
    spark = data.sparkSession
    same = queries is data
    data = cut(data.select("id", "idx", "val"))
    facts = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("idx")).alias("width")).first()
    n, sparse = facts["n"], (facts["width"] or 0) > 0
    if n == 0:
        return spark.createDataFrame([], _FOUND + ", rank int")
    ids = cut(dense_index(data, "id", "num"))
    none = F.array().cast("array<int>")
    sig = _heaviest() if sparse else none

    def shaped(df: DataFrame) -> DataFrame:
        df = df.select("id", "num", "idx", "val", sig.alias("sig"))
        return df if sparse else df.mapInArrow(_place(pivots), _ROW)

    if not sparse:
        few = min(MAX_PIVOTS, -(-n // chunk))
        sample = data.orderBy(F.xxhash64("id"), "id").limit(few).select("idx", "val")
        pivots = _Rows(sample.toArrow().combine_chunks().to_batches()[0])
    known = ids.withColumnRenamed("id", "known")
    data = cut(shaped(data.join(known, F.col("id").eqNullSafe(F.col("known")))))
    if same:
        asked, m = data, n
        every = data.withColumns({"query": F.lit(True), "data": F.lit(True)})
    else:
        asked = cut(shaped(queries.select("id", "idx", "val").withColumn("num", F.lit(0).cast("bigint"))))
        m = asked.count()
        every = asked.withColumns({"query": F.lit(True), "data": F.lit(False)}).unionByName(
            data.withColumns({"query": F.lit(False), "data": F.lit(True)})
        )
    groups = groups_for(-(-m // chunk), m, GROUP_ROWS)
    # Rows of one range stand together, so its queries skip the same blocks.
    ranges = every.repartitionByRange(groups, "sig", "id").withColumn("lo", F.spark_partition_id())
    asked = cut(
        ranges.sortWithinPartitions("sig", "id").mapInArrow(_first_bound(k, chunk), f"lo int, {_ROW}, tau double")
    )
    rows = data.withColumn("tau", F.lit(0.0))
    found = meet(asked, rows, groups, ["sig", "num"], _nearest(k, chunk, sparse), "id string, num bigint, similarity double")
    named = found.join(ids.select("num", F.col("id").alias("neighbor")), "num")
    return _best(named.select("id", "neighbor", "similarity"), k)
