"""Approximate nearest neighbours on several shifted Hilbert curves.

Each curve orders all vectors by the Hilbert key of a projection of its own; vectors that are near
in the projection lie near on the curve. The ordering is cut into ranges of equal size; a
query is compared with its own range and the ranges next to it, on every curve, and the best of
all curves are merged. How many neighbouring ranges are needed is found from a bounded sample
of queries whose true neighbours are known, so the recall holds at every size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import written

CURVES = 8
DIMS, BITS = 6, 10
#: Rows in a range, and the most ranges of a curve.
RANGE_ROWS, MOST_RANGES = 2000, 1 << 14
#: Queries whose true neighbours are found for the calibration, and vectors whose projections
#: give each curve its scale and its cuts (per range, and at most).
PROBES = 60
SAMPLE_PER_RANGE, MOST_SAMPLE = 20, 50_000
RECALL = 0.95


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The position on the Hilbert curve of integer points (rows) with ``bits`` per dimension."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(dims):
            flip = (x[i] & q) > 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    q = top
    while q > 1:
        carry = np.where(x[dims - 1] & q, carry ^ (q - 1), carry)
        q >>= 1
    x ^= carry
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


class Curves:
    """Projections, shifts and scale of all curves for vectors of one length."""

    def __init__(self, length: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.projections = []
        free = np.zeros((length, 0))
        for _ in range(CURVES):
            if free.shape[1] < min(DIMS, length):  # the curves share out a rotation of the space
                free = np.linalg.qr(rng.standard_normal((length, length)))[0]
            self.projections.append(free[:, :DIMS])
            free = free[:, DIMS:]
        self.shift = rng.uniform(0, 0.25, (CURVES, DIMS))
        self.spread = np.ones(CURVES)

    def fit(self, sample: np.ndarray) -> None:
        """Scale each curve to the spread of a sample of unit vectors."""
        for c, p in enumerate(self.projections):
            self.spread[c] = max(float(np.abs(sample @ p).max(initial=0)), 1e-9) * 1.3

    def keys(self, units: np.ndarray, curve: int) -> np.ndarray:
        p = self.projections[curve]
        place = (units @ p / self.spread[curve] + 1) / 2 + self.shift[curve][: p.shape[1]] - 0.125
        cells = np.clip(place * (1 << BITS), 0, (1 << BITS) - 1)
        return hilbert_keys(cells.astype(np.int64))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    big = np.abs(vectors).max(axis=1, keepdims=True, initial=0)
    scaled = vectors / np.where(big > 0, big, 1)  # squares must neither overflow nor vanish
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def as_matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def valid(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a non-zero vector of finite numbers of the commonest length."""
    rows = vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null")
    limit = F.lit(float("inf"))
    fine = F.forall(
        "embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) < limit), F.lit(False))
    )
    return rows.where(fine & F.exists("embedding", lambda v: v != 0))


def best(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, names: np.ndarray, k: int):
    """The k best candidates of each query, ties to smaller ids, without the query itself."""
    score = queries @ vectors.T
    score[ids[:, None] == names[None, :]] = -np.inf
    n = min(k, score.shape[1])
    if not n:
        return
    floor = np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n]
    for row in range(len(ids)):
        # rounding differs between products of different shapes, so near ties are kept as well
        at = np.flatnonzero((score[row] >= floor[row] - 1e-9) & (score[row] > -np.inf))
        order = np.lexsort((names[at], -score[row, at]))
        yield row, at[order]


def exact_score(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine in double precision, added up exactly so that no order of terms matters."""
    top = math.fsum((a * b).tolist())
    return max(-1.0, min(1.0, top / math.sqrt(math.fsum((a * a).tolist()) * math.fsum((b * b).tolist()))))


FOUND = "query_id long, vec_id long, score double"


def compare_block(ids, rows, names, candidates, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, exact score) of the best candidates of each query in one block."""
    out = []
    if len(ids) and len(names):
        units, near = unit_rows(rows), unit_rows(candidates)
        for row, at in best(units, ids, near, names, k):
            for j in at:
                out.append((int(ids[row]), int(names[j]), exact_score(rows[row], candidates[j])))
    return out


def top(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best distinct candidates."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    single = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def true_neighbours(vectors: DataFrame, probes: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The exact neighbours of a bounded number of queries: every task keeps its best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy()
            found = compare_block(ids, probes, names, as_matrix(batch.column(1)), k)
            cols = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)],
                ["query_id", "vec_id", "score"],
            )

    found = vectors.select("vec_id", "embedding").mapInArrow(run, FOUND)
    return top(found, k).select("query_id", "vec_id").toPandas()


def nearest(
    vectors: DataFrame, every: int = 50, k: int = 5, recall: float = RECALL, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of each row whose id ``every`` divides.

    Null or zero vectors, and those with a null or non-finite component, take no part, nor do
    vectors of another length than most. Equal vectors are compared once: the k + 1 smallest ids
    of each are all that ties can need. Repeated ids count as one vector, the one with the
    smallest components. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = valid(vectors)
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").head(1)
    found_schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], found_schema)
    rows = rows.where(F.size("embedding") == lengths[0][0])
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # k + 1 ids of each vector; the limit by rank is applied before the rows are moved
    same = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(same))
    is_query = F.col("vec_id") % every == 0
    data = written(rows.select("vec_id", "embedding", is_query.alias("is_query")))
    shown = written(few.where(F.col("nth") <= k + 1).select("vec_id", "embedding"))
    n = shown.count()

    ranges = max(1, min(MOST_RANGES, math.ceil(n / range_rows)))
    curves = Curves(lengths[0][0])
    picked = min(MOST_SAMPLE, max(1000, SAMPLE_PER_RANGE * ranges))
    sample = shown.orderBy(F.xxhash64("vec_id"), "vec_id").limit(picked).select("embedding").toArrow()
    units = unit_rows(as_matrix(sample.column(0).combine_chunks()))
    curves.fit(units)
    cuts = []
    for c in range(CURVES):
        keys = np.sort(curves.keys(units, c))
        cuts.append(keys[(np.arange(1, ranges) * len(keys)) // ranges])

    def range_of(rows_: np.ndarray, curve: int, ids: np.ndarray) -> np.ndarray:
        """Equal cuts are ranges of one key; its rows are dealt over them by their ids."""
        keys = curves.keys(rows_, curve)
        low = np.searchsorted(cuts[curve], keys, side="left")
        high = np.searchsorted(cuts[curve], keys, side="right")
        return low + np.where(high > low, ids % np.maximum(high - low + 1, 1), 0)

    probes = (
        data.where("is_query").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBES).select("vec_id", "embedding")
    ).toArrow()
    reach = ranges
    if probes.num_rows and ranges > 1:
        reach = _reach(shown, probes, range_of, ranges, k, recall)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            own = unit_rows(as_matrix(batch.column(1)))
            asks = batch.column(2).to_numpy(zero_copy_only=False)
            offers = batch.column(3).to_numpy(zero_copy_only=False)
            for c in range(CURVES):
                at = range_of(own, c, ids)
                rows_, units_, kinds = [np.flatnonzero(offers)], [at[offers]], [np.zeros(offers.sum(), bool)]
                for step in range(-min(reach, ranges), min(reach, ranges) + 1):
                    to = at + step
                    chosen = asks & (to >= 0) & (to < ranges)
                    rows_.append(np.flatnonzero(chosen))
                    units_.append(to[chosen])
                    kinds.append(np.ones(chosen.sum(), bool))
                pick = np.concatenate(rows_)
                unit = np.concatenate(units_) * CURVES + c
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(unit),
                        batch.column(0).take(pa.array(pick)),
                        batch.column(1).take(pa.array(pick)),
                        pa.array(np.concatenate(kinds)),
                    ],
                    ["unit", "vec_id", "embedding", "asks"],
                )

    def search(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        asks = table["asks"].to_numpy()
        matrix = as_matrix(table["embedding"].combine_chunks())
        asked = np.flatnonzero(asks)
        out = []
        for a in range(0, len(asked), 256):
            part = asked[a : a + 256]
            out += compare_block(ids[part], matrix[part], ids[~asks], matrix[~asks], k)
        cols = zip(*out, strict=True) if out else ((), (), ())
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table(
            [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["query_id", "vec_id", "score"]
        )

    both = data.join(shown.select("vec_id", F.lit(True).alias("offers")), "vec_id", "left").where(
        "is_query or offers"
    )
    both = both.select("vec_id", "embedding", "is_query", F.coalesce("offers", F.lit(False)).alias("offers"))
    dealt = both.mapInArrow(deal, f"unit long, vec_id long, embedding {dict(data.dtypes)['embedding']}, asks boolean")
    found = dealt.groupBy("unit").applyInArrow(search, FOUND)
    return top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _reach(shown, probes, range_of, ranges: int, k: int, recall: float) -> int:
    """How many ranges to each side the probes need on the curves for the asked recall."""
    ids = probes.column(0).to_numpy()
    matrix = as_matrix(probes.column(1).combine_chunks())
    true = true_neighbours(shown, matrix, ids, k)
    wanted = shown.where(F.col("vec_id").isin([int(x) for x in set(true["vec_id"])])).toArrow()
    names = wanted.column(0).to_numpy()
    near = as_matrix(wanted.column(1).combine_chunks())
    row = {int(x): i for i, x in enumerate(names)}
    asked = {int(x): i for i, x in enumerate(ids)}
    pairs = [(asked[int(q)], row[int(v)]) for q, v in zip(true["query_id"], true["vec_id"], strict=True)]
    if not pairs:
        return 0
    a, b = np.array(pairs).T
    steps = np.full(len(a), ranges)
    for c in range(CURVES):
        from_, to = range_of(unit_rows(matrix), c, ids), range_of(unit_rows(near), c, names)
        steps = np.minimum(steps, np.abs(from_[a] - to[b]))
    return int(np.quantile(steps, recall, method="higher"))
