"""Hard negatives by a secondary sort: each anchor's scores stream past in order, once.

All rows meet all anchors in blocks, by matrix products inside tasks. A score is packed into a
key (anchor, descending score, kind, id) whose bytes sort in that order; the shuffle deals keys by
anchor and sorts them, and one pass over a partition opens a window for each of an anchor's first
positives and hands out negatives until the window is full or left behind. No anchor's scores are
held together. A block sends on only what can still count: its own first positives, and of the
negatives with one score the first few, down to the edge of the lowest window that can open.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import written
from shelfwise.storage import spread

POSITIVES = NEGATIVES = 5
#: A negative counts from LOWEST to HIGHEST percent of the positive's score.
LOWEST, HIGHEST = 80, 100
SCALE = 256
ANCHOR_STEP, NOISE_STEP, LABELS = 100, 7, 10
#: Rows and anchors of a block, and anchors scored together in it.
BLOCK_ROWS, BLOCK_ANCHORS, TILE = 4096, 2048, 64
#: Sorted keys in a partition, about.
PARTITION_KEYS = 200_000
KEY = np.dtype([("anchor", ">u8"), ("down", ">u8"), ("kind", "u1"), ("id", ">u8")])
SIGN = 1 << 63
LEAST, MOST = -(1 << 62), 1 << 62


def scaled_rows(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, v``: rows that take part, noisy labels, components as whole numbers.

    Rows with a null id, label, vector or component, or one that is not finite, take no part. Of
    rows that share an id the first in the order of label and vector counts.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine
    )
    label = F.when(F.col("vec_id") % NOISE_STEP == 0, F.pmod(F.col("label") + 1, F.lit(LABELS))).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    rows = rows.select("vec_id", label.alias("label"), whole.alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, held within 62 bits."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(n, 1) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = [[[int(x) for x in row] for row in m] for m in (a, b)]
    out = [[sum(x * y for x, y in zip(p, q, strict=True)) for q in whole[1]] for p in whole[0]]
    return np.array([[min(max(x, LEAST), MOST) for x in row] for row in out], np.int64)


def packed(anchor: int, scores: np.ndarray, kind: int, ids: np.ndarray) -> bytes:
    """Keys one after the other; kind 0 are positives, which come first of equal scores."""
    out = np.empty(len(ids), KEY)
    out["anchor"] = anchor + SIGN
    out["down"] = np.uint64(SIGN - 1) - scores.astype(np.uint64)
    out["kind"] = kind
    out["id"] = ids.astype(np.uint64) ^ np.uint64(SIGN)
    return out.tobytes()


def block_keys(anchor: int, label: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> bytes:
    """What one anchor needs to know of a block: rows are in the order of their ids."""
    other = ids != anchor
    mine = np.flatnonzero((labels == label) & other)
    mine = mine[np.argsort(-scores[mine], kind="stable")[:POSITIVES]]
    theirs = labels != label
    # windows open at these positives or at better ones, so none reaches further down
    if len(mine) == POSITIVES:
        theirs &= scores >= -(-LOWEST * int(scores[mine[-1]]) // HIGHEST)
    theirs &= scores >= 0  # a window of a negative score is empty
    theirs = np.flatnonzero(theirs)
    theirs = theirs[np.argsort(-scores[theirs], kind="stable")]
    value = scores[theirs]
    run = np.ones(len(value), bool)
    run[1:] = value[1:] != value[:-1]
    begin = np.maximum.accumulate(np.where(run, np.arange(len(value)), 0))
    theirs = theirs[np.arange(len(value)) - begin < NEGATIVES]
    return packed(anchor, scores[mine], 0, ids[mine]) + packed(anchor, scores[theirs], 1, ids[theirs])


def block_scores(rows: pa.Table) -> Iterator[tuple[int, bytes]]:
    """(anchor, packed keys) of the anchors of a block."""
    asks = rows["asks"].to_numpy()
    ids, labels, v = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["v"])
    order = np.argsort(ids, kind="stable")
    here, anchors = order[~asks[order]], order[asks[order]]
    for p in range(0, len(anchors), TILE):
        tile = anchors[p : p + TILE]
        scores = products(v[tile], v[here])
        for row, a in zip(scores, tile, strict=True):
            keys = block_keys(int(ids[a]), int(labels[a]), row, ids[here], labels[here])
            if len(keys):
                yield int(ids[a]), keys


def windows(keys: Iterator[bytes]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Negatives from the sorted keys of whole anchors, with (anchor, positive, rank, negative,
    both scores). At most a handful of open windows is held."""
    anchor, seen, open_ = None, 0, []
    for key in keys:
        a = int.from_bytes(key[:8]) - SIGN
        score = SIGN - 1 - int.from_bytes(key[8:16])
        row = int.from_bytes(key[17:25]) - SIGN
        if a != anchor:
            anchor, seen, open_ = a, 0, []
        if not key[16]:
            if seen < POSITIVES:
                seen += 1
                open_.append([row, score, 0])
            continue
        for w in open_:
            if w[2] < NEGATIVES and LOWEST * w[1] <= HIGHEST * score <= HIGHEST * w[1]:
                w[2] += 1
                yield a, w[0], w[2], row, w[1], score


RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """For each anchor and each of its first positives the first hard negatives.

    Columns as in ``RESULT``. Anchors are the rows whose vec_id is divisible by 100; scores are whole inner
    products (of vectors of different length over the components that both have; beyond 62
    bits they are held there). Equal scores go by the smaller id. Other columns are ignored; an
    empty table, or one without anchors, gives no rows.
    """
    spark = vectors.sparkSession
    rows = written(scaled_rows(vectors))
    is_anchor = F.col("vec_id") % ANCHOR_STEP == 0
    count, asked = rows.agg(F.count("*"), F.count(F.when(is_anchor, 1))).first()
    across, down = max(1, math.ceil(count / BLOCK_ROWS)), max(1, math.ceil(asked / BLOCK_ANCHORS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    dealt = rows.select("*", F.lit(False).alias("asks"), own(across).alias("x"), every(down).alias("y")).unionByName(
        rows.where(is_anchor).select("*", F.lit(True).alias("asks"), own(down).alias("y"), every(across).alias("x"))
    )

    def run(block: pa.Table) -> pa.Table:
        found = list(block_scores(block))
        return pa.table(
            [pa.array([a for a, _ in found], pa.int64()), pa.array([k for _, k in found], pa.binary())],
            ["anchor", "keys"],
        )

    size = KEY.itemsize
    sent = written(spread(dealt, "x", "y").groupBy("x", "y").applyInArrow(run, "anchor long, keys binary"))
    total = (sent.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // size
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(total / PARTITION_KEYS))
    cut = lambda r: ((r[0][i : i + size], None) for i in range(0, len(r[0]), size))
    keys = sent.select("keys").rdd.flatMap(cut)
    ordered = keys.repartitionAndSortWithinPartitions(parts, lambda key: hash(int.from_bytes(key[:8]) // ANCHOR_STEP))
    return spark.createDataFrame(ordered.mapPartitions(lambda it: windows(k for k, _ in it)), RESULT)
