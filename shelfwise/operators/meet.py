"""Every asking row meets every data row, without a shuffle that grows with the square.

Askers are dealt to a bounded number of groups. A group's task holds its askers and streams the data
past them in order, so that the shuffle is the data times the number of groups and a task keeps its
askers and their best rows only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Groups of askers. Only askers too many for the memory of a task make more.
GROUPS = 64


def groups_for(least: int, rows: int, per_group: int) -> int:
    """Up to GROUPS groups for the parallelism; more where a group would hold too many rows."""
    return max(1, min(GROUPS, least), -(-rows // per_group))


def meet(asked: DataFrame, data: DataFrame, groups: int, order: list[str], run, schema: str) -> DataFrame:
    """``asked`` carries its group ``lo``; both have the columns of ``asked`` beside it, ``order`` among
    them. ``data`` may say in ``to`` which groups a row goes to; else it goes to all. ``run`` gets Arrow batches sorted by lo, side (askers are 0, data 1) and ``order``."""
    columns = [c for c in asked.columns if c != "lo"]
    every = F.explode("to" if "to" in data.columns else F.sequence(F.lit(0), F.lit(groups - 1)))
    left = asked.select("lo", F.lit(0).alias("side"), *columns)
    right = data.select(every.alias("lo"), F.lit(1).alias("side"), *columns)
    dealt = left.unionByName(right).repartitionById(groups, F.col("lo"))
    return dealt.sortWithinPartitions("lo", "side", *order).mapInArrow(run, schema)


def stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(lo, side, rows) of each stretch of equal lo and side in a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lo, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        ends = np.flatnonzero((np.diff(lo) != 0) | (np.diff(side) != 0)) + 1
        for start, end in zip([0, *ends], [*ends, len(lo)], strict=True):
            yield int(lo[start]), int(side[start]), batch.slice(start, end - start)


def lists(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of all entries of a column of arrays."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(column)), sizes), np.asarray(column.flatten(), dtype=dtype)


def keep_best(best: np.ndarray, rows: np.ndarray, keys: np.ndarray, payload: list[tuple[np.ndarray, np.ndarray]]):
    """Merge candidates into the k best keys of ``rows``.

    ``best`` holds k keys per row, ``keys`` the candidates of ``rows`` (one line each). A pair in
    ``payload`` is what is kept beside the keys, and its values for the candidates.
    """
    k = best.shape[1]
    if keys.shape[1] > k:
        at = np.argpartition(keys, keys.shape[1] - k, axis=1)[:, -k:]
        keys = np.take_along_axis(keys, at, 1)
        payload = [(kept, np.take_along_axis(new, at, 1)) for kept, new in payload]
    every = np.concatenate([best[rows], keys], axis=1)
    at = np.argpartition(every, every.shape[1] - k, axis=1)[:, -k:]
    best[rows] = np.take_along_axis(every, at, 1)
    for kept, new in payload:
        kept[rows] = np.take_along_axis(np.concatenate([kept[rows], new], axis=1), at, 1)


def padded(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the true entries of each line, and which places of that matrix are filled."""
    row, col = np.nonzero(mask)
    sizes = np.bincount(row, minlength=len(mask))
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(mask), int(sizes.max(initial=0))), dtype=np.int64)
    filled = np.zeros(out.shape, dtype=bool)
    out[row, place] = col
    filled[row, place] = True
    return out, filled
