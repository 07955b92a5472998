"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points (virtual nodes) of a ring. A row goes clockwise from the hash of its
key to the first shard that has room; a full shard sends it on. With the bound at the average
the shards' row counts differ by one at most, and adding a shard moves little.

The ring has a fixed number of cells. Only the rows per cell are counted (one bounded row per
cell reaches the driver), the walk is planned on these counts, and the rows find their shard by
their rank within the cell. Everything row by row is DataFrame expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_BITS = 12
VIRTUAL_NODES = 64


def walks(shards: int, cell_bits: int = CELL_BITS, nodes: int = VIRTUAL_NODES) -> list[list[int]]:
    """For each cell of the ring, all shards in the order a clockwise walk meets them."""
    cells = 1 << cell_bits
    points = sorted(
        (int.from_bytes(hashlib.md5(f"{s}:{v}".encode()).digest()[:8], "big") % cells, s)
        for s in range(shards)
        for v in range(nodes)
    )
    out = []
    for cell in range(cells):
        first = next((i for i, (at, _) in enumerate(points) if at >= cell), 0)
        met = dict.fromkeys(s for _, s in points[first:] + points[:first])
        out.append(list(met))
    return out


def room(total: int, shards: int, load: float) -> list[int]:
    """Most rows of each shard: ``load`` times the average; at 1 exactly the even split."""
    if load <= 1:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [-(-int(total * load) // shards) + 1] * shards


def plan_walk(
    counts: dict[int, int], shards: int, load: float = 1.0, cell_bits: int = CELL_BITS
) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, last rank, shard, first slot): where each part of a cell's rows goes.

    In step r every cell offers what is left of its rows to the r-th shard clockwise, cells in
    ring order. The room of all shards together is at least the total, so all rows are placed.
    """
    order = walks(shards, cell_bits)
    free = room(sum(counts.values()), shards, load)
    used = [0] * shards
    done = dict.fromkeys(counts, 0)
    parts = []
    for step in range(shards):
        for cell in sorted(counts):
            shard = order[cell][step]
            n = min(counts[cell] - done[cell], free[shard] - used[shard])
            if n > 0:
                parts.append((cell, done[cell] + 1, done[cell] + n, shard, used[shard]))
                done[cell] += n
                used[shard] += n
    return parts


def cell_of(key: Column, cell_bits: int = CELL_BITS) -> Column:
    return F.shiftrightunsigned(key, 64 - cell_bits).cast("int")


def assign(
    rows: DataFrame,
    keys: Sequence[str],
    shards: int,
    load: float = 1.0,
    cell_bits: int = CELL_BITS,
) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    A row's place on the ring is the hash of the ``keys`` columns, nulls included. Equal keys lie
    in one cell in the order of all other columns; which of two wholly equal rows gets which
    slot is left open. Empty tables give no rows. Columns named shard or slot are replaced.
    """
    rows = rows.drop("shard", "slot")
    at = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    counted = rows.select(cell_of(at, cell_bits).alias("cell")).groupBy("cell").count()
    parts = plan_walk({r[0]: r[1] for r in counted.collect()}, shards, load, cell_bits)
    places = rows.sparkSession.createDataFrame(
        parts, "_cell int, _lo bigint, _hi bigint, shard int, _base bigint"
    )
    others = [F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])]
    ranked = rows.withColumn("_at", at).withColumn("_cell", cell_of(F.col("_at"), cell_bits))
    order = Window.partitionBy("_cell").orderBy("_at", *[F.col(f"`{k}`") for k in keys], *others)
    ranked = ranked.withColumn("_rank", F.row_number().over(order).cast("long"))
    # At most one row for each cell and a few for each shard: bounded by the ring, not the data.
    found = ranked.join(
        F.broadcast(places), ["_cell"], "inner"
    ).where(F.col("_rank").between(F.col("_lo"), F.col("_hi")))
    slot = (F.col("_base") + F.col("_rank") - F.col("_lo")).alias("slot")
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], "shard", slot)


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Documents in shards of equal row counts (law ``rows``), placed by doc_id.

    Null texts are empty, null ids share one place on the ring, repeated rows get slots of
    their own; texts are not moved, only their size and checksum are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return assign(rows, ["doc_id"], shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
