"""A prefix trie of conversations: z-fast tries of bounded units, expanded and merged by Spark.

A prefix of turns is named by the sum of digests of (depth, turn), so that names of all depths
come from running sums, in segments of a bounded number of turns. Equal segments are one; the
distinct ones are dealt to units. A unit is a compacted trie: its nodes are hashed at their
two-fattest depth, a batch of segments finds the deepest node on each one's way by fat binary search
over these handles, and goes in from there, splitting the edge that it leaves. The edges are then
expanded into nodes with partial counts, which add up over all units by name. Sums over subtrees
run along the paths that a smallest member shares, from path to path.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import written
from shelfwise.storage import spread

#: Turns of a segment, and rows of one key that are ordered together.
SEGMENT, SLICE = 64, 1024
#: Distinct segments in a unit, and segments that look for their place together.
UNIT_SEGMENTS, BATCH = 20_000, 1024
#: Ids in a piece of a node's list of members that end there.
CHUNK = 4096
#: Parents with more than one in so many of all nodes as children are joined by broadcast.
HOT_SHARE = 1000
HEAD, BLOCK = 4, 20
WORD = r"[^\x20\x09-\x0D]+"
LIMBS = ["l1", "l2", "l3", "l4"]
ROOT = bytes(8 * len(LIMBS))


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, digest, words``: each conversation's turns numbered from 1.

    Null turn numbers come first, ties go by the digest. Slices of turn numbers are ordered
    apart, so that one conversation may hold any share of the rows.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(1 << 62))).alias("slice"),
        F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).alias("words"),
    )
    rows = written(rows)
    counts = rows.groupBy("conv_id", "slice").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("conv_id", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("conv_id", "slice").orderBy(F.col("turn").asc_nulls_first(), "digest")
    numbered = rows.withColumn("pos", F.row_number().over(own)).join(counts, ["conv_id", "slice"])
    return numbered.select("conv_id", (F.col("pos") + F.col("before")).alias("pos"), "digest", "words")


def rebuilt(numbered: DataFrame) -> DataFrame:
    """``conv_id, d, digest, words`` of the rebuilt conversations; turnless ones are one row with d = 0."""
    sizes = numbered.groupBy("conv_id").agg(F.max("pos").alias("n"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    convs = sizes.select("conv_id", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"))
    there = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(there, "base", "left").join(sizes, "conv_id")
    convs = written(convs.withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0)))))
    own = numbered.join(convs.select("conv_id", "h", "m"), "conv_id").where("pos > h")
    first = numbered.where(F.col("pos") < HEAD).withColumnRenamed("conv_id", "base")
    lent = first.join(convs.where("m > 0").select("conv_id", "base", "m"), "base").where("pos <= m")
    none = convs.where("m = 0 and n <= h")
    d = (F.col("m") + F.col("pos") - F.col("h")).alias("d")
    return (
        own.select("conv_id", d, "digest", "words")
        .unionByName(lent.select("conv_id", F.col("pos").alias("d"), "digest", "words"))
        .unionByName(none.select("conv_id", F.lit(0).alias("d"), F.lit("").alias("digest"), F.lit(0).alias("words")))
    )


def segments(rows: DataFrame) -> DataFrame:
    """``conv_id, seg, turns`` (limbs and words by depth), ``start`` (limb sums before), ``last``."""
    salted = F.sha2(F.concat_ws(":", F.col("d").cast("string"), "digest"), 256)
    limb = lambda i: F.conv(F.substring(salted, 8 * i + 1, 8), 16, 10).cast("long")
    limbs = [F.when(F.col("d") > 0, limb(i)).otherwise(0).alias(name) for i, name in enumerate(LIMBS)]
    seg = F.greatest(F.floor((F.col("d") - 1) / SEGMENT), F.lit(0)).alias("seg")
    turn = F.struct("d", *LIMBS, "words")
    parts = rows.select("conv_id", "d", "words", *limbs, seg).groupBy("conv_id", "seg")
    parts = parts.agg(F.array_sort(F.collect_list(turn)).alias("turns"), *[F.sum(x).alias(x) for x in LIMBS])
    order = Window.partitionBy("conv_id").orderBy("seg")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.struct(*[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(x) for x in LIMBS])
    last = F.lead("seg").over(order).isNull()
    return parts.select("conv_id", "seg", "turns", start.alias("start"), F.struct(*LIMBS).alias("own"), last.alias("last"))


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the largest power of two divides."""
    return high & -(1 << (low ^ high).bit_length() - 1)


class ZFastTrie:
    """A compacted trie of segments. A segment is a list of names, that of the prefix before it and
    those of all prefixes that end in it; ``depth`` is the depth of the first of these."""

    def __init__(self):
        self.low: list[int] = []  # an edge covers the depths (low, high]
        self.high: list[int] = []
        self.way: list[tuple[int, list[bytes]]] = []  # depth and names of a segment along the edge
        self.count: list[int] = []
        self.least: list[int] = []
        self.handles: dict[tuple[int, bytes], int] = {}
        self.begins: dict[tuple[int, bytes], int] = {}  # by the first name of the edge
        self.ends: dict[tuple[int, bytes], int] = {}

    def name(self, node: int, depth: int) -> bytes:
        at, names = self.way[node]
        return names[depth - at]

    def locate(self, depth: int, names: list[bytes], known: int) -> int:
        """The depth of the deepest node that the segment goes through, at least ``known``: the
        start of the edge on which it leaves the trie."""
        low, high = known, depth + len(names) - 1
        while low < high:
            f = two_fattest(low, high)
            node = self.handles.get((f, names[f - depth]))
            if node is None:
                high = f - 1
                continue
            end = self.high[node]
            if end >= depth + len(names) or self.name(node, end) != names[end - depth]:
                return self.low[node]
            low = end
        return low

    def add(self, depth: int, names: list[bytes], known: int, count: int, least: int) -> None:
        stop = depth + len(names) - 1
        at = self.locate(depth, names, known)
        while at < stop:
            node = self.begins.get((at + 1, names[at + 1 - depth]))
            if node is None:
                self._node(at, stop, (depth, names))
                break
            # names of prefixes stay equal up to where the segment leaves the edge
            same, apart = at + 1, min(self.high[node], stop) + 1
            while apart - same > 1:
                mid = (same + apart) // 2
                if self.name(node, mid) == names[mid - depth]:
                    same = mid
                else:
                    apart = mid
            if same < self.high[node]:
                self._split(node, same)
            at = same
        node = self.ends[stop, names[-1]]
        self.count[node] += count
        self.least[node] = min(self.least[node], least)

    def _node(self, low: int, high: int, way: tuple[int, list[bytes]]) -> None:
        node = len(self.low)
        self.low.append(low)
        self.high.append(high)
        self.way.append(way)
        self.count.append(0)
        self.least.append(1 << 63)
        self._enter(node)

    def _enter(self, node: int) -> None:
        low, high = self.low[node], self.high[node]
        f = two_fattest(low, high)
        self.handles[f, self.name(node, f)] = node
        self.begins[low + 1, self.name(node, low + 1)] = node
        self.ends[high, self.name(node, high)] = node

    def _split(self, node: int, depth: int) -> None:
        f = two_fattest(self.low[node], self.high[node])
        del self.handles[f, self.name(node, f)]
        low, self.low[node] = self.low[node], depth
        self._enter(node)
        self._node(low, depth, self.way[node])

    def insert(self, batch: list[tuple[int, list[bytes], int, int]]) -> None:
        """Segments (depth, names, count, smallest member): all look for their place, then go in."""
        found = [self.locate(depth, names, depth) for depth, names, _, _ in batch]
        for (depth, names, count, least), known in zip(batch, found, strict=True):
            self.add(depth, names, known, count, least)

    def edges(self) -> Iterator[tuple[int, int, int, int]]:
        """(node, segments below, smallest member, first depth of its edge) of all nodes."""
        for node in sorted(range(len(self.low)), key=self.high.__getitem__, reverse=True):
            low = self.low[node]
            if low > self.way[node][0]:  # else it hangs on the end of another segment
                above = self.ends[low, self.name(node, low)]
                self.count[above] += self.count[node]
                self.least[above] = min(self.least[above], self.least[node])
            yield node, self.count[node], self.least[node], self.low[node] + 1


NODES = "depth int, key binary, parent binary, n long, conv_id long, words int"


def unit_nodes(rows: pa.Table) -> pa.Table:
    """The expanded nodes of the segments of a unit, with partial counts."""
    trie = ZFastTrie()
    words: dict[bytes, int] = {}
    batch = []
    for r in rows.select(["start", "turns", "n", "conv_id"]).to_pylist():
        steps = np.array([[r["start"][x] for x in LIMBS], *[[t[x] for x in LIMBS] for t in r["turns"]]], ">i8")
        sums = np.cumsum(steps, axis=0, dtype=np.int64).astype(">i8")
        names = [row.tobytes() for row in sums]
        words.update(zip(names[1:], (t["words"] for t in r["turns"]), strict=True))
        batch.append((r["turns"][0]["d"] - 1, names, r["n"], r["conv_id"]))
        if len(batch) == BATCH:
            trie.insert(batch)
            batch = []
    trie.insert(batch)
    out = [
        (depth, trie.name(node, depth), trie.name(node, depth - 1), n, least, words[trie.name(node, depth)])
        for node, n, least, first in trie.edges()
        for depth in range(first, trie.high[node] + 1)
    ]
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
    columns = zip(*out, strict=True) if out else [[]] * 6
    names = [f.split()[0] for f in NODES.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def merged_nodes(parts: DataFrame) -> DataFrame:
    """The nodes below the root, from the segments of all conversations."""
    end = [(F.col("start")[x] + F.col("own")[x]).alias(x) for x in LIMBS]
    alike = parts.where("turns[0].d > 0").groupBy("seg", "start", F.struct(*end).alias("end"))
    alike = alike.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns"))
    alike = written(alike)
    units = max(1, math.ceil(alike.count() / UNIT_SEGMENTS))
    dealt = alike.withColumn("unit", F.pmod(F.xxhash64("seg", "end"), F.lit(units)))
    nodes = spread(dealt, "unit").groupBy("unit").applyInArrow(unit_nodes, NODES)
    return nodes.groupBy("key").agg(
        F.first("depth").alias("depth"),
        F.first("parent").alias("parent"),
        F.sum("n").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.first("words").alias("words"),
    )


def end_hashes(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256`` from ``key, conv_id``: the ids in order, in pieces that are written side
    by side and hashed one after the other."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def piece(key, ids):
            line = ",".join(map(str, ids)).encode()
            return pa.RecordBatch.from_pydict(
                {"key": pa.array([key], pa.binary()), "first": pa.array([ids[0]], pa.int64()), "line": pa.array([line])}
            )

        held = []
        for batch in batches:
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (k != key or len(ids) == CHUNK):
                    held.append(piece(key, ids))
                    ids = []
                key = k
                ids.append(i)
            if held:
                yield pa.concat_batches(held)
                held = []
        if ids:
            yield piece(key, ids)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []

        def done():
            names = [k for k, _ in out]
            return pa.RecordBatch.from_pydict({"key": pa.array(names, pa.binary()), "ends_sha256": pa.array([h for _, h in out], pa.string())})

        for batch in batches:
            for k, line in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if digest is not None and k == key:
                    digest.update(b",")
                else:
                    if digest is not None:
                        out.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256()
                digest.update(line)
            if out:
                yield done()
                out = []
        if digest is not None:
            out = [(key, digest.hexdigest())]
            yield done()

    spark = ends.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = ends.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = ordered.mapInArrow(cut, "key binary, first long, line binary")
    whole = spread(pieces, "key").sortWithinPartitions("key", "first")
    return whole.mapInArrow(hashed, "key binary, ends_sha256 string")


def with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with ``n_children`` and ``parent_conv_id``. Parents of very many nodes, which are few by
    their definition, are joined apart."""
    children = written(nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")))
    total = nodes.count()
    counted = nodes.join(children.withColumnRenamed("parent", "key"), "key", "left")
    counted = written(counted.withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    above = counted.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.col("n_children") * HOT_SHARE > total
    apart = F.broadcast(above.where(hot).drop("n_children"))  # less than HOT_SHARE rows
    near = counted.join(apart, "parent", "left")
    rest = near.where("parent_conv_id is null").drop("parent_conv_id")
    rest = rest.join(above.where(~hot).drop("n_children"), "parent", "left")
    return near.where("parent_conv_id is not null").unionByName(rest)


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``nodes`` with the sums of ``values`` over each node's subtree in their place.

    The nodes with one smallest member are the lower end of that member's way; a way hangs on a node
    of its parent's smallest member. Sums of whole ways go up from way to way until none is
    left to move: as often as the smallest member changes on a way from the root, at most.
    """
    ways = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("top"),
        F.min(F.struct("depth", "parent_conv_id")).alias("above"),
        *[F.sum(v).alias(v) for v in values],
    )
    ways = written(ways.select("conv_id", "top", F.col("above.parent_conv_id").alias("above"), *values))
    up = ways.where("above is not null").select("conv_id", "above", (F.col("top") - 1).alias("depth"))
    added = lambda df: df.groupBy("conv_id", "depth").agg(*[F.sum(v).alias(v) for v in values])
    moved = ways.select("conv_id", *values)
    got = None
    while True:
        sent = moved.join(up, "conv_id").select(F.col("above").alias("conv_id"), "depth", *values)
        sent = written(added(sent))
        if sent.isEmpty():
            break
        got = sent if got is None else got.unionByName(sent)
        moved = sent.groupBy("conv_id").agg(*[F.sum(v).alias(v) for v in values])
    own = nodes.select("conv_id", "depth", *values)
    sums = added(own if got is None else own.unionByName(got))
    sums = written(sums.withColumn("slice", F.floor(F.col("depth") / SLICE)))
    total = sums.groupBy("conv_id", "slice").agg(*[F.sum(v).alias(v) for v in values])
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(
        "conv_id", "slice", *[F.coalesce(F.sum(v).over(deeper), F.lit(0)).alias(f"{v}_below") for v in values]
    )
    here = Window.partitionBy("conv_id", "slice").orderBy(F.desc("depth"))
    sums = sums.select("conv_id", "slice", "depth", *[F.sum(v).over(here).alias(v) for v in values])
    sums = sums.join(total, ["conv_id", "slice"])
    sums = sums.select("conv_id", "depth", *[(F.col(v) + F.col(f"{v}_below")).alias(v) for v in values])
    return nodes.drop(*values).join(sums, ["conv_id", "depth"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations, as the query's contract has them.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    Rows without a conv_id take no part; other columns are ignored; an empty table has no nodes,
    not even a root. The first conversation of a negative id's block is the one nearer to zero.
    """
    parts = written(segments(written(rebuilt(written(turns(conversations))))))
    root = parts.where("seg = 0").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    root = root.where("n_convs > 0").select(
        F.lit(ROOT).alias("key"), F.lit(0).alias("depth"), F.lit(None).cast("binary").alias("parent"),
        "n_convs", "conv_id", F.lit(0).alias("words"),
    )
    nodes = written(merged_nodes(parts).unionByName(root))
    counted = with_parents(nodes).select(
        "key", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).cast("long").alias("saved_tokens"),
    )
    summed = subtree_sums(written(counted), ["n_leaves", "saved_tokens"])
    limbs = [F.col("start")[x] + F.col("own")[x] for x in LIMBS]
    key = F.unhex(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in limbs]))
    hashes = end_hashes(parts.where("last").select(key.alias("key"), "conv_id"))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return summed.join(hashes, "key", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
