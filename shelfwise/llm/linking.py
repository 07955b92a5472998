"""Links between sets that share a group, and the components that the links make.

Groups (equal band hashes, shared rare signatures) may hold any share of all sets. They are never
paired out: in each round every member of a group is compared with one centre of the group, first
with the member that shares groups with most others, and members that are already connected
with it are left out. In groups that still hold unconnected ones, sketches of the members outside
the largest connected part then meet those of all others in blocks of bounded size, a pair in the
first group that it shares. Only members with a pair that the sketches let through stay in a block;
their full sets are dealt to it, the task confirms its pairs and returns no more links than
connect its members, so that rows follow the members and not the pairs. Sets without sketches meet in blocks themselves: a task counts the common items of all its members
with matrix products and returns no more links than connect them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import discard, written
from shelfwise.storage import spread

#: Rounds with one centre in each group before the remaining members meet.
ROUNDS = 2
#: Items of the sets in a block, and parts in which the groups are done one after the other, so
#: that only one part's sets lie in shuffles at a time.
BLOCK_ITEMS = 1_000_000
PARTS = 4
#: Members on either side of a block of sketches.
BLOCK_ROWS = 4096
#: Members, and items, of one matrix.
TILE, ITEMS = 1024, 4096


def components(links: DataFrame) -> DataFrame:
    """``id, root`` (smallest id reachable) of all ids in ``links`` (a, b), by alternating stars.

    Each round replaces the links of an id by links to the smallest id next to it. A hub is only
    a large group of a sum or one side of a join against single rows.
    """
    edges = written(
        links.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # large star: larger neighbours go to the smallest neighbour
        large = (
            both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        )
        # small star: an id and its smaller neighbours go to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        new = written(
            small.select(F.col("m").alias("a"), "b")
            .unionByName(small.select(F.col("m").alias("a"), F.col("a").alias("b")))
            .where("a < b")
            .distinct()
        )
        same = edges.exceptAll(new).isEmpty() and new.count() == edges.count()
        edges = new
        if same:
            return edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root")).unionByName(
                edges.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct()
            )


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets (id, items) have that percentage in common."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("of_b"))
    n, m = F.size("of_a"), F.size("of_b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where((F.least(n, m) * 100 >= F.greatest(n, m) * percent))
        .where(shared * 100 >= (n + m - shared) * percent)
        .select("a", "b")
    )


def link(members: DataFrame, sets: DataFrame, percent: int, may_match, bits=None) -> DataFrame:
    """``id, root`` of every id that is linked with another one.

    ``members`` (key, id and the columns that ``may_match`` reads) and ``sets`` (id, items) are
    written tables; every id of a group has its set. ``may_match(a, b)`` makes a condition from
    two functions that give a member's columns: pairs that fail it are not compared in full
    with a centre. ``bits`` names the columns of the members' sketches, if they have any, and the
    most bits in which those of a pair may differ.
    """
    extra = [c for c in members.columns if c not in ("key", "id")]
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    near = members.join(sizes, "key").groupBy("id").agg(F.sum("size").alias("near"))
    members = written(members.join(near, "id"))
    links = roots = None
    for round_no in range(ROUNDS + 1):
        known = _unconnected(members, roots)
        if known.isEmpty():
            break
        if round_no < ROUNDS:
            pairs = written(_with_centres(known, extra, may_match, round_no))
            found = written(confirm(pairs, sets, percent))
            discard(pairs)
        elif bits:
            near = written(_promising(_units(known, sets, bits[0]), percent, *bits))
            found = written(_connecting(near, sets, percent, *bits))
            discard(near)
        else:
            found = _in_blocks(known.select("key", "id", "label"), sets, percent)
        discard(known)
        links = found if links is None else links.unionByName(found)
        roots = written(components(links))
    if roots is None:
        return members.select("id", F.col("id").alias("root")).limit(0)
    return roots


def _unconnected(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The members, with their label, of the groups that hold more than one label."""
    if roots is None:
        known = members.withColumn("label", F.col("id"))
    else:
        known = members.join(roots.select("id", F.col("root").alias("label")), "id", "left")
        known = known.withColumn("label", F.coalesce("label", "id"))
    split = known.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    return written(known.join(split.where("lo <> hi").select("key"), "key", "left_semi"))


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _with_centres(known: DataFrame, extra: list[str], may_match, round_no: int) -> DataFrame:
    """Each member with the centre of its group: the one that shares most groups with others,
    in later rounds any other."""
    first = -F.col("near") if round_no == 0 else F.xxhash64("id", "key", F.lit(round_no))
    centres = known.groupBy("key").agg(
        F.min(F.struct(first.alias("first"), "id", "label", *extra)).alias("c")
    )
    met = known.join(centres, "key").where(F.col("label") != F.col("c.label"))
    met = met.where(may_match(lambda c: F.col(c), lambda c: F.col(f"c.{c}")))
    return met.select(*_pair(F.col("id"), F.col("c.id"))).distinct()


LINKS = "a long, b long"


def _units(known: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """The members of each group dealt into blocks (key, x, y) that bound rows and items.

    Two members with different labels are not both in the group's largest label, so its members
    are only on the right side; all others are on both.
    """
    sized = sets.groupBy("id").agg(
        F.min(F.size("items")).alias("low"), F.max(F.size("items")).alias("high"), F.sum(F.size("items")).alias("n")
    )
    share = F.greatest(F.lit(1 / BLOCK_ROWS), F.col("n") / BLOCK_ITEMS)
    known = known.join(sized.withColumn("share", share).drop("n"), "id")
    labels = known.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("share").alias("share"))
    groups = labels.groupBy("key").agg(
        F.max(F.struct("n", "label", "share")).alias("main"), F.sum("share").alias("share")
    )
    groups = groups.select(
        "key",
        F.col("main.label").alias("main"),
        F.ceil("share").cast("int").alias("blocks"),
        F.greatest(F.ceil(F.col("share") - F.col("main.share") - 1e-6), F.lit(1)).cast("int").alias("small_blocks"),
    )
    shared = known.groupBy("id").agg(F.collect_set("key").alias("keys"))
    rows = known.join(groups, "key").join(shared, "id")
    rows = written(rows.withColumn("small", F.col("label") != F.col("main")))
    kept = ["key", "id", "label", "small", "low", "high", "keys", *columns]

    def side(of: DataFrame, left: bool) -> DataFrame:
        own, other = ("small_blocks", "blocks") if left else ("blocks", "small_blocks")
        at = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        names = ("x", "y") if left else ("y", "x")
        return of.select(*kept, F.lit(left).alias("left"), at.alias(names[0]), every.alias(names[1]))

    return side(rows.where("small"), True).unionByName(side(rows, False))


def _promising(dealt: DataFrame, percent: int, columns: list[str], most: int) -> DataFrame:
    """The rows of the blocks that have a pair in theirs which the sketches let through."""

    def pick(rows: pa.Table) -> pa.Table:
        near = np.zeros(len(rows), bool)
        for i, j in near_pairs(rows, columns, percent, most):
            near[i] = near[j] = True
        return rows.filter(pa.array(near))

    unit = ["key", "x", "y"]
    return spread(dealt, *unit).groupBy(*unit).applyInArrow(pick, dealt.schema)


def _connecting(dealt: DataFrame, sets: DataFrame, percent: int, columns: list[str], most: int) -> DataFrame:
    """Links between the members of each block, no more than connect them."""

    def compare(rows: pa.Table) -> pa.Table:
        pairs = near_pairs(rows, columns, percent, most)
        found = confirmed_links(rows, pairs, percent)
        return pa.table([pa.array(c, pa.int64()) for c in found], names=["a", "b"])

    unit = ["key", "x", "y"]
    return spread(dealt.join(sets, "id"), *unit).groupBy(*unit).applyInArrow(compare, LINKS)


def near_pairs(rows: pa.Table, columns: list[str], percent: int, most: int) -> Iterator[tuple]:
    """Pairs (rows of the left side, rows of the right) of a block whose labels differ, whose sizes
    and sketches are near, and which share no group with a smaller key."""
    left = rows["left"].to_numpy()
    small, ids, label, low, high = (rows[c].to_numpy() for c in ("small", "id", "label", "low", "high"))
    bits = np.stack([rows[c].to_numpy().view(np.uint64) for c in columns], axis=1)
    lists = rows["keys"].combine_chunks()
    counts = np.diff(lists.offsets.to_numpy())
    # the group's own key fills the lists up: only smaller ones are looked at
    key = rows["key"][0].as_py() if len(rows) else 0
    keys = np.full((len(ids), int(counts.max(initial=0))), key, np.int64)
    inside = np.arange(keys.shape[1]) < counts[:, None]
    keys[inside] = lists.flatten().to_numpy(zero_copy_only=False)
    ours, theirs = np.flatnonzero(left), np.flatnonzero(~left)
    for p in range(0, len(ours), TILE):
        for q in range(0, len(theirs), TILE):
            i, j = ours[p : p + TILE], theirs[q : q + TILE]
            apart = np.zeros((len(i), len(j)), np.uint16)
            for k in range(len(columns)):
                apart += np.bitwise_count(bits[i, k][:, None] ^ bits[j, k][None, :])
            near = (apart <= most) & (label[i][:, None] != label[j][None, :])
            near &= ~small[j][None, :] | (ids[i][:, None] < ids[j][None, :])
            near &= (high[i][:, None] * 100 >= low[j][None, :] * percent) & (
                high[j][None, :] * 100 >= low[i][:, None] * percent
            )
            a, b = np.nonzero(near)
            for at in range(0, len(a), TILE * 4):
                x, y = i[a[at : at + TILE * 4]], j[b[at : at + TILE * 4]]
                before = np.zeros(len(x), bool)
                for k in range(keys.shape[1]):
                    one = keys[x, k]
                    before |= (one < key) & (keys[y] == one[:, None]).any(axis=1)
                if not before.all():
                    yield x[~before], y[~before]


def confirmed_links(rows: pa.Table, pairs: Iterator[tuple], percent: int):
    """Of pairs of rows, sorted by the first, those (two lists of ids) whose full sets have that
    percentage in common, without those that earlier ones connect already."""
    ids = rows["id"].to_numpy()
    lists = rows["items"].combine_chunks()
    starts = lists.offsets.to_numpy()
    sizes = np.diff(starts)
    codes, distinct = pd.factorize(lists.flatten().to_numpy(zero_copy_only=False))
    starts = starts - starts[0]
    part, _ = pd.factorize(rows["label"].to_numpy())  # the connected part of each row
    held = np.zeros(len(distinct), bool)
    a, b = [], []
    for left, right in pairs:
        for i, first, end in _stretches(left):
            j = right[first:end]
            j = j[part[j] != part[i]]
            if not len(j):
                continue
            own = codes[starts[i] : starts[i] + sizes[i]]
            held[own] = True
            ends = np.cumsum(sizes[j])
            at = np.arange(int(ends[-1])) + np.repeat(starts[j] - (ends - sizes[j]), sizes[j])
            sums = np.concatenate([[0], np.cumsum(held[codes[at]])])
            held[own] = False
            common = sums[ends] - sums[ends - sizes[j]]
            for k in j[common * (100 + percent) >= percent * (sizes[i] + sizes[j])].tolist():
                if part[k] != part[i]:
                    part[part == part[k]] = part[i]
                    a.append(int(min(ids[i], ids[k])))
                    b.append(int(max(ids[i], ids[k])))
    return a, b


def _stretches(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, end) of the stretches of equal values."""
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    for first, end in zip(cuts, cuts[1:], strict=False):
        yield int(values[first]), first, end


def _in_blocks(known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that connect the members of each group (key, id, label) as far as any do."""

    def compare(rows: pa.Table) -> pa.Table:
        found = connecting_links(
            rows["id"].to_numpy(), rows["label"].to_numpy(), rows["items"].combine_chunks(), percent
        )
        return pa.table([pa.array(c, pa.int64()) for c in found], names=["a", "b"])

    sized = sets.select("id", F.size("items").alias("n"))
    weight = known.join(sized, "id").groupBy("key").agg(F.sum("n").alias("n"))
    weight = weight.select("key", F.ceil(F.col("n") / BLOCK_ITEMS).cast("int").alias("blocks"))
    weight = written(weight)
    found = None
    for part in range(PARTS):
        own = known.where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(PARTS)) == part)
        block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        dealt = own.join(weight, "key").withColumn("own", block)
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.join(sets, "id").select(
            F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
            "id", "label", "items",
        )
        links = written(dealt.groupBy("unit").applyInArrow(compare, LINKS))
        found = links if found is None else found.unionByName(links)
    return found


def connecting_links(ids: np.ndarray, labels: np.ndarray, items: pa.Array, percent: int):
    """Pairs (two lists) of similar sets with different labels, no more than connect the labels."""
    sizes = np.diff(items.offsets.to_numpy())
    _, code, often = np.unique(
        items.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True
    )
    row = np.repeat(np.arange(len(ids)), sizes)
    shared = often[code] > 1  # items of one set only are in no intersection
    number = np.cumsum(often > 1) - 1
    row, code = row[shared], number[code[shared]]
    width = int(number[-1]) + 1 if len(number) else 0
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    group = np.unique(labels, return_inverse=True)[1]
    root = list(range(int(group.max(initial=-1)) + 1))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left, right = [], []
    for p in range(0, len(ids), TILE):
        for q in range(0, p + TILE, TILE):
            if q >= len(ids):
                break
            n, m = sizes[p : p + TILE], sizes[q : q + TILE]
            common = np.zeros((len(n), len(m)), np.float32)
            for low in range(0, width, ITEMS):
                a, b = np.searchsorted(code, (low, low + ITEMS))
                common += _presence(row[a:b], code[a:b] - low, p, len(n)) @ _presence(
                    row[a:b], code[a:b] - low, q, len(m)
                ).T
            alike = common * (100 + percent) >= percent * (n[:, None] + m[None, :])
            alike &= group[p : p + TILE][:, None] != group[q : q + TILE][None, :]
            for i, j in zip(*np.nonzero(alike), strict=True):
                x, y = top(group[p + i]), top(group[q + j])
                if x != y:
                    root[x] = y
                    left.append(int(ids[p + i]))
                    right.append(int(ids[q + j]))
    return left, right


def _presence(row: np.ndarray, code: np.ndarray, first: int, count: int) -> np.ndarray:
    out = np.zeros((count, ITEMS), np.float32)
    inside = (row >= first) & (row < first + count)
    out[row[inside] - first, code[inside]] = 1
    return out
