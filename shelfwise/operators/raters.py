"""The most similar raters of a product, exact, for each rating that is to be predicted."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .meet import groups_for, keep_best, lists, meet, stretches
from .sampling import dense_index

# Fixed value: usual default of the predictors.
NEIGHBORS = 40

# Users that meet at once, training and test ratings a group of users may hold, and products whose
# ratings are held as a dense matrix at once.
BLOCK_USERS = 512
BLOCK_RATINGS = 2_000_000
BLOCK_WANTS = 250_000
BLOCK_ITEMS = 2048

# Pairs of ratings from which a product that two blocks share is a column of a matrix product; below,
# its pairs are written out. Pairs are written out in portions of MOST.
DENSE = 8192
MOST = 1 << 20

# Raters of a wanted product from which all pairs of two blocks are judged by a bound before any is
# looked at, and what writing them out must come to for that.
POPULAR = 64
BOUNDED = 200_000

# Test ratings whose neighbours go out in one batch, and users whose order stands for that of all.
OUT_ROWS = 4096
SAMPLE = 8192

# A key orders by similarity in steps of 1e-6, then by the place in the order of ids: the number of a
# range (at most RANGES) and of a row in it (33 bits).
_PLACES = 10**6
_IDS = 1 << 43
RANGES = 1024

_FOUND = "user_id string, product_id string, other string, sim double, score double, mean double"


def _matched(counts: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(entry, partner) of all pairs, in portions: entry e has counts[e] partners from starts[e] on."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    borders = [0, *(np.searchsorted(ends, np.arange(MOST, total + MOST, MOST)) + 1)]
    for lo, hi in itertools.pairwise(borders):
        n, before = counts[lo:hi], ends[lo:hi] - counts[lo:hi]
        if not n.any():
            continue
        entry = np.repeat(np.arange(lo, lo + len(n)), n)
        first = int(before[0])
        yield entry, np.arange(first, first + len(entry)) + np.repeat(starts[lo:hi] - before, n)


class _Block:
    """Users with their ratings: row and value of each, by product; ``at`` is its place in ``items``."""

    def __init__(self, n: int, row: np.ndarray, item: np.ndarray, value: np.ndarray):
        order = np.argsort(item, kind="stable")
        item = item[order]
        self.n, self.row, self.value = n, row[order], value[order]
        self.starts = np.flatnonzero(np.diff(item, prepend=-1))
        self.items, self.counts = item[self.starts], np.diff(self.starts, append=len(item))
        self.at = np.repeat(np.arange(len(self.items)), self.counts)

    @classmethod
    def of(cls, rows: pa.RecordBatch) -> _Block:
        row, item = lists(rows.column("i"), np.int64)
        return cls(rows.num_rows, row, item, lists(rows.column("v"), np.float64)[1])

    def entries(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratings of the products at ``places``, and which of them."""
        look = np.full(len(self.items), -1)
        look[places] = np.arange(len(places))
        column = look[self.at]
        entry = np.flatnonzero(column >= 0)
        return entry, column[entry]

    def dense(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entry, column = self.entries(places)
        x, m = np.zeros((self.n, len(places))), np.zeros((self.n, len(places)))
        x[self.row[entry], column] = self.value[entry]
        m[self.row[entry], column] = 1.0
        return x, m

    def rated(self, places: np.ndarray) -> np.ndarray:
        """Which users rated any of the products at ``places``."""
        out = np.zeros(self.n, dtype=bool)
        out[self.row[self.entries(places)[0]]] = True
        return out

    def only(self, users: np.ndarray) -> _Block:
        keep = users[self.row]
        number = np.cumsum(users) - 1
        return _Block(int(users.sum()), number[self.row[keep]], self.items[self.at[keep]], self.value[keep])


def _shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common values of two sorted lists in both."""
    return np.intersect1d(a, b, assume_unique=True, return_indices=True)[1:]


class _Overlap:
    """Number of common products and squared differences of the users of two blocks.

    Products that many of both blocks rated are columns of a matrix product; pairs of ratings of the
    others are written out.
    """

    def __init__(self, a: _Block, b: _Block):
        self.a, self.b = a, b
        mine, theirs = _shared(a.items, b.items)
        many = a.counts[mine] * b.counts[theirs] >= DENSE
        self.wide = mine[many], theirs[many]
        self.n = self.sd2 = self.sim = self._held = None
        mine, theirs = mine[~many], theirs[~many]
        if len(mine):
            entry, column = a.entries(mine)
            cells = a.n * b.n
            n, sd2 = np.zeros(cells), np.zeros(cells)
            for e, p in _matched(b.counts[theirs][column], b.starts[theirs][column]):
                e = entry[e]
                cell = a.row[e] * b.n + b.row[p]
                gap = a.value[e] - b.value[p]
                n += np.bincount(cell, minlength=cells)
                sd2 += np.bincount(cell, gap * gap, minlength=cells)
            self.n, self.sd2 = n.reshape(a.n, b.n), sd2.reshape(a.n, b.n)

    def columns(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Scores and marks of both blocks for the shared columns, in parts."""
        mine, theirs = self.wide
        if self._held is not None:
            yield self._held
            return
        for start in range(0, len(mine), BLOCK_ITEMS):
            part = slice(start, start + BLOCK_ITEMS)
            held = (*self.a.dense(mine[part]), *self.b.dense(theirs[part]))
            if len(mine) <= BLOCK_ITEMS:
                self._held = held
            yield held

    def all_pairs(self) -> None:
        shape = (self.a.n, self.b.n)
        n = np.zeros(shape) if self.n is None else self.n.copy()
        sd2 = np.zeros(shape) if self.sd2 is None else self.sd2.copy()
        for x, mx, y, my in self.columns():
            n += mx @ my.T
            sd2 += np.hstack([x * x, mx, -2 * x]) @ np.hstack([my, y * y, y]).T
        self.sim = _similarity(n, sd2)

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Similarity of the users i of the one block and j of the other; -1 without a common product."""
        if self.sim is None and len(i) * 8 > self.a.n * self.b.n:
            self.all_pairs()
        if self.sim is not None:
            return self.sim[i, j]
        n = np.zeros(len(i)) if self.n is None else self.n[i, j]
        sd2 = np.zeros(len(i)) if self.sd2 is None else self.sd2[i, j]
        for x, mx, y, my in self.columns():
            step = max(1, MOST // x.shape[1])
            for part in (slice(s, s + step) for s in range(0, len(i), step)):
                both = mx[i[part]] * my[j[part]]
                gap = x[i[part]] - y[j[part]]
                n[part] += both.sum(axis=1)
                sd2[part] += np.einsum("ij,ij,ij->i", gap, gap, both)
        return _similarity(n, sd2)

    def within(self, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs whose mean squared difference is at most ``most`` of the first user, and some more.

        sd2 - most * n is one product in single precision; a bound on its rounding error is taken off.
        """
        a, b = self.a, self.b
        over = np.zeros((a.n, b.n), dtype=np.float32)
        if self.n is not None:
            over += (self.sd2 * (1 - 1e-6) - most[:, None] * self.n * (1 + 1e-6)).astype(np.float32)
        for x, mx, y, my in self.columns():
            share = 2 * (3 * x.shape[1] + 8) * 2.0**-24
            mine, theirs = x * x, y * y
            slack = share * (2 * mine.sum(axis=1) + most * mx.sum(axis=1))
            left = np.hstack([mine - most[:, None] * mx, mx, -2 * x, -slack[:, None], np.ones((a.n, 1))])
            right = np.hstack([my, theirs, y, np.ones((b.n, 1)), -2 * share * theirs.sum(axis=1)[:, None]])
            over += left.astype(np.float32) @ right.astype(np.float32).T
        return np.nonzero(~(over > 0))


def _similarity(n: np.ndarray, sd2: np.ndarray) -> np.ndarray:
    """1 / (mean squared difference + 1); -1 without a common product."""
    return np.where(n > 0, 1 / (np.maximum(sd2, 0) / np.maximum(n, 1) + 1), -1.0)


class _Wants:
    """A block of asking users and what they ask for, by user."""

    def __init__(self, rows: pa.RecordBatch, first: int):
        self.block = _Block.of(rows)
        self.row, item = lists(rows.column("want"), np.int64)
        self.items, self.at = np.unique(item, return_inverse=True)
        self.first = first


class _Askers:
    """The users of one group, what they ask for, and the best raters found so far."""

    def __init__(self, rows: list[pa.RecordBatch], k: int, users: int, extra: list[str]):
        table = pa.Table.from_batches(rows).combine_chunks()
        self.blocks, self.asked, wanted = [], [], 0
        for part in (table.slice(s, users) for s in range(0, table.num_rows, users)):
            part = part.combine_chunks().to_batches()[0]
            self.blocks.append(_Wants(part, wanted))
            row = self.blocks[-1].row
            self.asked.append((part.column("u").take(pa.array(row)), part.column("want_id").flatten()))
            wanted += len(row)
        self.key = np.full((wanted, k), -1, dtype=np.int64)
        self.least = np.full(wanted, -1, dtype=np.int64)
        self.sim, self.score = np.zeros((wanted, k)), np.zeros((wanted, k))
        self.seat = np.zeros((wanted, k), dtype=np.int64)
        self.extra = extra
        self.others: list[pa.Array] = []
        self.means: list[np.ndarray] = []
        self.carried: dict[str, list[pa.Array]] = {c: [] for c in extra}
        self.seen = 0

    def see(self, rows: pa.RecordBatch) -> None:
        """Of equally similar raters those with the smaller id stay, in whatever order they come."""
        theirs = _Block.of(rows)
        self.others.append(rows.column("u"))
        sums = np.bincount(theirs.row, theirs.value, minlength=theirs.n)
        self.means.append(sums / np.maximum(np.bincount(theirs.row, minlength=theirs.n), 1))
        for c in self.extra:
            self.carried[c].append(rows.column(c))
        place = np.asarray(rows.column("r"), dtype=np.int64)
        for wants in self.blocks:
            own = _shared(wants.block.items, theirs.items)[1]
            asked = _shared(wants.items, theirs.items)[1]
            if not len(own) or not len(asked):
                continue
            users = theirs.rated(own) & theirs.rated(asked)
            if users.any():
                who = np.flatnonzero(users)
                part = theirs if len(who) == theirs.n else theirs.only(users)
                self._meet(wants, part, _IDS - 1 - place[who], self.seen + who)
        self.seen += theirs.n

    def _meet(self, wants: _Wants, theirs: _Block, place: np.ndarray, seat: np.ndarray) -> None:
        mine, at = _shared(wants.items, theirs.items)
        counts, starts = np.zeros((2, len(wants.items)), dtype=np.int64)
        counts[mine], starts[mine] = theirs.counts[at], theirs.starts[at]
        counts, starts = counts[wants.at], starts[wants.at]
        least = self.least[wants.first : wants.first + len(counts)]
        overlap = _Overlap(wants.block, theirs)
        bounded = (least >= _IDS) & (counts >= POPULAR)
        if counts[bounded].sum() < BOUNDED:
            bounded[:] = False

        def merge(w: np.ndarray, entry: np.ndarray, sim: np.ndarray) -> None:
            row = theirs.row[entry]
            key = np.where(sim >= 0, np.rint(sim * _PLACES).astype(np.int64) * _IDS + place[row], -1)
            ok = key > least[w]
            if ok.any():
                entry, row = entry[ok], row[ok]
                self._merge(wants.first + w[ok], key[ok], sim[ok], theirs.value[entry], seat[row])

        if bounded.any():
            for found in self._bounded(wants, overlap, np.flatnonzero(bounded), least):
                merge(*found)
        want = np.flatnonzero(~bounded & (counts > 0))
        if counts[want].sum() * 8 > wants.block.n * theirs.n and overlap.sim is None:
            overlap.all_pairs()
        for w, entry in _matched(counts[want], starts[want]):
            w = want[w]
            merge(w, entry, overlap.pairs(wants.row[w], theirs.row[entry]))

    def _bounded(self, wants: _Wants, overlap: _Overlap, want: np.ndarray, least: np.ndarray):
        """Raters of the wants whose k-th key is known, from the pairs that can still count."""
        theirs = overlap.b
        worst = np.full(wants.block.n, np.inf)
        np.minimum.at(worst, wants.row[want], (least[want] // _IDS - 0.6) / _PLACES)
        asks = np.isfinite(worst)
        i, j = overlap.within(np.where(asks, 1 / np.where(asks, worst, 1.0) - 1, 0.0))
        keep = asks[i]
        i, j = i[keep], j[keep]
        sim = overlap.pairs(i, j)
        keep = sim >= worst[i]
        i, j, sim = i[keep], j[keep], sim[keep]
        items = np.unique(wants.at[want])
        column = np.zeros(len(wants.items), dtype=np.int64)
        column[items] = np.arange(len(items))
        entry, c = theirs.entries(np.searchsorted(theirs.items, wants.items[items]))
        rating = np.full((theirs.n, len(items)), -1, dtype=np.int32)
        rating[theirs.row[entry], c] = entry
        first, last = (np.searchsorted(wants.row[want], np.arange(wants.block.n), side=s) for s in ("left", "right"))
        for pair, w in _matched((last - first)[i], first[i]):
            w = want[w]
            entry = rating[j[pair], column[wants.at[w]]]
            ok = entry >= 0
            yield w[ok], entry[ok], sim[pair[ok]]

    def _merge(self, w, key, sim, score, seat) -> None:
        """Wants with about as many candidates are merged together, so that little of a matrix is empty."""
        order = np.argsort(w, kind="stable")
        rows, starts, counts = np.unique(w[order], return_index=True, return_counts=True)
        by = np.argsort(counts, kind="stable")
        start = 0
        while start < len(by):
            # as many lines as fit: the widest comes last
            fit = np.flatnonzero(counts[by[start:]] * np.arange(1, len(by) - start + 1) <= MOST)
            part = by[start : start + max(1, len(fit))]
            start += len(part)
            n = counts[part]
            place = np.arange(n.max())[None, :]
            filled = place < n[:, None]
            at = order[np.where(filled, starts[part][:, None] + place, 0)]
            keys = np.where(filled, key[at], -1)
            kept = [(self.sim, sim[at]), (self.score, score[at]), (self.seat, seat[at])]
            keep_best(self.key, rows[part], keys, kept)
            self.least[rows[part]] = self.key[rows[part]].min(axis=1)

    def found(self) -> Iterator[pa.RecordBatch]:
        users = pa.concat_arrays([u for u, _ in self.asked])
        names = pa.concat_arrays([n for _, n in self.asked])
        others = pa.concat_arrays(self.others)
        means = np.concatenate(self.means)
        carried = [pa.concat_arrays(self.carried[c]) for c in self.extra]
        for start in range(0, len(self.key), OUT_ROWS):
            row, col = np.nonzero(self.key[start : start + OUT_ROWS] >= 0)
            at = pa.array(start + row)
            seat = self.seat[start + row, col]
            yield pa.RecordBatch.from_arrays(
                [users.take(at), names.take(at), others.take(pa.array(seat)),
                 pa.array(self.sim[start + row, col]), pa.array(self.score[start + row, col]),
                 pa.array(means[seat]), *[c.take(pa.array(seat)) for c in carried]],
                names=["user_id", "product_id", "other", "sim", "score", "mean", *self.extra],
            )


def _nearest_raters(k: int, users: int, extra: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, waiting, askers = None, [], None
        for lo, side, rows in stretches(batches):
            if lo != group:
                if askers:
                    yield from askers.found()
                group, waiting, askers = lo, [], None
            if side == 0:
                waiting.append(rows)
                continue
            if askers is None:
                if not waiting:
                    continue
                askers = _Askers(waiting, k, users, extra)
            for start in range(0, rows.num_rows, 4 * users):
                askers.see(rows.slice(start, 4 * users))
        if askers:
            yield from askers.found()

    return run


def _group_of(asked: DataFrame, groups: int) -> Column:
    """Groups are stretches of the order by (h, r) with about as many ratings each, by a bounded sample."""
    size = (F.size("i") + F.size("want")).alias("n")
    rows = asked.orderBy(F.xxhash64("u"), "r").limit(SAMPLE).select("h", "r", size).collect()
    rows.sort(key=lambda x: (x["h"], x["r"]))
    ends = np.cumsum([x["n"] for x in rows])
    at = np.searchsorted(ends, ends[-1] * np.arange(1, groups) / groups) if rows else []
    borders = [F.struct(*[F.lit(rows[i][c]).cast("bigint").alias(c) for c in ("h", "r")]) for i in at]
    if not borders:
        return F.lit(0)
    return F.size(F.filter(F.array(*borders), lambda x: x < F.struct("h", "r")))


def _with_groups(data: DataFrame, asked: DataFrame, groups: int) -> DataFrame:
    """``data`` with ``to``: the groups in which someone asks for a product of the user, and someone
    rated one. From 64 groups on, groups share a bit."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("lo", F.lit(64)))
    none = F.lit(0).cast("bigint")
    pairs = asked.select(bit.alias("own"), none.alias("ask"), F.explode("i").alias("n")).unionByName(
        asked.select(none.alias("own"), bit.alias("ask"), F.explode("want").alias("n"))
    )
    masks = cut(pairs.groupBy("n").agg(F.bit_or("own").alias("own"), F.bit_or("ask").alias("ask")))
    met = data.select("r", F.explode("i").alias("n")).join(masks, "n").groupBy("r").agg(
        F.bit_or("own").bitwiseAND(F.bit_or("ask")).alias("bits")
    )
    to = F.filter(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.getbit("bits", F.pmod(g, F.lit(64))) == 1)
    return data.join(met, "r").withColumn("to", to).drop("bits")


def rating_neighbors(
    train: DataFrame,
    test: DataFrame,
    k: int = NEIGHBORS,
    block_users: int = BLOCK_USERS,
    block_ratings: int = BLOCK_RATINGS,
    carry: DataFrame | None = None,
) -> DataFrame:
    """user_id, product_id, other, sim, score, mean: the k most similar raters of each test product,
    with their mean score. ``carry`` has a row per user_id; its other columns (doubles) come along.

    The users of the test ratings are dealt to groups, and users stream past each group with their
    ratings. A task knows the similarity of its users to the others and sends only k rows per test
    rating: neither user pairs nor the raters of a popular product are ever written out, and the
    ratings are shuffled at most once for each of a bounded number of groups. Users are ordered by
    the smallest hash of their products, so that those with common products are near each other; they
    go to the groups only in which someone asks for a product of theirs and someone shares one.
    """
    numbers = cut(dense_index(train, "product_id", "n").withColumn("n", F.col("n").cast("int")))
    users = train.join(numbers, "product_id").groupBy(F.col("user_id").alias("u")).agg(
        F.array_sort(F.collect_list(F.struct("n", F.col("score").cast("double").alias("v")))).alias("x")
    )
    wants = test.select("user_id", "product_id").join(numbers, "product_id").groupBy(F.col("user_id").alias("u")).agg(
        F.array_sort(F.collect_set(F.struct("n", "product_id"))).alias("w")
    )
    extra = [] if carry is None else [c for c in carry.columns if c != "user_id"]
    users = users.join(wants, "u", "left")
    if extra:
        users = users.join(carry.select(F.col("user_id").alias("u"), *[F.col(c).cast("double") for c in extra]), "u", "left")
    users = users.select(
        "u", F.array_min(F.transform("x", lambda y: F.xxhash64(y["n"]))).alias("h"),
        F.transform("x", lambda y: y["n"]).alias("i"), F.transform("x", lambda y: y["v"]).alias("v"),
        F.transform("w", lambda y: y["n"]).alias("want"), F.transform("w", lambda y: y["product_id"]).alias("want_id"),
        *extra,
    )
    ranges = min(RANGES, int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # numbers in the order of ids, which need no more than the order
    users = cut(users.repartitionByRange(ranges, "u").sortWithinPartitions("u").withColumn("r", F.monotonically_increasing_id()))
    facts = users.agg(
        F.count(F.lit(1)).alias("u"), F.sum(F.size("i")).alias("n"), F.sum(F.when(F.col("want").isNotNull(), F.size("want"))).alias("w")
    ).first()
    groups = groups_for(-(-facts["u"] // block_users), facts["n"] or 0, block_ratings)
    groups = max(groups, -(-(facts["w"] or 0) // BLOCK_WANTS))
    asked = users.where(F.col("want").isNotNull())
    asked = asked.withColumn("lo", _group_of(asked, groups))
    data = users.withColumns(
        {"want": F.lit(None).cast("array<int>"), "want_id": F.lit(None).cast("array<string>")}
    )
    if groups > 1:
        data = _with_groups(data, asked, groups)
    schema = ", ".join([_FOUND, *[f"{c} double" for c in extra]])
    return meet(asked, data, groups, ["h", "r"], _nearest_raters(k, block_users, extra), schema)
