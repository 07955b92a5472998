"""Session recommendations ranked for each user by the factor model."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import rounded
from ..operators.baselines import Baselines
from ..operators.factors import Factors, dot
from ..operators.meet import groups_for, lists, meet, padded, stretches
from ..storage import cut
from .session import FREQUENT, FREQUENT_TAKEN, LIST_SIZE, MONTHS, session_candidates

# Users that one step compares with products, and the least products of a range.
USER_BLOCK = 1024
ITEM_BLOCK = 16_384

# Products of one step, and users that a task holds with their best products.
STEP = 256
USERS_HELD = 50_000

# What rounding to six places and the order of a sum can add to a value.
MARGIN = 2e-6


def _matrix(column: pa.Array, size: int | None = None) -> np.ndarray:
    """The vectors of a column, filled up with zeros."""
    row, value = lists(column, np.float64)
    lengths = np.bincount(row, minlength=len(column))
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    size = int(lengths.max(initial=0)) if size is None else size
    out = np.zeros((len(column), size))
    out[row[place < size], place[place < size]] = value[place < size]
    return out


class _Held:
    """Users of one group with their best products so far. Products come by rising id, so a later one
    counts only where its value is larger."""

    def __init__(self, rows: list[pa.RecordBatch], k: int, block: int):
        table = pa.Table.from_batches(rows).combine_chunks()
        ids, vectors, last = (table.column(i).combine_chunks() for i in (2, 3, 4))
        self.ids, self.block = ids.to_numpy(zero_copy_only=False), block
        self.p = _matrix(vectors)
        self.reach = np.sqrt((self.p**2).sum(axis=1))
        # the k-th value of earlier ranges stands in for k products that any of that value comes before
        floor = np.nextafter(last.fill_null(-np.inf).to_numpy(zero_copy_only=False), -np.inf)
        self.value = np.repeat(floor[:, None], k, axis=1)
        self.product = np.full(self.value.shape, None, dtype=object)

    def meet(self, rows: pa.RecordBatch) -> None:
        names = rows.column(2).to_numpy(zero_copy_only=False)
        q, b = _matrix(rows.column(3), self.p.shape[1]), rows.column(4).to_numpy(zero_copy_only=False)
        for i in range(0, len(names), STEP):
            part = slice(i, i + STEP)
            longest, top = np.sqrt((q[part] ** 2).sum(axis=1)).max(), b[part].max()
            for u in range(0, len(self.ids), self.block):
                own = slice(u, u + self.block)
                most = self.reach[own] * longest + top
                users = u + np.flatnonzero(most >= self.value[own, -1] - MARGIN)
                if len(users):
                    self._step(users, names[part], q[part], b[part])

    def _step(self, users: np.ndarray, names: np.ndarray, q: np.ndarray, b: np.ndarray) -> None:
        near = self.p[users] @ q.T + b >= self.value[users, -1:] - MARGIN
        some = near.any(axis=1)
        if not some.any():
            return
        users = users[some]
        at, filled = padded(near[some])
        # summed up in one order, so that equal vectors have equal values
        value = np.zeros(at.shape)
        for j in range(q.shape[1]):
            value += self.p[users, j][:, None] * q[at, j]
        value = b[at] + value
        value = np.copysign(np.floor(np.abs(value) * 1e6 + 0.5) / 1e6, value) + 0.0
        every = np.concatenate([self.value[users], np.where(filled, value, -np.inf)], axis=1)
        names = np.concatenate([self.product[users], names[at]], axis=1)
        order = np.argsort(-every, axis=1, kind="stable")[:, : self.value.shape[1]]
        self.value[users] = np.take_along_axis(every, order, 1)
        self.product[users] = np.take_along_axis(names, order, 1)

    def best(self) -> Iterator[pa.RecordBatch]:
        for u in range(0, len(self.ids), self.block):
            user, place = np.nonzero(self.product[u : u + self.block] != None)  # noqa: E711
            user += u
            columns = [
                pa.array(self.ids[user], pa.string()),
                pa.array(self.product[user, place], pa.string()),
                pa.array(self.value[user, place], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["user_id", "product_id", "value"])


def _search(k: int, block: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, held = None, [], None
        for lo, side, rows in stretches(batches):
            if lo != group:
                if held:
                    yield from held.best()
                group, asked, held = lo, [], None
            if side == 0:
                asked.append(rows)
            elif asked:
                held = held or _Held(asked, k, block)
                held.meet(rows)
        if held:
            yield from held.best()

    return run


def _length(vector: Column, offset: Column | float) -> Column:
    """The length of a vector with its offset as one more component."""
    more = F.lit(offset) if isinstance(offset, float) else offset
    return F.sqrt(F.aggregate(vector, more * more, lambda s, x: s + x * x))


def length_ranges(items: DataFrame, first: int) -> list[float]:
    """The lengths at which the longest ``first``, twice, four times as many products end. Every range
    but the last is about as large as all before it."""
    n = items.count()
    shares = []
    while first * 2 ** len(shares) < n:
        shares.append(1 - first * 2 ** len(shares) / n)
    if not shares:
        return []
    return sorted(set(items.agg(F.percentile_approx("length", shares, 10_000)).first()[0]), reverse=True)


def best_products(
    users: DataFrame, items: DataFrame, k: int, user_block: int | None = None, item_block: int | None = None
) -> DataFrame:
    """user_id, product_id, value: each user's k products of the largest b_i + p q.

    ``users`` (user_id, p) and ``items`` (product_id, b_i, q). Products are searched in ranges of
    falling length: no value in a range is above the product of the lengths of its longest vector and
    of the user's, offsets included or added apart, so a user whose k-th value is above that is done.
    The others are dealt to a bounded number of groups, past which the range streams; a user takes the
    k-th value along and sends what comes before it.
    """
    user_block, item_block = user_block or USER_BLOCK, item_block or ITEM_BLOCK
    items = cut(items.withColumn("length", _length(F.col("q"), F.col("b_i"))))
    ends = length_ranges(items, item_block)
    number = sum((F.when(F.col("length") <= e, 1).otherwise(0) for e in ends), F.lit(0))
    items = cut(items.withColumn("range", number))
    users = cut(users.withColumns({"reach": _length(F.col("p"), 1.0), "size": _length(F.col("p"), 0.0)}))
    # as many rows as ranges, which grow with the logarithm of the products
    ranges = items.groupBy("range").agg(
        F.max("length").alias("longest"), F.max(_length(F.col("q"), 0.0)).alias("size"), F.max("b_i").alias("offset")
    )
    best = None
    for r in sorted(ranges.collect(), key=lambda r: r["range"]):
        active = users.withColumn("last", F.lit(None).cast("double"))
        if best is not None:
            last = best.groupBy("user_id").agg(F.min("value").alias("last"), F.count(F.lit(1)).alias("found"))
            last = last.where(F.col("found") == k).drop("found")
            most = F.least(F.col("reach") * r["longest"], F.col("size") * r["size"] + r["offset"])
            # values are rounded to six places, and equal ones go by the smaller id
            open_ = F.col("last").isNull() | (F.col("last") <= most + MARGIN)
            active = cut(users.join(last, "user_id", "left").where(open_))
            if active.isEmpty():
                # the bound added apart need not fall from range to range
                continue
        own = items.where(F.col("range") == r["range"])
        found = _best_of_range(active, own, k, user_block)
        order = Window.partitionBy("user_id").orderBy(F.desc("value"), "product_id")
        every = found if best is None else best.unionByName(found)
        best = cut(every.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n"))
    if best is None:
        return users.select("user_id", F.lit("").alias("product_id"), F.lit(0.0).alias("value")).limit(0)
    return best


def _best_of_range(users: DataFrame, items: DataFrame, k: int, user_block: int) -> DataFrame:
    """user_id, product_id, value: the k best of a range, without those below a user's ``last``."""
    n = users.count()
    groups = groups_for(-(-n // user_block), n, USERS_HELD)
    lo = F.pmod(F.xxhash64("user_id"), F.lit(groups)).cast("int").alias("lo")
    asked = users.select(lo, F.col("user_id").alias("id"), F.col("p").alias("v"), F.col("last").alias("x"))
    data = items.select(F.col("product_id").alias("id"), F.col("q").alias("v"), F.col("b_i").alias("x"))
    return meet(asked, data, groups, ["id"], _search(k, user_block), "user_id string, product_id string, value double")


def personal_recommend(
    requests: DataFrame,
    events: DataFrame,
    model: Factors,
    details: DataFrame,
    months: int = MONTHS,
    size: int = LIST_SIZE,
    item_block: int | None = None,
) -> DataFrame:
    """user_id, target, rank, product_id, predicted_score, appearance_count and details.

    As ``session_recommend``, but products are ranked for each user: up to 3 frequent candidates
    by count, the other candidates by the user's predicted score, then the user's best products
    of all. A user or product without factors counts with its offset alone.
    """
    products = events.select("product_id").distinct()
    items = cut(item_rows(model, products))
    known = requests.select("user_id", F.col("product_id").alias("target")).distinct()
    known = known.join(user_rows(model), "user_id")
    known = cut(known.join(products.withColumnRenamed("product_id", "target"), "target", "left_semi"))
    targets = known.select(F.col("target").alias("product_id")).distinct()
    candidates = session_candidates(events, targets, months)
    users = known.select("user_id", "p").dropDuplicates(["user_id"])
    best = best_products(users, items, fill_size(size), item_block=item_block)
    return personal_lists(known, items, candidates, best, model.base, size).join(details, "product_id", "left")


def _wide(column: str) -> Column:
    return F.coalesce(F.col(column).cast("array<double>"), F.array().cast("array<double>"))


def user_rows(model: Factors) -> DataFrame:
    """user_id, b_u, p of all users the model knows."""
    users = model.base.users.join(model.users, "user_id", "left")
    return users.select("user_id", "b_u", _wide("p").alias("p"))


def item_rows(model: Factors, products: DataFrame) -> DataFrame:
    """product_id, b_i, q of all ``products``."""
    items = products.join(model.base.items, "product_id", "left").join(model.items, "product_id", "left")
    return items.select("product_id", F.coalesce("b_i", F.lit(0.0)).alias("b_i"), _wide("q").alias("q"))


def fill_size(size: int = LIST_SIZE) -> int:
    """How many of a user's best products a list of ``size`` can need."""
    return 2 * size + 1


def personal_lists(
    known: DataFrame,
    items: DataFrame,
    candidates: DataFrame,
    best: DataFrame,
    base: Baselines,
    size: int = LIST_SIZE,
) -> DataFrame:
    """The lists of ``personal_recommend`` without details, from what is known of each request:
    ``known`` (user_id, target, b_u, p), ``candidates`` (target, product_id, appearance_count),
    the users' ``best`` products and the ``items`` that occur in both."""
    scored = cut(
        known.join(candidates, "target").join(items, "product_id").select(
            "user_id", "target", "product_id", "appearance_count",
            rounded(F.col("b_i") + dot(F.col("p"), F.col("q"))).alias("value"),
        )
    )
    key = ["user_id", "target"]
    by_value = [F.desc("value"), F.col("product_id")]

    def ranked(df: DataFrame, order: list, most: int) -> DataFrame:
        w = Window.partitionBy(*key).orderBy(*order)
        return df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)

    often = scored.where(F.col("appearance_count") >= FREQUENT)
    high = ranked(often, [F.desc("appearance_count"), *by_value], FREQUENT_TAKEN)
    rest = ranked(scored, by_value, size + FREQUENT_TAKEN).join(
        high.select(*key, "product_id"), [*key, "product_id"], "left_anti"
    )
    fill = known.select(*key).join(best, "user_id")
    fill = fill.where(F.col("product_id") != F.col("target")).select(
        *key, "product_id", F.lit(None).cast("bigint").alias("appearance_count"), "value"
    )
    # A candidate among the best products is listed once: as a candidate if it is on that list.
    tiers = (
        high.select(*key, "product_id", "appearance_count", "value", F.lit(0).alias("tier"), "r")
        .unionByName(rest.select(*key, "product_id", "appearance_count", "value", F.lit(1).alias("tier"), "r"))
        .unionByName(fill.withColumns({"tier": F.lit(2), "r": F.lit(0)}))
    )
    first = Window.partitionBy(*key, "product_id").orderBy("tier")
    tiers = tiers.withColumn("n", F.row_number().over(first)).where(F.col("n") == 1)
    order = Window.partitionBy(*key).orderBy("tier", "r", F.desc("value"), "product_id")
    top = tiers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    top = top.select(*key, "rank", "product_id", "appearance_count")
    full = top.join(known, key).join(items, "product_id")
    raw = F.lit(base.mean["score"]) + F.col("b_u") + F.col("b_i") + dot(F.col("p"), F.col("q"))
    return full.withColumn("predicted_score", base.clip(raw)).drop("b_u", "b_i", "p", "q")
