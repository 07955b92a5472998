"""Cold-start clusters kept up to date: a batch of events adds what is new to versioned tables.

A version holds the (session, product) pairs that its batch brought, the counts of the product pairs
that they add, and new lists of the products whose counts changed. Counts of all versions add
up, the newest list of a product is its own. A batch looks up the sessions it touches and the
counts of the products it touches, and leaves everything else unread. The log names the versions that
are whole, and is written last: a batch that failed has changed nothing, one that comes twice is
known by its name, and late or repeated events by the pairs that are there already.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.coldstart import RANDOM_N, TOP_N, rank_partners
from ..operators.pairs import CHUNK, pair_sums
from ..sources.keyed import BUCKET_ROWS, lookup, read_keyed, write_keyed
from ..storage import cut

LOG = "number long, name string, batch string, first long"
#: Versions that are read one by one; more are put together first.
MOST_VERSIONS = 16


def _path(root: str, name: str, part: str) -> str:
    return f"{root.rstrip('/')}/{part}/{name}"


def log(spark: SparkSession, root: str) -> list:
    """The versions written so far (number, name, batch, first), the oldest first. ``first`` is the
    number of the oldest version that one holds."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/log")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return []
    return sorted(spark.read.schema(LOG).json(f"{root.rstrip('/')}/log").collect())


def _live(rows: list) -> list:
    """The versions that make up the present state, as later ones may hold earlier ones."""
    out: list = []
    for r in rows:
        out = [x for x in out if x.number < r.first] + ([r] if r.name else [])
    return out


def _write_log(spark: SparkSession, root: str, row: tuple) -> None:
    spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").json(f"{root.rstrip('/')}/log")


def _looked_up(spark: SparkSession, root: str, names: list[str], part: str, wanted: DataFrame, like: str) -> DataFrame:
    found = spark.createDataFrame([], like)
    for name in names:
        found = found.unionByName(lookup(spark, _path(root, name, part), wanted))
    return cut(found)


MEMBERS, COUNTS = "user_session string, product_id string", "target string, candidate string, freq long"


def added_counts(fresh: DataFrame, there: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """target, candidate, freq: the sessions that hold a pair only since ``fresh`` members came to
    those that were ``there`` (both user_session, product_id, distinct, without common rows)."""
    among = pair_sums(fresh, "user_session", "product_id", chunk=chunk).select("a", "b", "n")
    across = pair_sums(there, "user_session", "product_id", left=fresh, chunk=chunk).select("a", "b", "n")
    across = cut(across)
    mirrored = across.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")
    both = among.unionByName(across).unionByName(mirrored).groupBy("a", "b")
    return both.agg(F.sum("n").cast("long").alias("freq")).select(
        F.col("a").alias("target"), F.col("b").alias("candidate"), "freq"
    )


def update_clusters(
    events: DataFrame,
    root: str,
    batch: str,
    top_n: int = TOP_N,
    random_n: int = RANDOM_N,
    seed: int | str = 42,
    chunk: int = CHUNK,
    bucket_rows: int = BUCKET_ROWS,
) -> bool:
    """Add the events (user_session, product_id) of a batch. False if the batch was there already.

    Batches come one after the other. Events without a session or product make no pairs; a
    product without a session is listed alone, as in ``coldstart_clusters``.
    """
    spark = events.sparkSession
    rows = log(spark, root)
    if any(r.batch == batch for r in rows):
        return False
    if len(_live(rows)) >= MOST_VERSIONS:
        compact(spark, root, bucket_rows)
        rows = log(spark, root)
    live = [r.name for r in _live(rows)]
    number = rows[-1].number + 1 if rows else 1
    seen = cut(events.select(F.col("user_session").cast("string"), F.col("product_id").cast("string")).distinct())
    new = seen.where("user_session is not null and product_id is not null")
    there = _looked_up(spark, root, live, "members", new.select("user_session"), MEMBERS)
    fresh = cut(new.join(there, ["user_session", "product_id"], "left_anti"))
    products = seen.where("product_id is not null").select(F.col("product_id").alias("target")).distinct()
    listed = _looked_up(spark, root, live, "clusters", products, "target string, bucket string, rank int, candidate string, freq long")
    products = products.join(listed, "target", "left_anti")
    counts = cut(added_counts(fresh, there, chunk))
    touched = cut(counts.select("target").union(products).distinct())
    if touched.isEmpty():
        _write_log(spark, root, (number, None, batch, number))
        return True
    before = _looked_up(spark, root, live, "counts", touched, COUNTS)
    sums = before.unionByName(counts).groupBy("target", "candidate").agg(F.sum("freq").alias("freq"))
    lists = rank_partners(cut(sums), touched, top_n, random_n, seed)
    name = f"{number:09d}-{uuid.uuid4().hex}"
    write_keyed(fresh, _path(root, name, "members"), ["user_session"], bucket_rows)
    write_keyed(counts, _path(root, name, "counts"), ["target"], bucket_rows)
    write_keyed(lists, _path(root, name, "clusters"), ["target"], bucket_rows)
    _write_log(spark, root, (number, name, batch, number))
    return True


def _newest(spark: SparkSession, root: str, live: list) -> DataFrame:
    """The newest list of each product."""
    lists = None
    for r in live:
        own = read_keyed(spark, _path(root, r.name, "clusters")).withColumn("number", F.lit(r.number))
        lists = own if lists is None else lists.unionByName(own)
    newest = lists.groupBy("target").agg(F.max("number").alias("number"))
    return lists.join(newest, ["target", "number"]).drop("number")


def current_clusters(spark: SparkSession, root: str) -> DataFrame:
    """target, bucket, rank, candidate, freq: those of ``coldstart_clusters`` on all events so far."""
    live = _live(log(spark, root))
    if not live:
        return spark.createDataFrame([], "target string, bucket string, rank int, candidate string, freq long")
    return _newest(spark, root, live)


def compact(spark: SparkSession, root: str, bucket_rows: int = BUCKET_ROWS) -> None:
    """Put all versions together as a new one. The old ones stay for readers that have them open."""
    rows = log(spark, root)
    live = _live(rows)
    if len(live) < 2:
        return
    number = rows[-1].number + 1
    name = f"{number:09d}-{uuid.uuid4().hex}"

    def every(part: str) -> DataFrame:
        out = read_keyed(spark, _path(root, live[0].name, part))
        for r in live[1:]:
            out = out.unionByName(read_keyed(spark, _path(root, r.name, part)))
        return out

    counts = every("counts").groupBy("target", "candidate").agg(F.sum("freq").alias("freq"))
    write_keyed(every("members"), _path(root, name, "members"), ["user_session"], bucket_rows)
    write_keyed(cut(counts), _path(root, name, "counts"), ["target"], bucket_rows)
    write_keyed(cut(_newest(spark, root, live)), _path(root, name, "clusters"), ["target"], bucket_rows)
    _write_log(spark, root, (number, name, None, live[0].number))
