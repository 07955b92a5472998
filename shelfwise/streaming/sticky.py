"""Keep a user's cluster while the next product is still inside it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.coldstart import cluster_for_target

OUTPUT = "user_id string, at timestamp, target string, cluster string"


class StickyCluster(StatefulProcessor):
    """State per user: the cluster chosen last and its members, a list of bounded length.

    A request brings the cluster it would choose now. The last one stays while the requested
    product is among its members, or when the request has no cluster at all.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState(
            "cluster", "cluster string, members array<string>", self.ttl_ms
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One user's requests of one micro-batch, whose size the source limits.
        every = pd.concat(list(rows)).sort_values(["at", "target"])
        cluster, members = self.last.get() if self.last.exists() else (None, [])
        members = list(members)
        answers = []
        for target, own, listed in zip(every["target"], every["cluster"], every["members"], strict=True):
            if own is not None and target not in members:
                cluster, members = own, list(listed)
            answers.append(cluster)
        if cluster is not None:
            self.last.update((cluster, members))
        yield pd.DataFrame(
            {"user_id": key[0], "at": every["at"], "target": every["target"], "cluster": answers}
        )

    def close(self) -> None:
        pass


def with_clusters(requests: DataFrame, clusters: DataFrame) -> DataFrame:
    """Requests (user_id, at, product_id) with the cluster each would choose and its members."""
    products = clusters.select(F.col("target").alias("product_id")).union(
        clusters.where(F.col("candidate").isNotNull()).select("candidate")
    )
    chosen = cluster_for_target(clusters, products)
    members = clusters.groupBy(F.col("target").alias("cluster")).agg(
        F.collect_list("candidate").alias("members")
    )
    table = chosen.join(members, "cluster").select(
        F.col("target").alias("product_id"), "cluster", "members"
    )
    return requests.join(table, "product_id", "left").select(
        "user_id", "at", F.col("product_id").alias("target"), "cluster", "members"
    )


def sticky_clusters(requests: DataFrame, clusters: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Streaming: the cluster each request is answered from. Needs the RocksDB state store.

    With ``ttl_ms`` a user's state expires; such a query keeps running batches to look for
    expired state, so it is stopped by its caller and does not end by itself.
    """
    return (
        with_clusters(requests, clusters)
        .groupBy("user_id")
        .transformWithStateInPandas(
            statefulProcessor=StickyCluster(ttl_ms),
            outputStructType=OUTPUT,
            outputMode="Append",
            timeMode="None" if ttl_ms is None else "ProcessingTime",
        )
    )
