"""Distributed union-find, and the tables in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop_path, fresh_path, shared_dir, write_table

__all__ = ["components", "drop_path", "fresh_path", "shared_dir", "write_table"]


def components(links: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``links`` (a, b): rows (id, component), the least id reachable.

    Every round sends each node the least label among itself and its neighbours, then jumps to
    that label's own label, so depth halves.  Messages are pre-aggregated before the shuffle
    and the labels are written to the shared folder, so no round depends on earlier executors.
    Nodes without a link do not appear; self-links and repeats are harmless; null ends are dropped.
    """
    links = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = write_table(
        links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges"
    )
    labels = write_table(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), f"{name}-0")
    step = 0
    while True:
        step += 1
        heard = edges.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        hop = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        nxt = (
            labels.join(heard, "id")
            .join(hop, "component")
            .select("id", F.least("component", "near", "far").alias("component"), (F.least("near", "far") < F.col("component")).alias("moved"))
        )
        nxt = write_table(nxt, f"{name}-{step}")
        labels = nxt.select("id", "component")
        if nxt.where("moved").isEmpty():
            return labels
