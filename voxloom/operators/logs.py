"""Search-log analytics: traffic classes, weighted counts, spellings, nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import squeeze
from .ordered import numbered


def traffic(agent: Column, maintainer: Column, batch_agent: str) -> Column:
    """Who asked, of a request: the batch pipeline by its agent's prefix, a maintainer by header, else the web."""
    return F.when(agent.startswith(batch_agent), "pipeline").when(maintainer, "maintainer").otherwise("web")


def weighted_percentile(points: DataFrame, keys: list[str], value: str, weight: str, share: float) -> DataFrame:
    """Rows (keys, p): the first value whose running weight reaches ``share`` of the total.

    Weights are first summed per value, so a hot key brings as many rows as it has values.
    """
    by = points.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    running = F.sum("_w").over(Window.partitionBy(*keys).orderBy(value))
    total = F.sum("_w").over(Window.partitionBy(*keys))
    return by.withColumn("_hit", F.when(running >= share * total, F.col(value))).groupBy(*keys).agg(F.min("_hit").alias("p"))


def spellings(points: DataFrame, q: str, weight: str, results: str) -> DataFrame:
    """Searches grouped by normalised text: label (heaviest spelling, ties by text), weight, mean results."""
    by = points.where(F.col(q).isNotNull()).groupBy(squeeze(F.col(q)).alias("key"), F.col(q).alias("_q")).agg(
        F.sum(weight).alias("_w"), F.sum(F.col(weight) * F.col(results)).alias("_r"), F.sum(F.when(F.col(results).isNotNull(), F.col(weight))).alias("_n")
    )
    best = F.min(F.struct((-F.col("_w")).alias("w"), F.col("_q").alias("q")))
    return by.groupBy("key").agg(best["q"].alias("label"), F.sum("_w").alias("weight"), (F.sum("_r") / F.sum("_n")).alias("mean_results"))


def daily_crossings(points: DataFrame, ts: str, budget: int) -> DataFrame:
    """Rows (day, n, half_at, full_at): events a day and which one first reached half and passed the budget."""
    rows = numbered(points.withColumn("day", F.to_date(ts)), [ts, "event_id"], "n", ["day"])
    half = -(-budget // 2)
    return rows.groupBy("day").agg(
        F.count("*").alias("n"), F.min(F.when((F.col("n") >= half) & (F.col("n") <= budget), F.col("event_id"))).alias("half_at"),
        F.min(F.when(F.col("n") > budget, F.struct("n", "event_id")))["event_id"].alias("full_at"),
    )


def window_replace(stored: DataFrame, fetched: DataFrame, ts: str, start: Column) -> DataFrame:
    """Stored points before ``start`` and everything fetched from then on."""
    return stored.where(F.col(ts) < start).unionByName(fetched.where(F.col(ts) >= start))
