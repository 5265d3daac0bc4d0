"""Selecting rows: selector terms, scopes, status changes, reports and lists for review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import evenly


def select(rows: DataFrame, selector: str) -> DataFrame:
    """The union of comma-separated terms over (id, published, year, number, stem, in_scope), oldest first.

    Terms: all, scope, seed (newest 20 and 15 evenly of the rest), recent:N, ep:N, year:Y, stem:S, spread:N
    (evenly among those out of scope).
    """

    def term(t: str) -> DataFrame:
        name, _, value = t.strip().partition(":")
        newest = [F.desc("published"), F.desc("id")]
        plain: dict[str, Column] = {"all": F.lit(True), "scope": F.col("in_scope")}
        if name in plain and not value:
            return rows.where(plain[name])
        if name == "seed" and not value:
            return seed(rows)
        if name in ("ep", "year"):
            return rows.where(F.col("number" if name == "ep" else "year") == int(value))
        if name == "stem" and value:
            return rows.where(F.col("stem") == value)
        if name == "recent":
            return rows.orderBy(*newest).limit(int(value))
        if name == "spread":
            return evenly(rows.where(~F.col("in_scope")), ["published", "id"], int(value), 0.5, last=False)
        raise ValueError(f"unknown selector {t!r}")

    found = reduce(DataFrame.unionByName, [term(t) for t in selector.split(",")])
    return found.dropDuplicates(["id"]).orderBy("published", "id")


def seed(rows: DataFrame, recent: int = 20, rest: int = 15, order: tuple[str, str] = ("published", "id")) -> DataFrame:
    """The newest rows, and ``rest`` evenly spaced of the others, newest first."""
    newest = [F.desc(order[0]), F.desc(order[1])]
    new = rows.orderBy(*newest).limit(recent)
    others = rows.join(F.broadcast(new.select(order[1])), order[1], "left_anti")
    return new.unionByName(evenly(others, newest, rest))


def set_scope(rows: DataFrame, wanted: DataFrame, key: str = "stem") -> DataFrame:
    """``rows`` with exactly the wanted keys in scope; a key that no row has is an error."""
    unknown = [r[0] for r in wanted.join(rows.select(key), key, "left_anti").select(key).limit(5).collect()]
    if unknown:
        raise ValueError(f"unknown: {unknown}")
    hit = wanted.select(F.col(key).alias("_w")).distinct()
    return rows.join(hit, F.col(key) == F.col("_w"), "left").withColumn("in_scope", F.col("_w").isNotNull()).drop("_w")


def scope_changes(rows: DataFrame, wanted: DataFrame, key: str = "stem") -> DataFrame:
    """Rows (key, change): added, removed or unknown, where the scope has to become ``wanted`` exactly."""
    both = rows.select(key, "in_scope").join(wanted.select(F.col(key).alias("_w")).distinct(), F.col(key) == F.col("_w"), "full_outer")
    change = F.when(F.col(key).isNull(), "unknown").when(F.col("_w").isNotNull() & ~F.col("in_scope"), "added").when(F.col("_w").isNull() & F.col("in_scope"), "removed")
    return both.select(F.coalesce(key, "_w").alias(key), change.alias("change")).where("change IS NOT NULL")


def next_after(rows: DataFrame, order: str, after) -> DataFrame:
    """The first row after ``after`` in order, starting over at the end."""
    return rows.orderBy((F.col(order) <= F.lit(after)), order).limit(1)


def unclaimed_twice(matches: DataFrame, held: DataFrame, claim: str) -> DataFrame:
    """Matches whose claim nobody else makes and nobody holds already."""
    n = F.count("*").over(Window.partitionBy(claim))
    return matches.withColumn("_n", n).where("_n = 1").drop("_n").join(held.select(claim), claim, "left_anti")


def auto_scope(new: DataFrame, stored: DataFrame, at: str = "published") -> DataFrame:
    """Adds ``in_scope`` to new rows: as new as the newest stored, and never on a first import."""
    newest = stored.agg(F.max(at).alias("_newest"))
    return new.join(F.broadcast(newest)).withColumn("in_scope", F.coalesce(F.col(at) >= F.col("_newest"), F.lit(False))).drop("_newest")
