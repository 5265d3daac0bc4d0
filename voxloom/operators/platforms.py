"""Matching episodes with what platforms list: by guid, by title and date, by number; claims made twice are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.titles import platform_title, split_title
from .selection import unclaimed_twice

#: How far dates may be apart, and the least length of an upload.
TITLE_DAYS, UPLOAD_DAYS, LEAST_S = 2, 14, 600


def by_guid(episodes: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (id, claim) of episodes whose guid the platform lists."""
    return episodes.join(found.select("guid", F.col("platform_id").alias("claim")), "guid").select("id", "claim")


def _single(episodes: DataFrame, found: DataFrame, key: Column, found_key: Column, days: int) -> DataFrame:
    """Rows (id, claim) where exactly one platform id with the same key lies within so many days.

    Dates are dealt into stretches; a row meets its own and the two beside it, so a frequent key is no band
    join over all its rows.
    """
    a = episodes.select("id", key.alias("k"), F.unix_date("day").alias("d")).where("k IS NOT NULL")
    a = a.withColumn("s", F.explode(F.array(*[F.floor(F.col("d") / (days + 1)) + o for o in (-1, 0, 1)])))
    b = found.select(F.col("platform_id").alias("claim"), found_key.alias("k"), F.unix_date("day").alias("d2"), F.floor(F.unix_date("day") / (days + 1)).alias("s")).where("k IS NOT NULL")
    near = a.join(b, ["k", "s"]).where(F.abs(F.col("d") - F.col("d2")) <= days)
    return near.groupBy("id").agg(F.min("claim").alias("claim"), F.max("claim").alias("_other")).where("claim = _other").drop("_other")


def by_title(episodes: DataFrame, found: DataFrame, shows: tuple[str, ...] = (), days: int = TITLE_DAYS) -> DataFrame:
    """Rows (id, claim): the one listing of the same title within ``days``."""
    return _single(episodes, found, F.nullif(platform_title(F.col("title"), shows), F.lit("")), F.nullif(platform_title(F.col("title"), shows), F.lit("")), days)


def by_number_or_title(episodes: DataFrame, uploads: DataFrame, shows: tuple[str, ...] = (), days: int = UPLOAD_DAYS) -> DataFrame:
    """Rows (id, claim): uploads of LEAST_S or longer, by the number in the title, else by title."""
    long = uploads.where(F.col("seconds") >= LEAST_S)
    number = split_title(F.col("title"), F.lit(None), shows)[0]
    numbered = _single(episodes, long, F.col("number").cast("string"), number.cast("string"), days)
    rest = episodes.join(numbered.select("id"), "id", "left_anti")
    return numbered.unionByName(by_title(rest, long, shows, days))


def claimable(matches: DataFrame, held: DataFrame) -> DataFrame:
    """Matches whose platform id nobody else claims or holds."""
    return unclaimed_twice(matches, held, "claim")


def coverage(episodes: DataFrame, platforms: tuple[str, ...]) -> DataFrame:
    """How many episodes have an id on each platform."""
    return episodes.agg(F.count("*").alias("episodes"), *[F.count(p).alias(p) for p in platforms])
