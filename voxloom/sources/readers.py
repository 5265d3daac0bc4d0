"""Sources with explicit schemas: feeds, transcripts, JSON-line logs, positional telemetry, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_url, feed_duration

FEED = "title string, guid string, link string, pubDate string, `itunes:episode` int, `itunes:duration` string, enclosure struct<_url: string, _length: bigint, _type: string>"
WORD = "struct<start: double, end: double, word: string, probability: double>"
TRANSCRIPT = (
    "meta struct<guid: string, title: string, number: int, published_at: string, duration_s: double, model: string>, "
    f"segments array<struct<start: double, end: double, text: string, no_speech_prob: double, avg_logprob: double, words: array<{WORD}>>>"
)
LOG = "ts timestamp, run_id string, level string, msg string, error string, episode string, step string, duration_ms bigint"


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files that have an enclosure and a date; a missing guid is the bare audio url."""
    rows = spark.read.format("xml").option("rowTag", "item").schema(FEED).load(path)
    url = base_url(F.col("enclosure._url"))
    rows = rows.where(F.col("enclosure._url").isNotNull() & F.col("pubDate").isNotNull())
    date = F.try_to_timestamp(F.regexp_replace("pubDate", r"^\w{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return rows.select("title", F.coalesce("guid", url).alias("guid"), F.col("link").alias("page_url"), date.alias("published_at"), F.col("`itunes:episode`").alias("number"), feed_duration(F.col("`itunes:duration`")).alias("duration_s"), url.alias("audio_url"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Words of transcript files: (guid, segment, pos, text, start_ms, end_ms, prob)."""
    rows = spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path)
    rows = rows.select(F.col("meta.guid").alias("guid"), F.posexplode("segments").alias("segment", "s"))
    rows = rows.select("guid", "segment", F.posexplode("s.words").alias("pos", "w"))
    ms = lambda c: F.bround(F.col(c) * 1000, 0).cast("bigint")
    return rows.select("guid", "segment", "pos", F.trim("w.word").alias("text"), ms("w.start").alias("start_ms"), ms("w.end").alias("end_ms"), F.col("w.probability").alias("prob"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with a time, level and message; others are skipped."""
    rows = spark.read.schema(LOG).option("mode", "PERMISSIVE").json(path)
    return rows.where("ts IS NOT NULL AND level IS NOT NULL AND msg IS NOT NULL")


def telemetry(points: DataFrame) -> DataFrame:
    """Named columns of positional telemetry, searches and reports; empty strings are null and the sample defaults to 1.

    A report has its status first and its traffic where a search has its words.
    """
    search = F.coalesce(F.col("index1") != "report", F.lit(True))
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    number = lambda c: F.col(c).cast("string").try_cast("double")
    of_search = lambda c, name: F.when(search, c).alias(name)
    return points.select(
        F.when(search, "search").otherwise("report").alias("kind"), F.col("timestamp").alias("ts"), of_search(text("blob1"), "q"), of_search(text("blob2"), "mode"), of_search(text("blob3"), "sort"),
        of_search(text("blob4"), "cache"), F.when(search, text("blob5")).otherwise(text("blob1")).alias("traffic"), of_search(number("double1"), "results"), of_search(number("double2"), "ms"),
        of_search(number("double3"), "degraded"), of_search(number("double4"), "page"), F.when(search, number("double5")).otherwise(number("double1")).alias("status"),
        F.coalesce(F.nullif(number("_sample_interval"), F.lit(0.0)), F.lit(1.0)).alias("sample"),
    )
