"""A stored inverted index: postings by bucket of their stem, lengths, maintenance and integrity.

A version is a folder; changing documents writes the next one from the postings that stay and those of the
changed documents alone.  A query reads the buckets of its stems and, sorted inside, few row groups of them.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path
from . import search

BUCKETS = 32


def bucket_of(stem: str) -> int:
    return zlib.crc32(stem.encode()) % BUCKETS


@dataclass(frozen=True)
class Index:
    """``postings`` (id, pos, term, stem, bucket) and ``lengths`` (id, dl) of a version in ``path``."""

    path: str
    postings: DataFrame
    lengths: DataFrame
    stemmed: bool


def _write(postings: DataFrame, lengths: DataFrame, path: str, stemmed: bool) -> Index:
    rows = postings.select("id", "pos", "term", "stem", (F.crc32("stem") % BUCKETS).cast("int").alias("bucket"))
    # a bucket's postings in several files, so a frequent stem is no single task's work
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("bucket", "stem", "id", "pos")
    dealt.write.partitionBy("bucket").parquet(f"{path}/postings")
    lengths.select("id", "dl").write.parquet(f"{path}/lengths")
    return read(postings.sparkSession, path, stemmed)


def read(spark: SparkSession, path: str, stemmed: bool = True) -> Index:
    return Index(path, spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"), stemmed)


def build(docs: DataFrame, id_col: str, text: str, path: str | None = None, stemmed: bool = True) -> Index:
    """The index of all documents, also the empty ones: they count in the mean length."""
    path = path or fresh_path(docs.sparkSession, "index")
    return _write(search.postings(docs, id_col, text, stemmed), search.lengths(docs, id_col, text), path, stemmed)


def update(index: Index, changed: DataFrame, id_col: str, text: str, gone: DataFrame | None = None, path: str | None = None) -> Index:
    """The next version: ``changed`` documents (new or other text) in, ``gone`` (id) and their old postings out."""
    touched = changed.select(F.col(id_col).alias("id"))
    touched = touched if gone is None else touched.unionByName(gone.select("id"))
    touched = touched.distinct()
    kept, lengths = (t.join(touched, "id", "left_anti") for t in (index.postings.drop("bucket"), index.lengths))
    new = search.postings(changed, id_col, text, index.stemmed)
    path = path or fresh_path(changed.sparkSession, "index")
    return _write(kept.unionByName(new.select(*kept.columns)), lengths.unionByName(search.lengths(changed, id_col, text)), path, index.stemmed)


def differences(index: Index, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Rows (id, pos, stem) that the index and its documents do not share: empty where it is whole."""
    want = search.postings(docs, id_col, text, index.stemmed).select("id", "pos", "stem")
    have = index.postings.select("id", "pos", "stem")
    return want.exceptAll(have).unionByName(have.exceptAll(want))


def vocabulary(index: Index) -> DataFrame:
    """Rows (stem, docs, uses)."""
    return index.postings.groupBy("stem", "id").agg(F.count("*").alias("n")).groupBy("stem").agg(F.count("*").alias("docs"), F.sum("n").alias("uses"))


def all_said(index: Index, queries: DataFrame, text: str = "query") -> DataFrame:
    """``queries`` (passage id ``id``, text) with ``said``: whether every stem of the text is in the passage."""
    words = search.postings(queries.withColumn("_q", F.monotonically_increasing_id()), "_q", text, index.stemmed).select(F.col("id").alias("_q"), "stem").distinct()
    asked = queries.withColumn("_q", F.monotonically_increasing_id())
    wanted = asked.select("_q", "id").join(words, "_q")
    found = wanted.join(index.postings.select("id", "stem").distinct().withColumn("_hit", F.lit(1)), ["id", "stem"], "left")
    missing = found.groupBy("_q").agg(F.count(F.when(F.col("_hit").isNull(), 1)).alias("_missing"))
    return asked.join(missing, "_q", "left").withColumn("said", F.coalesce(F.col("_missing") == 0, F.lit(True))).drop("_q", "_missing")
