"""Incremental maintenance: digests, due sets, diffs, snapshots, step states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRIES = 3


def digests(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Rows (key, digest): SHA-256 of each key's rows in order, independent of how they arrived.

    Rows are hashed before they are gathered, so a key brings 64 characters a row.
    """
    line = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    packed = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    return rows.groupBy(key).agg(F.sha2(F.array_join(F.transform(packed, lambda x: x["_line"]), ""), 256).alias("digest"))


def due(current: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Keys whose digest is new or differs from the ledger's."""
    old = ledger.select(F.col(key).alias("_k"), F.col("digest").alias("_old"))
    return current.join(old, F.col(key) == F.col("_k"), "left").where(~F.col("digest").eqNullSafe(F.col("_old"))).select(key, "digest")


def diff(stored: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows (keys, change): insert, update, delete or same, null-safe."""
    a = stored.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*values).alias("_old"))
    b = new.select(*keys, F.struct(*values).alias("_new"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    rows = b.join(a, on, "full_outer")
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("update")
    return rows.select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], change.alias("change"))


def upsert(stored: DataFrame, new: DataFrame, key: str, changed: Column | None = None, reset: dict[str, Column] | None = None) -> DataFrame:
    """The next snapshot: new rows replace stored ones of the same key.

    ``changed`` tells, over the new row's columns and the stored row as the struct ``old``, which replaced
    rows start again: they take the values of ``reset``.
    """
    kept = stored.join(new.select(key), key, "left_anti")
    if changed is None:
        return kept.unionByName(new)
    old = stored.select(F.col(key).alias("_k"), F.struct(*stored.columns).alias("old"))
    both = new.join(old, F.col(key) == F.col("_k"), "left").withColumn("_again", F.coalesce(F.col("old").isNotNull() & changed, F.lit(False)))
    for name, value in (reset or {}).items():
        both = both.withColumn(name, F.when(F.col("_again"), value).otherwise(F.col(name)))
    return kept.unionByName(both.select(*new.columns))


def stale(ledger: DataFrame, current: DataFrame, key: str) -> DataFrame:
    return ledger.join(current.select(key), key, "left_anti").select(key)


def eligible(rows: DataFrame, step_input: str, step: str) -> DataFrame:
    """Rows ready for a step: at its input status, or failed in it with retries left."""
    again = (F.col("status") == "error") & (F.col("error_step") == step) & (F.col("retries") < RETRIES)
    return rows.where((F.col("status") == step_input) | again)


def moved_keys(stored: DataFrame, feed: DataFrame, key: str, url: str) -> DataFrame:
    """Keys whose url differs once query and fragment are gone."""
    from ..functions.text import base_url

    new = feed.select(F.col(key).alias("_k"), base_url(F.col(url)).alias("_u"))
    return stored.join(new, F.col(key) == F.col("_k")).where(base_url(F.col(url)) != F.col("_u")).select(key)


def guard_mass_change(changes: DataFrame, most: int = 5, force: bool = False) -> DataFrame:
    """``changes``, or an error when there are more than ``most`` and nobody forced it."""
    if not force and changes.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} keys moved at once; force it if that is right")
    return changes


def missing_embeddings(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts, by hash, that the cache has no vector for."""
    from ..functions.text import text_sha

    return chunks.select(text_sha(F.col("text")).alias("text_sha"), "text").dropDuplicates(["text_sha"]).join(cache.select("text_sha"), "text_sha", "left_anti")
