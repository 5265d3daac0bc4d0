"""The life of an episode: feed import, scope, steps, publishing, requeueing, reports."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import base_url
from ..storage import write_table
from .publish import RETRIES, diff

#: The steps in order, each with the status it makes.
STEPS = {"download": "downloaded", "transcribe": "transcribed", "chunk": "chunked", "embed": "embedded", "publish": "published"}
#: What a repeated import keeps, of numbers around a date, and how far a number may be off.
NEAR_DAYS, FAR = 120, 30


def import_feed(stored: DataFrame, feed: DataFrame, first_status: str = "new") -> DataFrame:
    """The next snapshot of episodes (guid, audio_url, title, number, published_at, status, in_scope).

    Known episodes take the feed's fields; one whose audio moved (another url without query and fragment)
    starts again.  New ones enter the scope if they are as new as the newest stored, never on a first import.
    """
    newest = stored.agg(F.max("published_at").alias("_newest"))
    old = stored.select(*[F.col(c).alias(f"_{c}") for c in ("guid", "audio_url", "title", "number", "published_at", "status", "in_scope")])
    both = feed.join(old, F.col("guid") == F.col("_guid"), "full_outer").join(F.broadcast(newest))  # one row
    moved = F.col("_guid").isNotNull() & F.col("guid").isNotNull() & ~base_url(F.col("audio_url")).eqNullSafe(base_url(F.col("_audio_url")))
    fresh = F.col("_guid").isNull()
    fields = [F.coalesce(c, f"_{c}").alias(c) for c in ("guid", "audio_url", "title", "number", "published_at")]
    scope = F.when(fresh, F.coalesce(F.col("published_at") >= F.col("_newest"), F.lit(False))).otherwise(F.col("_in_scope"))
    return both.select(*fields, F.when(fresh | moved, first_status).otherwise(F.col("_status")).alias("status"), scope.alias("in_scope"))


def in_sequence(items: DataFrame, key: str = "show", id_col: str = "id", day: str = "day", number: str = "number") -> DataFrame:
    """``items`` (key, id, day as a date, number) with ``near`` (others with a number within NEAR_DAYS) and ``kept``: the number,
    null where two or more others lie near in time and their upper median is over FAR away.

    Days are dealt into stretches of NEAR_DAYS; a row meets its own and the two beside it, not its whole key.
    """
    n = F.unix_date(F.col(day))
    stretch = F.floor(n / NEAR_DAYS)
    rows = items.withColumn("_n", n)
    others = items.where(F.col(number).isNotNull()).select(F.col(key).alias("_k"), F.col(id_col).alias("_i"), n.alias("_m"), F.col(number).alias("_x"), stretch.alias("_s"))
    mine = rows.withColumn("_s2", F.explode(F.array(stretch - 1, stretch, stretch + 1)))
    on = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_s2") == F.col("_s")) & (F.col(id_col) != F.col("_i")) & (F.abs(F.col("_n") - F.col("_m")) <= NEAR_DAYS)
    near = mine.join(others, on).groupBy(F.col(id_col).alias("_id")).agg(F.sort_array(F.collect_list("_x")).alias("_near"))
    out = rows.drop("_n").join(near, F.col(id_col) == F.col("_id"), "left")
    count = F.coalesce(F.size("_near"), F.lit(0))
    off = (count >= 2) & (F.abs(F.col(number) - F.get("_near", F.floor(count / 2).cast("int"))) > FAR)
    return out.withColumn("near", count.cast("bigint")).withColumn("kept", F.when(~F.coalesce(off, F.lit(False)), F.col(number))).drop("_id", "_near")


def advanced(rows: DataFrame, step: str, done: Column) -> DataFrame:
    """Rows after a step: those done take its status and lose their error."""
    return rows.withColumn("status", F.when(done, STEPS[step]).otherwise(F.col("status"))).withColumn("error_step", F.when(~done, F.col("error_step"))).withColumn("retries", F.when(done, 0).otherwise(F.col("retries")))


def failed(rows: DataFrame, step: str, bad: Column) -> DataFrame:
    """Rows after a step that failed: retries count on while it is the same step."""
    again = F.when(F.col("error_step") == step, F.col("retries")).otherwise(0) + 1
    return rows.withColumn("retries", F.when(bad, again).otherwise(F.col("retries"))).withColumn("error_step", F.when(bad, step).otherwise(F.col("error_step"))).withColumn("status", F.when(bad, "error").otherwise(F.col("status")))


def parked(rows: DataFrame) -> DataFrame:
    """Rows that failed too often to be tried again."""
    return rows.where((F.col("status") == "error") & (F.col("retries") >= RETRIES))


def recut(stored: DataFrame, new: DataFrame, keys: tuple[str, str] = ("episode", "seq"), values: tuple[str, ...] = ("text",)) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, changes) of the passages of the episodes in ``new``.

    Passages keep their ids by (episode, seq); those past an episode's new end go, those of other episodes
    stay, and equal ones count as the same.
    """
    mine = stored.join(new.select(keys[0]).distinct(), keys[0], "left_semi")
    changes = diff(mine.select(*keys, *values), new.select(*keys, *values), list(keys), list(values)).where("change <> 'same'")
    touched = changes.select(*keys)
    return stored.join(touched, list(keys), "left_anti").unionByName(new.join(touched, list(keys), "left_semi"), allowMissingColumns=True), changes


def requeued(episodes: DataFrame, changes: DataFrame, key: str = "episode") -> DataFrame:
    """Episodes whose passages changed go back from embedded or published to chunked."""
    hit = changes.select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    rows = episodes.join(hit, F.col(key) == F.col("_k"), "left")
    back = F.col("_hit") & F.col("status").isin("embedded", "published")
    return rows.withColumn("status", F.when(F.coalesce(back, F.lit(False)), "chunked").otherwise(F.col("status"))).drop("_k", "_hit")


def flipped(old: DataFrame, new: DataFrame, run: str = "run") -> DataFrame:
    """Runs that became shared or stopped being so."""
    a, b = old.select(run).distinct(), new.select(run).distinct()
    return a.join(b, run, "left_anti").union(b.join(a, run, "left_anti"))


def holding(runs: DataFrame, some: DataFrame, run: str = "run") -> DataFrame:
    """Episodes (id) that hold any of some runs."""
    return runs.join(some.select(run), run, "left_semi").select("id").distinct()


def only_changed(stored: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows of ``new`` that differ from the stored ones, null-safe, or are not stored."""
    old = stored.select(F.col(key).alias("_key"), F.struct(*columns).alias("_old"))
    return new.join(old, F.col(key) == F.col("_key"), "left").where(F.col("_old").isNull() | ~F.struct(*columns).eqNullSafe(F.col("_old"))).drop("_key", "_old")


def statements(rows: Iterable[tuple], most_values: int = 100, most_bytes: int = 50_000) -> Iterator[list[tuple]]:
    """Rows in batches of at most so many values and bytes, one row at least."""
    batch: list[tuple] = []
    values = size = 0
    for row in rows:
        bytes_ = sum(len(str(v).encode()) for v in row)
        if batch and (values + len(row) > most_values or size + bytes_ > most_bytes):
            yield batch
            batch, values, size = [], 0, 0
        batch.append(row)
        values, size = values + len(row), size + bytes_
    if batch:
        yield batch


def publish(spark: SparkSession, path: str, passages: DataFrame, digests: DataFrame, version: str) -> DataFrame:
    """Publish a snapshot: its folder is written whole before the pointer names it, so readers see one version.

    Gives the rows (key, digest, version) of the ledger; a second run with the same digests publishes nothing.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    now = published(spark, path)
    if now is not None:
        ledger = spark.read.parquet(f"{path}/{now}/ledger")
        keys = digests.columns
        if digests.exceptAll(ledger.select(*keys)).isEmpty() and ledger.select(*keys).exceptAll(digests).isEmpty():
            return ledger
    passages.write.mode("overwrite").parquet(f"{path}/{version}/passages")
    digests.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/{version}/ledger")
    temp, final = jvm.org.apache.hadoop.fs.Path(f"{path}/.current-{version}"), jvm.org.apache.hadoop.fs.Path(f"{path}/current-{version}")
    out = fs.create(temp, True)
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()
    fs.rename(temp, final)
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("current-") and name != f"current-{version}":
            fs.delete(status.getPath(), False)
    return spark.read.parquet(f"{path}/{version}/ledger")


def published(spark: SparkSession, path: str) -> str | None:
    """The published version's name; the last in order where a pointer was left over."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    if not fs.exists(folder):
        return None
    names = sorted(n for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n.startswith("current-"))
    return names[-1].removeprefix("current-") if names else None


def counted(counters: DataFrame, events: DataFrame, budget: int, day: str = "day") -> DataFrame:
    """The next counters (day, smart, alerted_half, alerted_full) with ``alert``: half or full where an alert is due, each once a day."""
    more = events.groupBy(day).agg(F.count("*").alias("_more"))
    rows = counters.join(more, day, "full_outer")
    n = F.coalesce("smart", F.lit(0)) + F.coalesce("_more", F.lit(0))
    half, full = (F.coalesce(c, F.lit(False)) for c in ("alerted_half", "alerted_full"))
    over, near = (n > budget) & ~full, (n >= -(-budget // 2)) & (n <= budget) & ~half
    return rows.select(day, n.cast("bigint").alias("smart"), (half | near).alias("alerted_half"), (full | over).alias("alerted_full"), F.when(over, "full").when(near, "half").alias("alert"))


def accepted(reports: DataFrame, passages: DataFrame) -> DataFrame:
    """Reports on passages that exist, and those on none."""
    return reports.where("chunk_id IS NULL").unionByName(reports.join(passages.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").select(*reports.columns))


def decided(reports: DataFrame, report_id: int, status: str) -> DataFrame:
    """Reports with one report's status set; an unknown status is an error."""
    if status not in ("open", "resolved", "rejected"):
        raise ValueError(f"unknown status {status!r}")
    return reports.withColumn("status", F.when(F.col("id") == report_id, status).otherwise(F.col("status")))


def new_since(reports: DataFrame, after: int, most: int = 50) -> DataFrame:
    return reports.where((F.col("id") > after) & (F.col("status") == "open")).orderBy("id").limit(most)


def with_passages(reports: DataFrame, passages: DataFrame, episodes: DataFrame) -> DataFrame:
    """Reports beside the passage and episode they are about, where those still exist."""
    p = passages.select(F.col("id").alias("_p"), F.col("episode").alias("_e"), "start_ms")
    e = episodes.select(F.col("id").alias("_id"), "title")
    return reports.join(p, F.col("chunk_id") == F.col("_p"), "left").join(e, F.col("_e") == F.col("_id"), "left").drop("_p", "_id").withColumnRenamed("_e", "episode")


def errors_since(episodes: DataFrame, at: Column) -> DataFrame:
    return episodes.where((F.col("status") == "error") & (F.col("failed_at") >= at)).orderBy("failed_at", "id")


def published_since(publications: DataFrame, passages: DataFrame, at: Column) -> DataFrame:
    """Episodes published from a time on, with how many passages each has."""
    some = publications.where(F.col("published_at") >= at)
    sizes = passages.join(some.select("episode").distinct(), "episode", "left_semi").groupBy("episode").agg(F.count("*").alias("passages"))
    return some.join(sizes, "episode", "left").withColumn("passages", F.coalesce("passages", F.lit(0)))


def flagged(episodes: DataFrame) -> DataFrame:
    """Episodes with flags, oldest first."""
    return episodes.where(F.size("flags") > 0).orderBy("published", "id")


def flagged_counts(episodes: DataFrame) -> DataFrame:
    some = episodes.where(F.size("flags") > 0)
    return some.agg(F.count("*").alias("flagged"), F.count("reviewed_at").alias("reviewed"), F.count(F.when(F.col("reviewed_at").isNull(), 1)).alias("to_review"))


def next_flagged(episodes: DataFrame) -> DataFrame:
    return episodes.where((F.size("flags") > 0) & F.col("reviewed_at").isNull()).orderBy("published", "id").limit(1)


def menu(episodes: DataFrame) -> DataFrame:
    """The episodes with a transcript, newest first, and whether each is flagged and reviewed."""
    rows = episodes.where(F.coalesce("transcript_path", F.lit("")) != "").orderBy(F.desc("published"), F.desc("id"))
    return rows.select("id", "number", "title", F.date_format("published", "yyyy-MM-dd").alias("date"), (F.size("flags") > 0).alias("flagged"), F.col("reviewed_at").isNotNull().alias("reviewed"))


def version_of(meta: DataFrame, key: str = "corpus_version") -> str:
    """One value of the small key-value table; missing is an error."""
    rows = meta.where(F.col("key") == key).limit(1).collect()  # a row
    if not rows:
        raise LookupError(f"no {key}")
    return rows[0]["value"]


def pull_start(newest: datetime | None, now: datetime, stale_days: int = 80, kept_days: int = 92) -> datetime:
    """Where the next pull begins: a day before the newest stored, no further back than is still kept."""
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if newest is None:
        return midnight - timedelta(days=kept_days)
    return max(newest.replace(hour=0, minute=0, second=0, microsecond=0) - timedelta(days=1), midnight - timedelta(days=stale_days))


def pulled(fetch, start: datetime, end: datetime, cap: int = 10_000) -> Iterator[list]:
    """Points a day at a time; a day that hits the cap by the hour, and an hour that does is an error.

    ``fetch(a, b)`` gives the points of [a, b), at most ``cap``.
    """
    day = start
    while day < end:
        rows = fetch(day, day + timedelta(days=1))
        if len(rows) >= cap:
            rows = []
            for hour in (day + timedelta(hours=h) for h in range(24)):
                part = fetch(hour, hour + timedelta(hours=1))
                if len(part) >= cap:
                    raise RuntimeError(f"the hour from {hour} holds {cap} points or more")
                rows += part
        yield rows
        day += timedelta(days=1)


def best_copies(copies: DataFrame, feed_s: str = "feed_s", seconds: str = "seconds") -> DataFrame:
    """Of each episode's whole copies the shortest, which has fewest advertisements put in."""
    from ..functions.links import inserted_ads, whole_copy

    some = copies.where(whole_copy(F.col(seconds), F.col(feed_s)))
    out = some.groupBy("episode").agg(F.min(F.struct(seconds, "copy", feed_s)).alias("b"))
    return out.select("episode", "b.copy", F.col(f"b.{seconds}").alias(seconds), inserted_ads(F.col(f"b.{seconds}"), F.col(f"b.{feed_s}")).alias("ads"))


def centres(rows: DataFrame, order: list, k: int, key: str = "episode") -> DataFrame:
    """The middle row of each of k equal slices, and the middle passage of each episode picked (key, seq)."""
    from .ordered import numbered

    ids = numbered(rows.select(key, *order).distinct(), [*order, key], "_rn")
    total = ids.agg(F.count("*").alias("_n"))
    picks = rows.sparkSession.range(k).join(F.broadcast(total)).select((F.floor((F.col("id") + 0.5) * F.col("_n") / k) + 1).alias("_rn")).distinct()
    return ids.join(F.broadcast(picks), "_rn", "left_semi").select(key)


def middles(passages: DataFrame, key: str = "episode", order: str = "seq") -> DataFrame:
    """The middle passage of each key."""
    w = Window.partitionBy(key)
    rows = passages.withColumn("_rn", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w))
    return rows.where(F.col("_rn") == F.floor(F.col("_n") / 2) + 1).drop("_rn", "_n")


def sampled(rows: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows by a seeded hash of their ids: the same rows each time, any n rows as likely."""
    return rows.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n)


def frozen(df: DataFrame, name: str) -> DataFrame:
    return write_table(df, name)
