"""Retrieval evaluation: recall, reciprocal rank, nDCG and time hits of ranked answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOP, NEAR_MS, TOLERANCE = 10, 45_000, 0.02
#: Scope (a tag, or null for all), metric and what it should reach.
TARGETS = ((None, "recall", 0.85), ("paraphrase", "recall", 0.75), (None, "time_hit", 0.8))


def score_cases(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows (case_id, recall, mrr, ndcg, time_hit) from items (case_id, ord, episode, at_ms) and
    answers (case_id, mode, rank, episode, hit_ms).

    The best rank over modes counts; nDCG gives one gain an item, the k-th answer of an episode
    taking its k-th item, and the better mode stands.
    """
    top = answers.where(F.col("rank") <= TOP)
    n = items.groupBy("case_id").agg(F.count("*").alias("n"), F.count("at_ms").alias("timed"))
    found = items.join(top, ["case_id", "episode"])
    recall = found.groupBy("case_id").agg(F.countDistinct("ord").alias("hits"), F.min("rank").alias("best"))
    timely = found.where(F.abs(F.col("hit_ms") - F.col("at_ms")) <= NEAR_MS).groupBy("case_id").agg(F.countDistinct("ord").alias("near"))
    per = items.groupBy("case_id", "episode").agg(F.count("*").alias("wanted"))
    kth = F.row_number().over(Window.partitionBy("case_id", "mode", "episode").orderBy("rank"))
    gains = top.withColumn("k", kth).join(per, ["case_id", "episode"]).where("k <= wanted")
    dcg = gains.groupBy("case_id", "mode").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg")).groupBy("case_id").agg(F.max("dcg").alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(TOP)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    out = n.join(recall, "case_id", "left").join(timely, "case_id", "left").join(dcg, "case_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "case_id", (zero("hits") / F.col("n")).alias("recall"), F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("mrr"),
        (zero("dcg") / ideal).alias("ndcg"), F.when(F.col("timed") > 0, zero("near") / F.col("timed")).alias("time_hit"),
    )


def summary(scores: DataFrame, tags: DataFrame) -> DataFrame:
    """Means per tag and overall (tag null), four places."""
    rows = scores.join(tags, "case_id")
    means = [F.bround(F.avg(c), 4).alias(c) for c in ("recall", "mrr", "ndcg", "time_hit")]
    return rows.rollup("tag").agg(*means, F.count("*").alias("cases"))


def regressions(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rows (tag, metric, was, is) that fell by more than the tolerance."""
    long = lambda df, v: df.select("tag", F.expr(f"stack(4, 'recall', recall, 'mrr', mrr, 'ndcg', ndcg, 'time_hit', time_hit) AS (metric, {v})"))
    a, b = long(now, "is_now"), long(baseline, "was")
    both = a.withColumnRenamed("tag", "t").withColumnRenamed("metric", "m").join(b, F.col("t").eqNullSafe(F.col("tag")) & (F.col("m") == F.col("metric")))
    return both.where(F.col("was") - F.col("is_now") > TOLERANCE + 1e-9).select("tag", "metric", "was", "is_now")


def _matches(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Items (case_id, ord, episode, at_ms) beside the answers of their episode that lie near their time, or any without one."""
    near = F.col("at_ms").isNull() | (F.abs(F.col("hit_ms") - F.col("at_ms")) <= NEAR_MS)
    return items.join(answers, ["case_id", "episode"]).where(near)


def absent_passed(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows (case_id, absent_ok): whether none of a case's ruled-out passages is in the top of any mode."""
    bad = _matches(items, answers.where(F.col("rank") <= TOP)).select("case_id").distinct().withColumn("_bad", F.lit(True))
    return items.select("case_id").distinct().join(bad, "case_id", "left").select("case_id", F.col("_bad").isNull().alias("absent_ok"))


def collapse_passed(items: DataFrame, page: DataFrame) -> DataFrame:
    """Rows (case_id, collapse_ok) of the cases whose items say how many cards an episode has, or how many hits were folded.

    ``page`` (case_id, rank, episode, hit_ms, more_in_episode) is a page of one mode; the first answer that matches counts.
    """
    said = items.where("cards IS NOT NULL OR more_in_episode IS NOT NULL").withColumnRenamed("more_in_episode", "want_more")
    cards = page.groupBy("case_id", "episode").agg(F.count("*").alias("has"))
    first = _matches(said, page).groupBy("case_id", "ord").agg(F.min(F.struct("rank", "more_in_episode"))["more_in_episode"].alias("more"))
    rows = said.join(cards, ["case_id", "episode"], "left").join(first, ["case_id", "ord"], "left")
    fine = F.coalesce(F.coalesce("has", F.lit(0)) == F.col("cards"), F.col("cards").isNull()) & F.when(F.col("want_more").isNull(), True).otherwise(F.coalesce(F.col("more") == F.col("want_more"), F.lit(False)))
    return rows.groupBy("case_id").agg(F.min(fine).alias("collapse_ok"))


def targets(means: DataFrame, wanted=TARGETS) -> DataFrame:
    """Rows (scope, metric, target, value, met) of the ``summary``'s means (tag, recall, mrr, ndcg, time_hit); overall has a null tag."""
    goals = means.sparkSession.createDataFrame([*wanted], "scope string, metric string, target double")
    long = means.select("tag", F.expr("stack(4, 'recall', recall, 'mrr', mrr, 'ndcg', ndcg, 'time_hit', time_hit) AS (m, value)"))
    rows = F.broadcast(goals).join(long, F.col("scope").eqNullSafe(F.col("tag")) & (F.col("metric") == F.col("m")), "right").where("target IS NOT NULL")
    return rows.select("scope", "metric", "target", "value", (F.col("value") >= F.col("target")).alias("met"))


def newly_missed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Ids of cases (case_id, recall, absent_ok) whose recall fell, or whose ruled-out passages came back."""
    old = before.select("case_id", F.col("recall").alias("_r"), F.col("absent_ok").alias("_a"))
    broke = (F.col("recall") < F.col("_r")) | (~F.col("absent_ok") & F.col("_a"))
    return now.join(old, "case_id").where(F.coalesce(broke, F.lit(False))).select("case_id")


def smoke(scores: DataFrame, cases: DataFrame) -> DataFrame:
    """Smoke cases (case_id, smoke) that do not find everything they expect."""
    return scores.join(cases.where("smoke"), "case_id").where(F.col("recall") < 1.0).select("case_id", "recall")


def located(answers: DataFrame, episode: int, at_ms: int | None) -> DataFrame:
    """One row per case: the best rank of a passage, and of its episode."""
    near = F.lit(True) if at_ms is None else F.abs(F.col("hit_ms") - at_ms) <= NEAR_MS
    some = answers.where(F.col("episode") == episode)
    return some.groupBy("case_id").agg(F.min(F.when(near, F.col("rank"))).alias("passage_rank"), F.min("rank").alias("episode_rank"))
