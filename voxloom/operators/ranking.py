"""Ranking: exact vector neighbours, rank fusion, rerank order, greedy collapse, cards, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cosine
from .ordered import numbered

RRF_K = 60


def nearest(vectors: DataFrame, query: list[float], k: int = 50, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (id, score): the k best by cosine, ties by id.  One pass, top-k per task, no sort of all."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.select(F.col(id_col).alias("id"), F.round(cosine(F.col(vector), q), 9).alias("score")).where("score IS NOT NULL")
    return rows.orderBy(F.desc("score"), "id").limit(k)


def fuse(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (list_no, rank, id): rows (id, score, first), best first.

    An id counts once per list, at its best rank; ties go to whoever appears first, lists in order.
    """
    once = lists.groupBy("list_no", "id").agg(F.min("rank").alias("rank"))
    place = F.min(F.struct("list_no", "rank")).alias("first")
    out = once.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), place)
    return out.orderBy(F.desc(F.round("score", 12)), "first")


def rerank_order(scored: DataFrame) -> DataFrame:
    """(id, rank, score or null): valid scores first, best first; the rest keep their order."""
    valid = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    rows = scored.withColumn("_none", valid.isNull()).withColumn("_valid", valid)
    return numbered(rows, [F.col("_none").asc(), F.col("_valid").desc(), F.col("rank").asc()], "new_rank").drop("_none", "_valid")


def collapse(hits: DataFrame, within_ms: int = 120_000) -> DataFrame:
    """Greedy collapse of (episode, rank, hit_ms, id): rows (episode, id, rank, hit_ms, folded).

    In rank order a hit folds into the first kept hit of its episode closer than ``within_ms``; only
    kept hits attract, so there is no chaining.  Sequential inside an episode; a list has 200 hits at most.
    """
    ordered = hits.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("rank", "hit_ms", "id"))).alias("h"))
    kept = "array<struct<rank:bigint,hit_ms:bigint,id:bigint,folded:array<bigint>>>"
    near = f"abs(y.hit_ms - x.hit_ms) < {within_ms}"
    fold = (
        f"aggregate(h, CAST(array() AS {kept}), (a, x) -> IF(exists(a, y -> {near}), "
        f"transform(a, (y, i) -> IF(i = array_position(transform(a, y -> {near}), true) - 1, "
        "named_struct('rank', y.rank, 'hit_ms', y.hit_ms, 'id', y.id, 'folded', concat(y.folded, array(bigint(x.id)))), y)), "
        "concat(a, array(named_struct('rank', bigint(x.rank), 'hit_ms', bigint(x.hit_ms), 'id', bigint(x.id), 'folded', CAST(array() AS array<bigint>))))))"
    )
    rows = ordered.select("episode", F.explode(F.expr(fold)).alias("k"))
    return rows.select("episode", "k.id", "k.rank", "k.hit_ms", "k.folded")


def cards(hits: DataFrame) -> DataFrame:
    """Neighbouring hits of one episode as a card: rows (card, episode, ids by time, first_rank).

    A card is a run in rank order: a hit's place among all less its place in its episode stays the same
    along a run, so runs are found by two numberings and cards are numbered by their first rank.
    """
    rows = numbered(hits, ["rank"], "_all")
    rows = numbered(rows, ["rank"], "_own", ["episode"])
    rows = rows.withColumn("_run", F.col("_all") - F.col("_own"))
    packed = F.array_sort(F.collect_list(F.struct("hit_ms", "id")))
    runs = rows.groupBy("episode", "_run").agg(F.transform(packed, lambda x: x["id"]).alias("ids"), F.min("rank").alias("first_rank"))
    return numbered(runs.drop("_run"), ["first_rank"], "card").select("card", "episode", "ids", "first_rank")


def evenly(rows: DataFrame, order: list, n: int, offset: float = 0.0, last: bool = True) -> DataFrame:
    """``n`` evenly spaced rows: bround((i + offset) * step), step over m - 1 or m."""
    ranked = numbered(rows, order, "_rn").withColumn("_rn", F.col("_rn") - 1)
    m = rows.count()
    step = (m - 1) / max(n - 1, 1) if last else m / n
    picks = rows.sparkSession.range(n if m else 0).select(F.bround((F.col("id") + offset) * F.lit(step), 0).cast("bigint").alias("_rn")).distinct()
    return ranked.join(F.broadcast(picks), "_rn", "left_semi").drop("_rn")


def within_floor(scored: DataFrame, floor: float = 0.62) -> DataFrame:
    return scored.where(F.col("score") >= F.lit(floor))


def hit_time(times: Column, token: Column, start_ms: Column) -> Column:
    return F.coalesce(F.get(times, token), start_ms)
