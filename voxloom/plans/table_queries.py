"""Analytics, evaluation and publishing queries over events, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation, logs, publish, reporting
from .catalog import query, table

PTS = """SELECT event_id, event_type AS mode, ts, value AS ms, json_extract_string(props, '$.k')::INT AS k, CASE WHEN event_id % 4 = 0 THEN 5.0 ELSE 1.0 END AS sample,
 CASE WHEN user_id % 2 = 0 THEN 'hit' ELSE 'miss' END AS cache, CASE WHEN event_id % 2 = 0 THEN ' Query  ' ELSE 'query ' END || (json_extract_string(props, '$.k')::INT % 7) AS q,
 CASE WHEN event_id % 50 = 0 THEN 500 WHEN event_id % 50 = 1 THEN 429 ELSE 200 END AS status FROM events"""


def _points(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    i = F.col("event_id")
    return table(spark, d, "events").select(
        "event_id", F.col("event_type").alias("mode"), "ts", F.col("value").alias("ms"), k.alias("k"), F.when(i % 4 == 0, 5.0).otherwise(1.0).alias("sample"),
        F.when(F.col("user_id") % 2 == 0, "hit").otherwise("miss").alias("cache"), F.concat(F.when(i % 2 == 0, " Query  ").otherwise("query "), k % 7).alias("q"),
        F.when(i % 50 == 0, 500).when(i % 50 == 1, 429).otherwise(200).alias("status"),
    )


@query(f"SELECT mode, status, round(sum(sample), 6) AS weight, count(*) AS n FROM ({PTS}) GROUP BY mode, status")
def mode_status_counts(spark, d):
    return reporting.weighted_counts(_points(spark, d), ["mode", "status"]).withColumn("weight", F.round("weight", 6))


@query(
    f"""WITH p AS ({PTS}), b AS (SELECT trim(regexp_replace(lower(q), '\\s+', ' ', 'g')) AS key, q, sum(sample) AS w, sum(sample * k) AS r FROM p GROUP BY ALL)
 SELECT key, arg_min(q, (-w, q)) AS label, sum(w) AS weight, round(sum(r) / sum(w), 9) AS mean_results FROM b GROUP BY key"""
)
def analytics_groups(spark, d):
    return logs.spellings(_points(spark, d), "q", "sample", "k").withColumn("mean_results", F.round("mean_results", 9))


@query(
    f"""WITH p AS ({PTS}), b AS (SELECT mode, cache, ms, sum(sample) AS w FROM p GROUP BY ALL),
 r AS (SELECT *, sum(w) OVER (PARTITION BY mode, cache ORDER BY ms) AS run, sum(w) OVER (PARTITION BY mode, cache) AS tot FROM b)
 SELECT mode, cache, min(ms) FILTER (run >= 0.5 * tot) AS p50, min(ms) FILTER (run >= 0.95 * tot) AS p95 FROM r GROUP BY mode, cache"""
)
def analytics_p50_p95(spark, d):
    rows = _points(spark, d)
    half, high = (logs.weighted_percentile(rows, ["mode", "cache"], "ms", "sample", s) for s in (0.5, 0.95))
    return half.withColumnRenamed("p", "p50").join(high.withColumnRenamed("p", "p95"), ["mode", "cache"])


@query(f"SELECT trim(regexp_replace(lower(q), '\\s+', ' ', 'g')) AS q, sum(sample) AS weight FROM ({PTS}) WHERE status = 200 AND k = 0 GROUP BY 1 ORDER BY weight DESC, q LIMIT 10")
def zero_results_top(spark, d):
    return reporting.without_results(_points(spark, d).withColumn("results", F.col("k")), 10)


@query(f"SELECT status, event_id, q FROM ({PTS}) WHERE status <> 200 QUALIFY row_number() OVER (PARTITION BY status ORDER BY event_id) <= 3")
def status_error_examples(spark, d):
    return reporting.examples(_points(spark, d).where("status <> 200"), "status", "event_id").select("status", "event_id", "q")


@query(
    """WITH r AS (SELECT ts::DATE AS day, event_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS n FROM events)
 SELECT day::VARCHAR AS day, count(*) AS n, min(event_id) FILTER (n BETWEEN 15 AND 30) AS half_at, arg_min(event_id, n) FILTER (n > 30) AS full_at FROM r GROUP BY day"""
)
def usage_daily_threshold(spark, d):
    return logs.daily_crossings(table(spark, d, "events"), "ts", 30).withColumn("day", F.col("day").cast("string"))


@query("SELECT count(*) AS episodes, max(o_orderdate) AS newest, count(DISTINCT o_custkey) AS shows FROM orders")
def corpus_info(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("episodes"), F.max("o_orderdate").alias("newest"), F.countDistinct("o_custkey").alias("shows"))


@query("SELECT o_orderstatus AS status, count(*) AS n, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS flagged FROM orders GROUP BY 1")
def status_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count(F.when(F.col("o_totalprice") > 100000, 1)).alias("flagged"))


_LINE = "sha256(concat_ws(chr(31), l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_shipdate::VARCHAR))"
_DIG = f"SELECT l_orderkey, sha256(string_agg({_LINE}, '' ORDER BY l_linenumber, {_LINE})) AS digest FROM lineitem GROUP BY l_orderkey"


def _digests(spark, d):
    rows = table(spark, d, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("string"))
    return publish.digests(rows, "l_orderkey", ["l_linenumber"], ["l_orderkey", "l_linenumber", "l_shipdate"])


@query(_DIG)
def content_digest(spark, d):
    return _digests(spark, d)


@query(f"WITH g AS ({_DIG}) SELECT * FROM g WHERE l_orderkey % 5 IN (0, 1)")
def due_digest(spark, d):
    """Against a ledger without keys of remainder 0 and with old digests for remainder 1."""
    now = _digests(spark, d)
    ledger = now.where("l_orderkey % 5 <> 0").withColumn("digest", F.when(F.col("l_orderkey") % 5 == 1, "old").otherwise(F.col("digest")))
    return publish.due(now, ledger, "l_orderkey")


@query(
    """WITH s AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 7 <> 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 11 <> 0)
 SELECT coalesce(s.k, n.k) AS k, CASE WHEN s.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN 'delete' WHEN s.v IS NOT DISTINCT FROM n.v THEN 'same' ELSE 'update' END AS change FROM s FULL JOIN n ON s.k = n.k"""
)
def diff_publish(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    new = o.where("k % 11 <> 0").withColumn("v", F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("v")))
    return publish.diff(o.where("k % 7 <> 0"), new, ["k"], ["v"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def stale_ids(spark, d):
    return publish.stale(table(spark, d, "orders"), table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query(
    """WITH e AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'chunked' WHEN 'F' THEN 'error' ELSE 'embedded' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'embed' ELSE 'chunk' END AS error_step, o_custkey % 5 AS retries FROM orders)
 SELECT o_orderkey FROM e WHERE status = 'chunked' OR (status = 'error' AND error_step = 'embed' AND retries < 3)"""
)
def step_eligibility(spark, d):
    s = F.when(F.col("o_orderstatus") == "O", "chunked").when(F.col("o_orderstatus") == "F", "error").otherwise("embedded")
    e = table(spark, d, "orders").select("o_orderkey", s.alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "embed").otherwise("chunk").alias("error_step"), (F.col("o_custkey") % 5).alias("retries"))
    return publish.eligible(e, "chunked", "embed").select("o_orderkey")


@query("SELECT event_id FROM events WHERE contains(event_type, 'e') AND ts >= TIMESTAMP '2024-01-15' AND json_extract_string(props, '$.k')::INT >= 30")
def log_filter(spark, d):
    return table(spark, d, "events").where(F.col("event_type").contains("e") & (F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")) & (F.get_json_object("props", "$.k").cast("int") >= 30)).select("event_id")


@query("SELECT DISTINCT sha256(text)[1:16] AS text_sha FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL)")
def embedding_cache_missing(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    cache = docs.where("doc_id % 3 = 0").select(T.text_sha(F.col("text")).alias("text_sha"))
    return publish.missing_embeddings(docs, cache).select("text_sha")


ITEMS = """items AS (SELECT user_id % 40 AS case_id, event_id AS ord, user_id AS episode, CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) // 1000 END AS at_ms FROM events),
 answers AS (SELECT user_id % 40 AS case_id, CASE WHEN event_id % 2 = 0 THEN 'exact' ELSE 'related' END AS mode, user_id AS episode, epoch_us(ts) // 1000 + 20000 AS hit_ms,
  row_number() OVER (PARTITION BY user_id % 40, event_id % 2 ORDER BY value DESC, event_id) AS rank FROM events),
 top AS (SELECT * FROM answers WHERE rank <= 10), n AS (SELECT case_id, count(*) AS n, count(at_ms) AS timed FROM items GROUP BY 1),
 f AS (SELECT i.case_id, i.ord, t.rank, i.at_ms, t.hit_ms FROM items i JOIN top t USING (case_id, episode)),
 r AS (SELECT case_id, count(DISTINCT ord) AS hits, min(rank) AS best, count(DISTINCT ord) FILTER (abs(hit_ms - at_ms) <= 45000) AS near FROM f GROUP BY 1),
 g AS (SELECT t.*, row_number() OVER (PARTITION BY case_id, mode, episode ORDER BY rank) AS k FROM top t),
 dc AS (SELECT case_id, max(d) AS dcg FROM (SELECT case_id, mode, sum(1 / log2(rank + 1)) AS d FROM g JOIN (SELECT case_id, episode, count(*) AS w FROM items GROUP BY ALL) USING (case_id, episode) WHERE k <= w GROUP BY ALL) GROUP BY 1),
 sc AS (SELECT n.case_id, coalesce(hits, 0) / n AS recall, coalesce(1.0 / best, 0) AS mrr, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg,
  CASE WHEN timed > 0 THEN coalesce(near, 0) / timed END AS time_hit FROM n LEFT JOIN r USING (case_id) LEFT JOIN dc USING (case_id))"""


def _scores(spark, d):
    from pyspark.sql.window import Window

    e = table(spark, d, "events").select("event_id", "user_id", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    case = (F.col("user_id") % 40).alias("case_id")
    items = e.select(case, F.col("event_id").alias("ord"), F.col("user_id").alias("episode"), F.when(F.col("event_id") % 3 != 0, F.col("ms")).alias("at_ms"))
    rank = F.row_number().over(Window.partitionBy(F.col("user_id") % 40, F.col("event_id") % 2).orderBy(F.desc("value"), "event_id"))
    mode = F.when(F.col("event_id") % 2 == 0, "exact").otherwise("related")
    answers = e.select(case, mode.alias("mode"), F.col("user_id").alias("episode"), (F.col("ms") + 20000).alias("hit_ms"), rank.alias("rank"))
    return evaluation.score_cases(items, answers)


def _tags(spark):
    return spark.range(40).select(F.col("id").alias("case_id"), F.when(F.col("id") % 3 == 0, "jargon").otherwise("exact").alias("tag"))


@query(f"WITH {ITEMS} SELECT case_id, round(recall, 9) AS recall, round(mrr, 9) AS mrr, round(ndcg, 9) AS ndcg, round(time_hit, 9) AS time_hit FROM sc")
def eval_recall_mrr_ndcg(spark, d):
    return _rounded(_scores(spark, d))


def _rounded(scores):
    return scores.select("case_id", *[F.round(c, 9).alias(c) for c in ("recall", "mrr", "ndcg", "time_hit")])


_TAG = "(SELECT *, CASE WHEN case_id % 3 = 0 THEN 'jargon' ELSE 'exact' END AS tag FROM sc)"


@query(f"WITH {ITEMS} SELECT tag, round_even(avg(recall), 4) AS recall, round_even(avg(mrr), 4) AS mrr, round_even(avg(ndcg), 4) AS ndcg, round_even(avg(time_hit), 4) AS time_hit, count(*) AS cases FROM {_TAG} GROUP BY ROLLUP (tag)")
def eval_rollup(spark, d):
    return evaluation.summary(_scores(spark, d), _tags(spark))


@query(
    f"""WITH {ITEMS}, m AS (SELECT tag, round_even(avg(mrr), 4) AS v FROM {_TAG} GROUP BY ROLLUP (tag)) SELECT tag, 'mrr' AS metric, round(v + 0.05, 6) AS was, round(v, 6) AS is_now FROM m"""
)
def eval_regressions(spark, d):
    return _regressed(evaluation.summary(_scores(spark, d), _tags(spark)))


def _regressed(now):
    out = evaluation.regressions(now, now.withColumn("mrr", F.col("mrr") + 0.05).withColumn("recall", F.col("recall") + 0.01))
    return out.select("tag", "metric", F.round("was", 6).alias("was"), F.round("is_now", 6).alias("is_now"))


@query("SELECT page_id, regexp_replace(url, '[?#].*$', '') AS base, CASE WHEN page_id >= 3600 THEN page_id // 3600 || ':' || lpad((page_id // 60 % 60)::VARCHAR, 2, '0') ELSE (page_id // 60)::VARCHAR END || ':' || lpad((page_id % 60)::VARCHAR, 2, '0') AS clock FROM pages")
def url_and_clock(spark, d):
    return _url_clock(table(spark, d, "pages"))


def _url_clock(pages):
    return pages.select("page_id", T.base_url(F.col("url")).alias("base"), T.clock(F.col("page_id")).alias("clock"))


@query(
    """WITH s AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '-') AS s FROM part)
 SELECT p_partkey, CASE WHEN s = '' THEN 'untitled' WHEN length(s) <= 60 THEN s ELSE regexp_replace(s[1:61], '-[^-]*$', '')[1:60] END AS slug FROM s"""
)
def title_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))
