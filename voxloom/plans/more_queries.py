"""Further queries: overlap trimming, selectors, claims, pivots, quantiles, retro-classification."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import alignment, lifecycle, logs, publish, reporting, selection
from .catalog import query, table

_WORDS = "SELECT conv_id AS episode, turn AS seq, string_split(coalesce(text, ''), ' ') AS words FROM conversations"


@query(f"""WITH p AS ({_WORDS}), q AS (SELECT *, lead(words) OVER w AS nx, lead(seq) OVER w AS ns FROM p WINDOW w AS (PARTITION BY episode ORDER BY seq)),
 k AS (SELECT *, unnest(range(1, least(len(words), len(nx)) + 1)) AS k FROM q WHERE ns = seq + 1)
 SELECT q.episode, q.seq, coalesce(max(k) FILTER (k.words[len(k.words) - k + 1:] = k.nx[1:k]), 0)::INT AS shared
 FROM q LEFT JOIN k ON k.episode = q.episode AND k.seq = q.seq GROUP BY q.episode, q.seq""")
def overlap_dedup(spark, d):
    """Words that end a passage and begin the next."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("episode"), F.col("turn").alias("seq"), F.split(F.coalesce("text", F.lit("")), " ").alias("words"))
    return alignment.shared_tail(rows).select("episode", "seq", "shared")


_EP = "SELECT o_orderkey AS id, o_orderdate AS published, year(o_orderdate::DATE) AS year, o_custkey AS number, o_orderstatus AS stem, o_orderkey % 3 = 0 AS in_scope FROM orders"


def _episodes(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("published"), F.year(F.to_date("o_orderdate")).alias("year"), F.col("o_custkey").alias("number"), F.col("o_orderstatus").alias("stem"), (F.col("o_orderkey") % 3 == 0).alias("in_scope"))


@query(
    f"""WITH e AS ({_EP}), o AS (SELECT id, row_number() OVER (ORDER BY published, id) - 1 AS rn, count(*) OVER () AS m FROM e WHERE NOT in_scope)
 SELECT id FROM e WHERE number = 17 UNION SELECT id FROM (SELECT id FROM e ORDER BY published DESC, id DESC LIMIT 9)
 UNION SELECT id FROM o WHERE rn IN (SELECT round_even((i + 0.5) * m / 6.0, 0) FROM range(6) t(i), (SELECT any_value(m) AS m FROM o))"""
)
def selector_union(spark, d):
    return selection.select(_episodes(spark, d), "ep:17,recent:9,spread:6").select("id")


@query(
    f"""WITH e AS ({_EP}), w AS (SELECT id FROM e WHERE id % 5 = 0 UNION SELECT -1)
 SELECT coalesce(e.id, w.id) AS id, CASE WHEN e.id IS NULL THEN 'unknown' WHEN w.id IS NOT NULL AND NOT in_scope THEN 'added' ELSE 'removed' END AS change
 FROM e FULL JOIN w ON e.id = w.id WHERE e.id IS NULL OR (w.id IS NOT NULL AND NOT in_scope) OR (w.id IS NULL AND in_scope)"""
)
def scope_changes(spark, d):
    e = _episodes(spark, d)
    return selection.scope_changes(e, e.where("id % 5 = 0").select("id").union(spark.range(1).select(F.lit(-1).cast("bigint").alias("id"))), "id")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey <= 500, o_orderkey LIMIT 1")
def next_undecided_circular(spark, d):
    return selection.next_after(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500)


@query("WITH m AS (SELECT o_orderkey AS k, o_custkey AS claim FROM orders) SELECT k, claim FROM m WHERE claim NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0) QUALIFY count(*) OVER (PARTITION BY claim) = 1")
def duplicate_claims_dropped(spark, d):
    return _unclaimed(spark, d, table(spark, d, "orders"))


def _unclaimed(spark, d, orders):
    m = orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("claim"))
    held = table(spark, d, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("claim"))
    return selection.unclaimed_twice(m, held, "claim").select("k", "claim")


@query("SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY 1")
def rule_audit_pivot(spark, d):
    p = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return p.select("priority", *[F.coalesce(a, F.lit(0)).alias(b) for a, b in (("F", "failed"), ("O", "open"), ("P", "pending"))])


@query(
    """WITH d AS (SELECT event_type, value - lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS delta FROM events),
 r AS (SELECT event_type, abs(delta) AS v, row_number() OVER (PARTITION BY event_type ORDER BY abs(delta)) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM d WHERE delta IS NOT NULL)
 SELECT event_type, round(min(v) FILTER (rn >= ceil(0.99 * n)), 6) AS p99, round(min(v) FILTER (rn >= ceil(0.5 * n)), 6) AS median FROM r GROUP BY 1"""
)
def timing_quantiles(spark, d):
    delta = F.col("value") - F.lag("value").over(Window.partitionBy("event_type").orderBy("event_id"))
    rows = table(spark, d, "events").select("event_type", F.abs(delta).alias("v")).where("v IS NOT NULL").withColumn("one", F.lit(1))
    high, mid = (logs.weighted_percentile(rows, ["event_type"], "v", "one", s) for s in (0.99, 0.5))
    return high.select("event_type", F.round("p", 6).alias("p99")).join(mid.select("event_type", F.round("p", 6).alias("median")), "event_type")


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'pipeline' WHEN json_extract_string(props, '$.k')::INT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 9) THEN 'eval' ELSE 'web' END AS traffic FROM events"""
)
def traffic_retro_classify(spark, d):
    known = table(spark, d, "nation").where("n_nationkey < 9").select(F.col("n_nationkey").alias("k"), F.lit(True).alias("hit"))
    rows = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).join(known, "k", "left")
    return rows.select("event_id", F.when(F.col("event_type") == "error", "pipeline").when(F.col("hit"), "eval").otherwise("web").alias("traffic"))


@query("SELECT event_id, ts::VARCHAR AS ts FROM (SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-20' AND event_id % 2 = 0 UNION ALL SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20')")
def window_replace(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    out = logs.window_replace(e.where("event_id % 2 = 0"), e, "ts", F.lit("2024-01-20").cast("timestamp_ntz"))
    return out.withColumn("ts", F.regexp_replace(F.col("ts").cast("string"), r"(\.\d*?)0+$", "$1"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'new' ELSE o_orderstatus END AS v FROM orders UNION ALL SELECT -9, 'new'")
def upsert_snapshot(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("v"))
    new = o.where("o_orderkey % 9 = 0").select("o_orderkey", F.lit("new").alias("v")).union(spark.range(1).select(F.lit(-9).cast("bigint"), F.lit("new")))
    return publish.upsert(o, new, "o_orderkey")


@query("SELECT page_id FROM pages WHERE regexp_replace(url, '[?#].*$', '') <> regexp_replace(url || CASE WHEN page_id % 4 = 0 THEN '/x' ELSE '?y' END, '[?#].*$', '')")
def moved_keys(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    feed = p.withColumn("url", F.concat("url", F.when(F.col("page_id") % 4 == 0, "/x").otherwise("?y")))
    return publish.moved_keys(p, feed, "page_id", "url").select("page_id")


@query(
    """WITH w AS (SELECT lower(u) AS word, i % 4 = 0 AS low FROM (SELECT unnest(string_split(text, ' ')) AS u, unnest(range(len(string_split(text, ' ')))) AS i FROM conversations WHERE text IS NOT NULL))
 SELECT word, count(*) AS uses, count(*) FILTER (low) AS low FROM w GROUP BY word HAVING count(*) FILTER (low) >= 2 AND count(*) FILTER (low) >= 0.25 * count(*)"""
)
def suspect_words(spark, d):
    w = table(spark, d, "conversations").select(F.posexplode(F.split("text", " ")).alias("i", "u"))
    return reporting.suspects(w, "u", F.col("i") % 4 == 0)


@query("SELECT count(*) AS n, count(o_orderpriority) AS with_priority, count(CASE WHEN o_orderkey % 3 = 0 THEN 1 END) AS with_third FROM orders")
def platform_summary(spark, d):
    o = table(spark, d, "orders")
    return o.agg(F.count("*").alias("n"), F.count("o_orderpriority").alias("with_priority"), F.count(F.when(F.col("o_orderkey") % 3 == 0, 1)).alias("with_third"))


@query(
    """SELECT e.event_id, c.c_name, n.n_name FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey"""
)
def reports_left_joins(spark, d):
    return _reports(spark, d, table(spark, d, "events"))


def _reports(spark, d, e):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return e.join(c, F.col("user_id") == F.col("c_custkey"), "left").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("event_id", "c_name", "n_name")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_anti_exclusion(spark, d):
    docs, lab = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    return docs.join(lab.where("quality = 1"), "doc_id", "left_semi").join(lab.where("toxic = 1"), "doc_id", "left_anti")


@query("SELECT event_id, CASE WHEN value >= 3600 THEN floor(value)::INT // 3600 || ':' || lpad((floor(value)::INT // 60 % 60)::VARCHAR, 2, '0') ELSE (floor(value)::INT // 60)::VARCHAR END || ':' || lpad((floor(value)::INT % 60)::VARCHAR, 2, '0') AS clock, strftime(ts, '%b ') || day(ts) || ', ' || year(ts) AS date FROM events")
def clock_and_date_formats(spark, d):
    return _clock_date(table(spark, d, "events"))


def _clock_date(e):
    return e.select("event_id", T.clock(F.floor("value")).alias("clock"), F.date_format("ts", "MMM d, yyyy").alias("date"))
