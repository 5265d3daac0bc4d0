"""Episodes' life, platforms, titles, links and reports: orders stand for episodes, events for points, parts and pages for titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import links, titles, words
from ..operators import lifecycle, platforms, publish, reporting, selection
from ..operators import sequences as S
from .catalog import query, table
from .more_queries import _EP, _episodes
from .sequence_queries import RUNS, _islands
from .table_queries import PTS, _points

NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}\s'']+', '', 'g'), '(^|\s)''+|''+($|\s)', '\1\2', 'g'), '\s+', ' ', 'g'))"
ORD = "SELECT o_orderkey AS id, o_custkey AS shw, o_orderdate::DATE AS day, o_orderstatus AS st, o_orderpriority AS pr, o_totalprice AS price FROM orders"


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("show"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr"), F.col("o_totalprice").alias("price"))


@query(
    f"""WITH o AS ({ORD}), s AS (SELECT id::VARCHAR AS guid, 'http://a/' || id || '?x' AS url, 'published' AS status, id % 3 = 0 AS scope, day FROM o WHERE id % 5 <> 0),
 f AS (SELECT id::VARCHAR AS guid, 'http://a/' || CASE WHEN id % 4 = 0 THEN 'new' ELSE '' END || id || '?y' AS url, day FROM o WHERE id % 7 <> 0)
 SELECT coalesce(f.guid, s.guid) AS guid, CASE WHEN s.guid IS NULL OR (f.guid IS NOT NULL AND f.guid::BIGINT % 4 = 0) THEN 'new' ELSE status END AS status,
  CASE WHEN s.guid IS NULL THEN f.day >= (SELECT max(day) FROM s) ELSE scope END AS in_scope FROM f FULL JOIN s ON f.guid = s.guid"""
)
def feed_import(spark, d):
    """Moved audio starts an episode again; new ones as new as the newest stored enter the scope."""
    o = _orders(spark, d).select("id", F.col("id").cast("string").alias("guid"), F.lit("t").alias("title"), F.col("id").alias("number"), F.col("day").alias("published_at"))
    stored = o.where("id % 5 <> 0").withColumn("audio_url", F.concat(F.lit("http://a/"), "id", F.lit("?x"))).withColumn("status", F.lit("published")).withColumn("in_scope", F.col("id") % 3 == 0)
    feed = o.where("id % 7 <> 0").withColumn("audio_url", F.concat(F.lit("http://a/"), F.when(F.col("id") % 4 == 0, "new").otherwise(""), "id", F.lit("?y")))
    return lifecycle.import_feed(stored, feed).select("guid", "status", "in_scope")


@query(
    f"""WITH o AS ({ORD}), s AS (SELECT shw AS episode, row_number() OVER (PARTITION BY shw ORDER BY id) AS seq, pr AS text FROM o),
 n AS (SELECT episode, seq, CASE WHEN (episode + seq) % 3 = 0 THEN 'new' ELSE text END AS text FROM s WHERE episode % 2 = 0 AND seq <= 8)
 SELECT episode, seq, text FROM n UNION ALL SELECT episode, seq, text FROM s WHERE episode NOT IN (SELECT episode FROM n)"""
)
def recut_snapshot(spark, d):
    """Passages past an episode's new end go, changed ones change, other episodes stay."""
    from ..operators.ordered import numbered

    rows = numbered(_orders(spark, d).select(F.col("show").alias("episode"), "id", F.col("pr").alias("text")), ["id"], "seq", ["episode"]).select("episode", F.col("seq").cast("bigint").alias("seq"), "text")
    new = rows.where("episode % 2 = 0 AND seq <= 8").withColumn("text", F.when((F.col("episode") + F.col("seq")) % 3 == 0, "new").otherwise(F.col("text")))
    return lifecycle.recut(rows, new)[0].select("episode", "seq", "text")


@query(
    f"""WITH {RUNS}, o AS (SELECT run FROM (SELECT run, count(DISTINCT id) AS n FROM r WHERE id % 4 <> 0 GROUP BY run) WHERE n >= 5),
 z AS (SELECT run FROM s WHERE run NOT IN (SELECT run FROM o) UNION SELECT run FROM o WHERE run NOT IN (SELECT run FROM s)) SELECT DISTINCT id FROM r SEMI JOIN z USING (run)"""
)
def recut_episodes(spark, d):
    """Episodes that hold a run which a quarter more episodes make shared."""
    runs = lifecycle.frozen(S.word_runs(table(spark, d, "documents"), "doc_id", "text"), "word-runs")
    return lifecycle.holding(runs, lifecycle.flipped(S.shared_runs(runs.where("id % 4 <> 0")), S.shared_runs(runs)))


@query(f"WITH o AS ({ORD}) SELECT id, CASE WHEN id % 6 = 0 AND st IN ('O', 'F') THEN 'chunked' WHEN st = 'O' THEN 'embedded' WHEN st = 'F' THEN 'published' ELSE 'new' END AS status FROM o")
def requeued_after_changes(spark, d):
    o = _orders(spark, d)
    e = o.select("id", F.when(F.col("st") == "O", "embedded").when(F.col("st") == "F", "published").otherwise("new").alias("status"))
    return lifecycle.requeued(e, o.where("id % 6 = 0").select("id"), "id")


@query(f"WITH o AS ({ORD}) SELECT id, CASE WHEN id % 3 = 0 THEN 'embedded' WHEN id % 3 = 1 THEN 'error' ELSE 'chunked' END AS status, CASE WHEN id % 3 = 0 THEN 0 WHEN id % 3 = 1 THEN CASE WHEN id % 2 = 0 THEN shw % 4 ELSE 0 END + 1 ELSE shw % 4 END AS retries FROM o")
def step_transitions(spark, d):
    """Steps done and steps that failed; a failure of another step counts from one."""
    i = F.col("id")
    e = _orders(spark, d).select("id", F.lit("chunked").alias("status"), F.when(i % 2 == 0, "embed").otherwise("chunk").alias("error_step"), (F.col("show") % 4).alias("retries"))
    return lifecycle.failed(lifecycle.advanced(e, "embed", i % 3 == 0), "embed", i % 3 == 1).select("id", "status", "retries")


@query(f"WITH o AS ({ORD}) SELECT id, pr FROM o WHERE id % 9 = 0 OR id % 10 = 0")
def only_changed_rows(spark, d):
    o = _orders(spark, d).select("id", "pr")
    stored = o.where("id % 9 <> 0").withColumn("pr", F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("pr")))
    return lifecycle.only_changed(stored, o, "id", ["pr"])


@query(
    """WITH b AS (SELECT ts::DATE AS day, count(*) AS more FROM events WHERE event_id % 2 = 0 GROUP BY 1), a AS (SELECT ts::DATE AS day, count(*) AS smart FROM events WHERE event_id % 2 = 1 GROUP BY 1),
 n AS (SELECT day, coalesce(smart, 0) + coalesce(more, 0) AS n FROM a FULL JOIN b USING (day))
 SELECT day::VARCHAR AS day, n AS smart, CASE WHEN n > 320 THEN 'full' WHEN n >= 160 THEN 'half' END AS alert FROM n"""
)
def usage_counters(spark, d):
    e = table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"))
    old = e.where("event_id % 2 = 1").groupBy("day").agg(F.count("*").alias("smart")).withColumn("alerted_half", F.lit(False)).withColumn("alerted_full", F.lit(False))
    return lifecycle.counted(old, e.where("event_id % 2 = 0"), 320).select(F.col("day").cast("string").alias("day"), "smart", "alert")


@query("SELECT event_id AS id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END AS chunk_id FROM events WHERE event_id % 13 = 0 OR user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def reports_accepted(spark, d):
    r = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 13 != 0, F.col("user_id")).alias("chunk_id"))
    return lifecycle.accepted(r, table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id")))


@query("SELECT event_id AS id, c_custkey AS episode, n_name AS title FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_custkey = n_nationkey")
def reports_with_passages(spark, d):
    r = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("chunk_id"))
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("episode"), F.lit(0).alias("start_ms"))
    e = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("title"))
    return lifecycle.with_passages(r, p, e).select("id", "episode", "title")


@query("SELECT event_id AS id FROM events WHERE event_id > 700 AND event_id % 2 = 0 ORDER BY 1 LIMIT 50")
def reports_new_since(spark, d):
    r = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "open").otherwise("resolved").alias("status"))
    return lifecycle.new_since(r, 700).select("id")


def _flags(spark, d):
    o = _orders(spark, d)
    return o.select("id", F.col("day").alias("published"), F.col("show").alias("number"), F.col("pr").alias("title"), F.when(F.col("id") % 3 == 0, F.array(F.lit("wpm_low"))).otherwise(F.array().cast("array<string>")).alias("flags"), F.when(F.col("id") % 6 == 0, F.col("day")).alias("reviewed_at"), F.when(F.col("id") % 5 != 0, "x").alias("transcript_path"))


@query(f"WITH o AS ({ORD}) SELECT count(*) AS flagged, count(*) FILTER (id % 6 = 0) AS reviewed, count(*) FILTER (id % 6 <> 0) AS to_review FROM o WHERE id % 3 = 0")
def flagged_report(spark, d):
    return lifecycle.flagged_counts(_flags(spark, d))


@query(f"WITH o AS ({ORD}) SELECT id FROM o WHERE id % 3 = 0 AND id % 6 <> 0 ORDER BY day, id LIMIT 1")
def next_flagged_episode(spark, d):
    return lifecycle.next_flagged(_flags(spark, d)).select("id")


@query(f"WITH o AS ({ORD}) SELECT id, shw AS number, pr AS title, day::VARCHAR AS date, id % 3 = 0 AS flagged, id % 6 = 0 AS reviewed FROM o WHERE id % 5 <> 0")
def episode_menu(spark, d):
    return lifecycle.menu(_flags(spark, d))


@query(f"WITH o AS ({ORD}), c AS (SELECT shw AS episode, id AS copy, (price / 100)::DOUBLE AS s FROM o WHERE price / 100 BETWEEN 0.98 * 1500 AND 2100), b AS (SELECT episode, min((s, copy)) AS b FROM c GROUP BY 1) SELECT episode, b[2] AS copy, round(b[1], 4) AS seconds, b[1] > 1505 AS ads FROM b")
def best_download(spark, d):
    """The shortest whole copy, and whether advertisements were put in."""
    c = _orders(spark, d).select(F.col("show").alias("episode"), F.col("id").alias("copy"), (F.col("price") / 100).cast("double").alias("seconds"), F.lit(1500).alias("feed_s"))
    return lifecycle.best_copies(c).withColumn("seconds", F.round("seconds", 4))


@query(f'WITH o AS ({ORD}), e AS (SELECT shw, row_number() OVER (PARTITION BY shw ORDER BY id) AS r, count(*) OVER (PARTITION BY shw) AS n, id FROM o) SELECT shw AS "show", id FROM e WHERE r = n // 2 + 1')
def middle_passages(spark, d):
    return lifecycle.middles(_orders(spark, d).select("show", "id"), "show", "id")


@query(f"WITH o AS (SELECT id, row_number() OVER (ORDER BY day, id) AS rn, count(*) OVER () AS n FROM ({ORD})) SELECT id FROM o WHERE rn IN (SELECT floor((i + 0.5) * n / 7) + 1 FROM range(7) t(i), (SELECT any_value(n) AS n FROM o))")
def slice_centres(spark, d):
    return lifecycle.centres(_orders(spark, d).select("id", "day"), ["day"], 7, "id")


@query(f"WITH e AS ({_EP}), n AS (SELECT id FROM e ORDER BY published DESC, id DESC LIMIT 20), o AS (SELECT id, row_number() OVER (ORDER BY published DESC, id DESC) - 1 AS rn, count(*) OVER () AS m FROM e WHERE id NOT IN (SELECT id FROM n)) SELECT id FROM n UNION SELECT id FROM o WHERE rn IN (SELECT round_even(i * ((m - 1) / 14.0), 0) FROM range(15) t(i), (SELECT any_value(m) AS m FROM o))")
def selector_seed(spark, d):
    return selection.select(_episodes(spark, d), "seed").select("id")


@query(f"WITH e AS ({_EP}) SELECT id, id % 5 = 0 AS in_scope FROM e")
def scope_set(spark, d):
    e = _episodes(spark, d)
    return selection.set_scope(e, e.where("id % 5 = 0").select("id"), "id").select("id", "in_scope")


@query(f"WITH o AS ({ORD}), f AS (SELECT id + 1 AS id, shw, day + 1 AS day FROM o WHERE id % 3 = 0), m AS (SELECT o.id, min(f.id) AS claim, count(DISTINCT f.id) AS n FROM o JOIN f ON o.pr || o.shw = (SELECT pr FROM o x WHERE x.id = f.id - 1) || f.shw AND abs(date_diff('day', o.day, f.day)) <= 2 GROUP BY o.id) SELECT id, claim FROM m WHERE n = 1 QUALIFY count(*) OVER (PARTITION BY claim) = 1")
def platform_title_match(spark, d):
    """Titles that platforms agree on, within two days; a claim made twice drops all claimants."""
    o = _orders(spark, d).select("id", F.concat(F.lit("It's "), "pr", F.lit(" "), F.col("show"), F.lit("!")).alias("title"), "day")
    found = o.where("id % 3 = 0").select((F.col("id") + 1).alias("platform_id"), F.regexp_replace("title", "'", "’").alias("title"), F.date_add("day", 1).alias("day"))
    return platforms.claimable(platforms.by_title(o, found), o.select(F.lit(-1).cast("bigint").alias("claim")).limit(1))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 7 WHEN 1 THEN p_partkey % 1000 WHEN 2 THEN CASE WHEN p_partkey % 1000 >= 10 THEN p_partkey % 1000 END WHEN 3 THEN 42 END::INT AS number, CASE WHEN p_partkey % 5 = 2 AND p_partkey % 1000 < 10 THEN p_name || ' | ' || p_partkey % 1000 ELSE p_name END AS rest FROM part")
def title_numbers(spark, d):
    """The feed's number wins over a marked one; a trailing number counts if it is plausible."""
    k, n = F.col("p_partkey"), F.col("p_name")
    m = (k % 1000).cast("string")
    p = table(spark, d, "part").select("p_partkey", F.when(k % 5 == 0, F.concat(F.lit("#12: "), n)).when(k % 5 == 1, F.concat(n, F.lit(" | Ep. "), m)).when(k % 5 == 2, F.concat(n, F.lit(" | "), m)).when(k % 5 == 3, F.concat(F.lit("42 - "), n)).otherwise(n).alias("title"), F.when(k % 5 == 0, 7).cast("int").alias("feed"))
    number, rest = titles.split_title(F.col("title"), F.col("feed"))
    return p.select("p_partkey", number.alias("number"), rest.alias("rest"))


@query("WITH s AS (SELECT p_partkey AS id, p_name AS t, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part), b AS (SELECT id, '2020-01-0' || (id % 3 + 1) || CASE WHEN id % 2 = 0 THEN '_ep' || lpad((id % 9)::VARCHAR, 3, '0') ELSE '' END || '_' || CASE WHEN length(s) <= 60 THEN s ELSE regexp_replace(s[1:61], '-[^-]*$', '')[1:60] END AS b FROM s) SELECT id, CASE WHEN r = 1 THEN b ELSE b || '-' || r END AS stem FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY id) AS r FROM b)")
def unique_stems(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("id"), F.date_add(F.lit("2020-01-01").cast("date"), (k % 3).cast("int")).alias("published"), F.when(k % 2 == 0, k % 9).alias("number"), F.col("p_name").alias("title"))
    return titles.stems(p).select("id", "stem")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://www.youtube.com/watch?v=v' || page_id || '&t=' || greatest(0, page_id * 7 - 7 + 10) || 's' END AS youtube, 'https://pages.example/' || 'g%20' || page_id || '?seek=' || greatest(0, page_id * 7 - 7) AS page FROM pages")
def deep_links(spark, d):
    k = F.col("page_id")
    p = table(spark, d, "pages").select("page_id", F.when(k % 2 == 0, F.concat(F.lit("v"), k)).alias("youtube_video_id"), F.lit(None).cast("string").alias("apple_episode_id"), F.lit("").alias("spotify_episode_id"), F.concat(F.lit("g "), k).alias("guid"), F.col("url").alias("page_url"), F.lit(10).alias("offset_youtube_s"), F.lit(0).alias("offset_apple_s"), F.lit(0).alias("offset_spotify_s"))
    out = p.select("page_id", links.deep_links(k * 7000, 7, "https://shows.example/x", "https://pages.example/", "pages.example").alias("l"))
    return out.select("page_id", "l.youtube", "l.page")


@query("SELECT c_custkey, CASE WHEN abs(c_custkey % 9 - 4) <= 3 THEN c_name END AS video, c_custkey % 9 > 4 + 2 AS ads FROM customer")
def published_videos(spark, d):
    k = F.col("c_custkey") % 9
    return table(spark, d, "customer").select("c_custkey", links.published_video(F.col("c_name"), k, F.lit(4)).alias("video"), links.inserted_ads(k, F.lit(4), 2).alias("ads"))


@query(f"""WITH p AS ({PTS}), x AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'web' ELSE '' END AS given, CASE WHEN event_id % 3 = 0 THEN q || ' year:2014' WHEN event_id % 3 = 1 THEN 'budget ' || q ELSE q || ' zq17' END AS q FROM p)
 SELECT event_id, CASE WHEN given <> '' THEN given WHEN event_id % 3 > 0 OR trim(regexp_replace(regexp_replace(lower(q), ' year:2014', ''), '\\s+', ' ', 'g')) IN ('query 1', 'query 3') THEN 'eval' ELSE 'web' END AS traffic FROM x""")
def traffic_guessed(spark, d):
    """Unmarked points are the evaluation's by their words, filters taken out, or by what tests put in."""
    i = F.col("event_id")
    p = _points(spark, d).select("event_id", F.when(i % 5 == 0, "web").otherwise("").alias("traffic"), F.when(i % 3 == 0, F.concat("q", F.lit(" year:2014"))).when(i % 3 == 1, F.concat(F.lit("budget "), F.ltrim("q"))).otherwise(F.concat("q", F.lit(" zq17"))).alias("q"))
    known = spark.createDataFrame([("Query 1",), ("query  3",)], "q string")
    return reporting.retro_class(p, known).select("event_id", "traffic")


@query(f"WITH p AS ({PTS}), b AS (SELECT trim(regexp_replace(lower(q), '\\s+', ' ', 'g')) AS key, mode, sum(sample) AS w FROM p GROUP BY ALL) SELECT key, string_agg(mode, ',' ORDER BY -w, mode) AS modes FROM b GROUP BY key")
def modes_by_weight(spark, d):
    return reporting.modes_by_weight(_points(spark, d), "q", "mode", "sample").withColumn("modes", F.array_join("modes", ","))


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'purchase') AND ts >= TIMESTAMP '2024-01-10' AND contains(user_id::VARCHAR, '1')")
def log_lines_filtered(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "critical").otherwise("debug").alias("level"), F.col("user_id").cast("string").alias("episode"), "ts")
    return reporting.log_filter(e, episode="1", least="warning", since=F.lit("2024-01-10").cast("timestamp_ntz")).select("event_id")


@query("SELECT user_id % 50 AS run_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM (SELECT user_id % 50 AS user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1")
def run_counters(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 50).alias("run_id"), F.col("event_type").alias("step"), F.lit(1).alias("n"))
    out = reporting.counters(e)
    entries = F.array_sort(F.transform(F.map_entries("counts"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))))
    return out.select("run_id", F.array_join(entries, ",").alias("counts"))


@query("SELECT text, count(DISTINCT lang) AS episodes FROM documents WHERE doc_id % 2 = 0 GROUP BY text HAVING count(DISTINCT lang) >= 2")
def boilerplate_texts(spark, d):
    p = table(spark, d, "documents").select("text", F.col("lang").alias("episode"), (F.col("doc_id") % 2 == 0).alias("is_boilerplate"))
    return reporting.texts_by_episode(p)


_GRID = " UNION ALL ".join(f"SELECT {g} AS gap, {n} AS least, count(*) FILTER (e - s >= {n}) AS spans, coalesce(sum(e - s) FILTER (e - s >= {n}), 0)::BIGINT AS covered FROM ({_islands('h', g)})" for g in (4, 12) for n in (10, 30))


@query(f"WITH {RUNS}, h AS (SELECT id, pos AS s, last + 1 AS e FROM r SEMI JOIN s USING (run)) {_GRID}")
def coverage_grid(spark, d):
    runs = lifecycle.frozen(S.word_runs(table(spark, d, "documents"), "doc_id", "text"), "word-runs")
    return reporting.coverage_grid(runs, S.shared_runs(runs), [4, 12], [10, 30])


@query("SELECT doc_id, regexp_replace(CASE WHEN text IS NULL THEN NULL ELSE " + NORMAL + " END, '[0-9].*$', '') AS norm FROM documents WHERE NOT contains(coalesce(text, ''), '''')")
def normal_words(spark, d):
    """Texts as said, up to their first number, whose words SQL does not spell; a test spells them."""
    docs = table(spark, d, "documents").where(~F.coalesce("text", F.lit("")).contains("'"))
    kept = F.regexp_replace(F.regexp_replace(F.lower("text"), r"(?U)[^\w\s']+|_", ""), "[0-9](?s:.*)$", "#")
    whole = words.normal_column(F.when(kept.endswith("#"), F.substring(kept, F.lit(1), F.char_length(kept) - 1)).otherwise(kept))
    ends = F.when(kept.endswith("#") & kept.rlike(r"(?U)\s#$"), F.concat(whole, F.when(whole == "", "").otherwise(" "))).otherwise(whole)
    return docs.select("doc_id", ends.alias("norm"))


@query("SELECT conv_id, turn, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]+'), lambda x: length(ltrim(x, '0')) <= 21)) AS numbers FROM conversations")
def numbers_spelled(spark, d):
    c = table(spark, d, "conversations")
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9]+"), F.lit(0))
    spelled = F.filter(F.transform(found, words.number_column), lambda w: ~w.rlike("[0-9]"))
    return c.select("conv_id", "turn", F.size(spelled).cast("bigint").alias("numbers"))


@query("SELECT event_id, value < 0.5 AND event_type NOT IN ('view', 'click') AS unsure FROM events")
def unsure_words(spark, d):
    w = F.when(F.col("event_type").isin("view", "click"), "The,").otherwise(F.concat("event_type", F.lit(".")))
    return table(spark, d, "events").select("event_id", words.unsure_column(w, F.col("value")).alias("unsure"))


@query("SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'feedback takes a message only' ELSE 'feedback missing' END WHEN event_id % 4 = 1 THEN 'quoted text missing' WHEN event_id % 4 = 2 THEN 'note too long' WHEN event_id % 3 = 0 THEN 'check missing' END AS error FROM events")
def report_errors(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select(i.alias("id"), F.when(i % 4 != 0, F.lit(5)).alias("c"), F.when((i % 4 == 0) & (i % 3 == 0), "q").when(i % 4 == 1, "  ").when(i % 4 >= 2, "q").alias("q"), F.when(i % 4 == 2, F.repeat(F.lit("x"), 1001)).alias("n"), F.when((i % 4 != 3) | (i % 3 != 0), "t").alias("t"))
    return e.select("id", links.report_error(F.col("c"), F.col("q"), F.lit(None).cast("string"), F.col("n"), F.col("t")).alias("error"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 AND o_custkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS v FROM orders")
def upsert_resets(spark, d):
    """Replaced rows start again only where the rule says so."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("v"), "o_custkey")
    out = publish.upsert(o, o.where("o_orderkey % 9 = 0"), "o_orderkey", (F.col("o_custkey") % 2 == 0) & F.col("old").isNotNull(), {"v": F.lit("new")})
    return out.select("o_orderkey", "v")


@query()
def corpus_chunks_clean(spark, d):
    """Guard flags of made-up transcripts of conversations; a test compares the guards with plain cases."""
    from ..operators import guards

    seg = F.struct((F.col("turn") * 10).cast("double").alias("start"), (F.col("turn") * 10 + 9).cast("double").alias("end"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0.0).alias("no_speech_prob"), F.lit(0.0).alias("avg_logprob"), F.lit(None).cast("array<struct<start: double, end: double, word: string, probability: double>>").alias("words"))
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", seg.alias("s")))).alias("x"))
    out = guards.cleaned(t.select("conv_id", F.transform("x", lambda y: y["s"]).alias("segments"), F.lit(None).cast("double").alias("duration_s")))
    return out.select("conv_id", F.size("words").alias("words"), F.array_join("flags", ",").alias("flags"))



