"""Sequence queries: repeated passages over documents, intervals over events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lifecycle, platforms, sentences
from ..operators import sequences as S
from .catalog import query, table

RUNS = """w AS (SELECT doc_id AS id, string_split(coalesce(text, ''), ' ') AS ws FROM documents),
 x AS (SELECT id, list_filter(list_transform(ws, lambda v, i: {'t': regexp_replace(lower(v), '[^a-z0-9'']+', '', 'g'), 'i': i - 1}), lambda y: y.t <> '') AS x FROM w),
 r AS (SELECT id, x[k].i AS pos, x[k + 7].i AS last, array_to_string(list_transform(x[k:k + 7], lambda y: y.t), ' ') AS run FROM (SELECT id, x, unnest(range(1, len(x) - 6)) AS k FROM x WHERE len(x) >= 8)),
 s AS (SELECT run, count(DISTINCT id) AS docs FROM r GROUP BY run HAVING count(DISTINCT id) >= 5)"""


def _islands(source: str, gap: int) -> str:
    return f"""SELECT id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(nw) OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
 SELECT id, s, e, coalesce((s - max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {gap})::INT, 1) AS nw FROM {source})) GROUP BY id, g"""


@query(f"WITH {RUNS} SELECT id, pos FROM r SEMI JOIN s USING (run)")
def word_ngrams_shared(spark, d):
    runs = _runs(spark, d)
    return runs.join(S.shared_runs(runs).select("run"), "run", "left_semi").select("id", F.col("pos").cast("bigint").alias("pos"))


def _runs(spark, d):
    """The runs of all documents, made once and written: they are counted and looked up."""
    return lifecycle.frozen(S.word_runs(table(spark, d, "documents"), "doc_id", "text"), "word-runs")


@query(f"WITH {RUNS} SELECT docs, count(*) AS runs FROM s GROUP BY docs")
def shared_runs(spark, d):
    return S.shared_runs(S.word_runs(table(spark, d, "documents"), "doc_id", "text")).groupBy("docs").agg(F.count("*").alias("runs"))


@query(f"WITH {RUNS}, h AS (SELECT id, pos AS s, last + 1 AS e FROM r SEMI JOIN s USING (run)) SELECT * FROM ({_islands('h', 12)}) WHERE e - s >= 10")
def boilerplate_spans(spark, d):
    out = S.repeated_spans(table(spark, d, "documents"), "doc_id", "text")
    return out.select("id", F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e"))


MS = "SELECT user_id AS id, (epoch_us(ts) // 1000) AS s, (epoch_us(ts) // 1000) + (value * 100000)::BIGINT AS e, event_type, event_id FROM events"


def _ms(spark, d):
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select(F.col("user_id").alias("id"), t.alias("s"), (t + F.round(F.col("value") * 100000, 0).cast("bigint")).alias("e"), "event_type", "event_id")


@query(_islands(f"({MS})", 600000))
def interval_join_gap(spark, d):
    return S.join_gaps(_ms(spark, d), 600000)


@query(
    f"""SELECT id, f AS s, s AS e FROM (SELECT *, max(least(e, s + 3600000) + 300) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f
 FROM ({MS})) WHERE s > f"""
)
def uncovered_gaps(spark, d):
    return S.uncovered(_ms(spark, d), 3600000)


_A, _B = f"(SELECT * FROM ({MS}) WHERE event_type = 'click')", f"(SELECT * FROM ({MS}) WHERE event_type = 'view')"


@query(f"SELECT a.id, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM {_A} a JOIN {_B} b ON a.id = b.id AND a.s < b.e AND b.s < a.e")
def interval_intersection(spark, d):
    rows = _ms(spark, d)
    return S.overlaps(rows.where("event_type = 'click'"), rows.where("event_type = 'view'"))


@query(
    f"""WITH u AS (SELECT id, f AS s, s AS e FROM (SELECT *, max(least(e, s + 1000) + 300) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM {_A}) WHERE s > f),
 o AS (SELECT a.id, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM {_B} a JOIN u b ON a.id = b.id AND a.s < b.e AND b.s < a.e),
 j AS (SELECT * FROM ({_islands('o', 500)}) WHERE e - s >= 1500) {_islands('j', 5000)}"""
)
def holes_in_speech(spark, d):
    rows = _ms(spark, d)
    return S.holes(rows.where("event_type = 'click'").select("id", "s", "e"), rows.where("event_type = 'view'").select("id", "s", "e"))


@query(
    f"""SELECT a.id, a.s, a.e, coalesce(sum(least(a.e, b.e) - greatest(a.s, b.s)) FILTER (b.s IS NOT NULL), 0)::BIGINT AS speech FROM (SELECT DISTINCT id, s, e FROM {_A}) a
 LEFT JOIN {_B} b ON a.id = b.id AND a.s < b.e AND b.s < a.e GROUP BY a.id, a.s, a.e"""
)
def speech_inside_span(spark, d):
    rows = _ms(spark, d)
    return S.speech_inside(rows.where("event_type = 'click'").select("id", "s", "e").distinct(), rows.where("event_type = 'view'"))


@query(
    f"""SELECT a.event_id, (SELECT min(b.s) FROM {_B} b WHERE b.id = a.id AND b.s >= a.s) AS found FROM {_A} a"""
)
def asof_forward(spark, d):
    rows = _ms(spark, d)
    return S.as_of(rows.where("event_type = 'click'").select("id", "s", "event_id"), rows.where("event_type = 'view'").select("id", "s", F.col("s").alias("v")), "id", "s", "v").select("event_id", "found")


@query(
    """WITH m AS (SELECT user_id AS id, event_id AS pos, event_type AS norm FROM events),
 g AS (SELECT *, sum(nw) OVER (PARTITION BY id ORDER BY pos) AS run FROM (SELECT *, coalesce((lag(norm) OVER (PARTITION BY id ORDER BY pos) <> norm)::INT, 1) AS nw FROM m))
 SELECT id, min(pos) AS s, max(pos) AS e, count(*) AS n FROM g GROUP BY id, run, norm HAVING count(*) >= 3"""
)
def loop_sentences(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), F.col("event_type").alias("norm"))
    return S.repeated_sentences(rows, 3)


TIMES = "t AS (SELECT user_id AS id, list((epoch_us(ts) // 1000) ORDER BY event_id) AS times FROM events GROUP BY user_id)"


def _times(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")))).alias("x"))
    return rows.select("id", F.expr("transform(x, y -> y.ms)").alias("times"))


@query(f"WITH {TIMES} SELECT id, array_to_string(list_transform(times, lambda x, i: x - CASE WHEN i = 1 THEN 1704067200000 ELSE times[i - 1] END), ',') AS encoded FROM t")
def wordtimes_encode(spark, d):
    return _times(spark, d).select("id", T.encode_times(F.lit(1704067200000), F.col("times")).alias("encoded"))


@query(f"WITH {TIMES} SELECT id, len(times)::INT AS n, list_sum(times)::BIGINT AS total FROM t")
def wordtimes_decode(spark, d):
    """Encoding and decoding again gives the times back."""
    rows = _times(spark, d).select("id", T.encode_times(F.lit(1704067200000), F.col("times")).alias("encoded"))
    rows = rows.select("id", T.decode_times(F.lit(1704067200000), F.col("encoded")).alias("times"))
    return rows.select("id", F.size("times").alias("n"), F.aggregate("times", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("SELECT event_id, greatest(0, ((epoch_us(ts) // 1000) - 1704067200000) // 1000 - 7 + event_id % 3 * 10)::BIGINT AS cue, greatest(0, ((epoch_us(ts) // 1000) - 1704067200000) // 1000 - 1)::BIGINT AS paragraph FROM events")
def cue_seconds(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp")) - 1704067200000
    rows = table(spark, d, "events")
    return rows.select("event_id", T.cue_seconds(ms, F.col("event_id") % 3 * 10).alias("cue"), T.cue_seconds(ms, F.lit(0), 1).alias("paragraph"))


@query(
    """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS pos FROM documents WHERE text IS NOT NULL),
 f AS (SELECT *, (regexp_matches(word, '[.?!]$') AND NOT regexp_matches(lower(word), '^([0-9]+[.]|mr[.]|mrs[.]|dr[.]|st[.]|vs[.]|no[.])$'))::INT AS ends FROM w),
 g AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM f)
 SELECT doc_id, sentence::BIGINT AS sentence, min(pos) AS first, count(*) AS words FROM g GROUP BY doc_id, sentence"""
)
def sentence_split(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    rows = sentences.split(rows, "doc_id")
    return rows.groupBy("doc_id", "sentence").agg(F.min("pos").cast("bigint").alias("first"), F.count("*").alias("words"))


@query(
    """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderdate::DATE AS d, o_orderkey AS n FROM orders)
 SELECT a.k, count(b.k) AS near, CASE WHEN count(b.k) >= 2 AND abs(a.n - list_sort(list(b.n) FILTER (b.n IS NOT NULL))[count(b.k) // 2 + 1]) > 30 THEN NULL ELSE a.n END AS kept
 FROM o a LEFT JOIN o b ON a.c = b.c AND a.k <> b.k AND abs(date_diff('day', a.d, b.d)) <= 120 GROUP BY a.k, a.n"""
)
def number_median_filter(spark, d):
    """A number is dropped when it is far from the upper median of others within 120 days."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("show"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("number"))
    return lifecycle.in_sequence(o).select(F.col("id").alias("k"), "near", "kept")


@query(
    """WITH a AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate::DATE AS d FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS k2, o_custkey AS c, o_orderdate::DATE AS d2 FROM orders WHERE o_orderkey % 2 = 1),
 m AS (SELECT k, min(k2) AS k2 FROM a JOIN b USING (c) WHERE abs(date_diff('day', d, d2)) <= 30 GROUP BY k HAVING count(DISTINCT k2) = 1)
 SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY k2) = 1"""
)
def fuzzy_unique_match(spark, d):
    """Only a single candidate in the date band counts, and a claim made twice drops all claimants."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("title"), F.to_date("o_orderdate").alias("day"))
    a = o.where("o_orderkey % 2 = 0").withColumnRenamed("o_orderkey", "id")
    b = o.where("o_orderkey % 2 = 1").withColumnRenamed("o_orderkey", "platform_id")
    one = platforms._single(a, b, F.col("title"), F.col("title"), 30)
    return platforms.claimable(one, b.select(F.lit(-1).cast("bigint").alias("claim")).limit(1)).select(F.col("id").alias("k"), F.col("claim").alias("k2"))
