"""Transcript queries: documents and events stand for timed words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corrections, transcript
from .catalog import query, table


@query()
def chunker(spark, d):
    """Greedy chunks of documents whose words come 400 ms apart."""
    split = F.split("text", r"\s+")
    words = F.filter(F.transform(split, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"] != "")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("episode"), words.alias("x"))
    at = [F.transform("x", lambda y: (y["i"] * 400).cast("bigint")), F.transform("x", lambda y: (y["i"] * 400 + 399).cast("bigint")), F.transform("x", lambda y: F.lit(False))]
    rows = rows.select("episode", F.transform("x", lambda y: y["w"]).alias("texts"), *[c.alias(n) for c, n in zip(at, ("starts", "ends", "boilerplate"), strict=True)])
    return transcript.chunk_rows(rows).withColumn("word_starts", F.array_join("word_starts", ","))


RULES = [corrections.Rule(("thly",), "truly")]


@query()
def corrections_apply(spark, d):
    """Every document; SQL cannot express the rules' case and word boundaries, so a test compares with plain Python."""
    rows = corrections.from_texts(table(spark, d, "documents").select("doc_id", F.lit(None).cast("string").alias("stem"), "text"), "text")
    out = corrections.correct(rows, RULES)
    return out.select("doc_id", F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("text"))


@query(
    """WITH s AS (SELECT conv_id AS episode, turn * 2000 + 2000 AS end_ms, text, (turn % 5) / 5.0 AS ns, -(conv_id % 3) AS lp FROM conversations)
 SELECT episode, sum(CASE WHEN ns > 0.6 AND lp < -1 THEN 0 ELSE len(regexp_extract_all(coalesce(text, ''), '[^\\s]+')) END)::BIGINT AS words, count(*) FILTER (ns > 0.6 AND lp < -1) AS dropped,
 sum(CASE WHEN ns > 0.6 AND lp < -1 THEN 0 ELSE len(regexp_extract_all(coalesce(text, ''), '[^\\s]+')) END) / (max(end_ms) / 60000.0) > 260 AS wpm_high FROM s GROUP BY episode"""
)
def guards_wpm_flags(spark, d):
    c = table(spark, d, "conversations")
    s = c.select(F.col("conv_id").alias("episode"), (F.col("turn") * 2000).alias("start_ms"), (F.col("turn") * 2000 + 2000).alias("end_ms"), "text", (F.col("turn") % 5 / 5.0).alias("no_speech_prob"), (-(F.col("conv_id") % 3)).alias("avg_logprob"))
    return transcript.guard_flags(s).select("episode", "words", "dropped", "wpm_high")


@query(
    """WITH b AS (SELECT user_id AS episode, floor((epoch_us(ts) // 1000 - 1704067200000) / 604800000)::BIGINT AS stretch, count(*) AS n, avg((value < 10)::INT) AS share, avg(value) AS mean,
  max(epoch_us(ts) // 1000 - 1704067200000) AS last FROM events GROUP BY ALL),
 c AS (SELECT *, stretch = max(stretch) OVER w AND count(*) OVER w > 1 AND last % 604800000 < 302400000 AS short FROM b WINDOW w AS (PARTITION BY episode))
 SELECT episode, stretch, n, round(share, 9) AS share FROM c WHERE n >= 5 AND NOT short QUALIFY row_number() OVER (PARTITION BY episode ORDER BY round(share, 12) DESC, round(mean, 12), stretch) <= 2"""
)
def unsure_stretches(spark, d):
    w = table(spark, d, "events").select(F.col("user_id").alias("episode"), (F.unix_millis(F.col("ts").cast("timestamp")) - 1704067200000).alias("start_ms"), F.col("value").alias("prob"))
    return transcript.worst_stretches(w, 604_800_000, 5, 2, F.col("prob") < 10.0).select("episode", "stretch", "n", F.round("share", 9).alias("share"))
