"""Registered queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, kneser, lines, packing, pii, quality, quotes, setsketch, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 2
        THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])
        WHEN len(ws) = 1 THEN ws ELSE [] END) AS sh FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id
  GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), r(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.b)::BIGINT AS component_id,
       min(r.b) = d.doc_id AS kept
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query(OP2)
def op2_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


@query()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"))


@query()
def op7_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


@query()
def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


GAPLESS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP10 = rf"""
WITH b AS (
  SELECT item_id, ws, least(13, len(ws)) AS w FROM (SELECT item_id, regexp_extract_all({LOWER}, {GAPLESS}) AS ws FROM benchmark) WHERE len(ws) > 0
), bw AS (
  SELECT DISTINCT item_id, w, array_to_string(ws[i:i + w - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - w + 2)) AS i FROM b)
), d AS (
  SELECT doc_id, coalesce(regexp_extract_all({LOWER}, {GAPLESS}), []) AS ws FROM documents
), dw AS (
  SELECT doc_id, i, w, array_to_string(ws[i:i + w - 1], ' ') AS win
  FROM (SELECT d.*, x.w, unnest(range(1, len(ws) - x.w + 2)) AS i FROM d, (SELECT DISTINCT w FROM bw) x)
), h AS (SELECT dw.doc_id, dw.i, dw.w, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.w = bw.w),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + w)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query(OP10)
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k1", "k2")


def _rule_sql() -> str:
    """CASE branches of the rules, longest first."""
    rules = sorted(urls.RULES, key=lambda r: -len(r[0] + r[1]))
    return " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}:{v}'" for h, p, v in rules)


def _level_sql(name: str, source: str, keys: str, mean: str, weight: str) -> str:
    """Common table expression ``{name}`` with {name}_a, {name}_b and {name}_w: posteriors of ``source`` (keys, n, bad)."""
    lo, hi = urls.STRENGTH
    return f"""
{name}_m AS (SELECT {keys}, n, bad, greatest(0.001, least(0.999, {mean})) AS mu, ({weight})::DOUBLE AS w FROM {source}),
{name}_v AS (SELECT sum(n * mu * (1 - mu)) AS v, sum(pow(bad - n * mu, 2)) AS q, sum(n * mu * (1 - mu) * (n - 1)) AS x FROM {name}_m WHERE n > 1),
{name}_f AS (SELECT CASE WHEN x > 0 THEN least({hi}, greatest({lo}, CASE WHEN q > v THEN x / (q - v) - 1 ELSE {hi} END)) ELSE {lo} END AS f FROM {name}_v),
{name} AS (SELECT {keys}, mu * f * w / (f + w) + bad AS {name}_a, (1 - mu) * f * w / (f + w) + n - bad AS {name}_b, f * w / (f + w) + n AS {name}_w FROM {name}_m, {name}_f)"""


_TWO = "(" + ", ".join(f"'{x}'" for x in urls.SUFFIXES) + ")"
OP6 = rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{urls.UPPER}', '{urls.UPPER.lower()}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), l AS (SELECT doc_id AS page_id, max((toxic = 1 OR quality = 0)::INT) AS bad FROM labels GROUP BY doc_id),
h AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, string_split(host, '.') AS ls, CASE WHEN array_to_string(ls[-2:], '.') IN {_TWO} THEN 2 ELSE 1 END AS k,
         array_to_string(ls[-k:], '.') AS suffix, array_to_string(ls[-k - 1:], '.') AS domain
  FROM p LEFT JOIN l USING (page_id) GROUP BY host
), d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
o AS (SELECT coalesce(sum(bad), 0) AS b0, coalesce(sum(n), 0) AS n0 FROM s),
{_level_sql("sp", "s, o", "suffix", "(b0 + 1) / (n0 + 2)", "n0 + 2")},
{_level_sql("dp", "(SELECT d.*, sp_a, sp_w FROM d JOIN sp USING (suffix))", "domain", "sp_a / sp_w", "sp_w")},
{_level_sql("hp", "(SELECT h.*, dp_a, dp_w FROM h JOIN dp USING (domain))", "host", "dp_a / dp_w", "dp_w")},
r AS (SELECT host, hp_a / hp_w AS m, greatest(0, hp_a / hp_w - {urls.Z} * sqrt(hp_a / hp_w * (1 - hp_a / hp_w) / (hp_w + 1))) AS low FROM hp),
f AS (SELECT p.*, CASE {_rule_sql()} END AS fit FROM p)
SELECT page_id, host, path, split_part(fit, ':', 1) AS rule,
       coalesce(split_part(fit, ':', 2), CASE WHEN round(low, 9) > {urls.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       round(m, 6) AS bad_rate, round(low, 6) AS bad_low
FROM f LEFT JOIN r USING (host)
"""


@query(OP6)
def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return out.withColumn("bad_rate", F.round("bad_rate", 6)).withColumn("bad_low", F.round("bad_low", 6))


@query()
def op9_kneser_ney_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.score(table(spark, sf_dir, "documents"))


@query()
def op8_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"))
    out = lines.dedup_lines(docs, empty="keep")
    left = F.size(F.split("text", "\n")).cast("bigint")
    return out.select("doc_id", "n_lines", left.alias("n_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query()
def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@query()
def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))
