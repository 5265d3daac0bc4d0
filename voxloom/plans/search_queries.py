"""Search and ranking queries: conversations stand for episodes (conv_id) and passages (turn)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import MARKED, PLAIN
from ..operators import engine, ranking, search
from ..operators import index as stored
from .catalog import query, table
from .querylang import parse

TOK = rf"list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), '{MARKED}', '{PLAIN}'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
ID = "conv_id * 1000 + turn"
INDEX = f"""c AS (SELECT {ID} AS id, conv_id, turn, text, {TOK} AS t FROM conversations),
 p AS (SELECT id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM c)"""


def _passages(spark, d):
    return table(spark, d, "conversations").withColumn("id", F.expr(ID))


_INDEXES: dict[tuple, stored.Index] = {}


def indexed(spark, d, name: str, rows, id_col: str, text: str, stemmed: bool) -> stored.Index:
    """The stored index of a table, built when it is first asked for in a session."""
    key = (spark.sparkContext.applicationId, d, name, stemmed)
    if key not in _INDEXES:
        _INDEXES[key] = stored.build(rows, id_col, text, stemmed=stemmed)
    return _INDEXES[key]


def _talk(spark, d, stemmed=False) -> stored.Index:
    return indexed(spark, d, "conversations", _passages(spark, d), "id", "text", stemmed)


def _scored(spark, d, text, stemmed=False):
    ix = _talk(spark, d, stemmed)
    return search.scores(ix.postings, ix.lengths, parse(text), stemmed)


def _bm25_sql(phrases: list[str], where: str, negative: str = "", tail: str = "") -> str:
    """SQL of BM25 over phrases, each given as SQL of (id, pos); ``where`` tests the columns p0, p1..."""
    hits = " UNION ALL ".join(f"SELECT id, {i} AS ph FROM ({s})" for i, s in enumerate(phrases))
    flags = ", ".join(f"bool_or(ph = {i}) AS p{i}" for i in range(len(phrases)))
    return f"""WITH {INDEX}, h AS ({hits}), tf AS (SELECT id, ph, count(*) AS tf FROM h GROUP BY ALL),
 n AS (SELECT ph, count(*) AS n FROM tf GROUP BY ALL), s AS (SELECT count(*) AS docs, avg(len(t)) AS avgdl FROM c),
 w AS (SELECT ph, avgdl, CASE WHEN ln((docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - n + 0.5) / (n + 0.5)) END AS idf FROM n, s),
 r AS (SELECT id, sum(-idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avgdl))) AS score, {flags} FROM tf JOIN w USING (ph) JOIN c USING (id) GROUP BY id)
 SELECT id, round(score, 9) AS score FROM r WHERE {where} {negative} {tail}"""


def _word(w: str) -> str:
    return f"SELECT id, pos FROM p WHERE term = '{w}'"


def _pair(a: str, b: str) -> str:
    return f"SELECT x.id, x.pos FROM p x JOIN p y ON x.id = y.id AND y.pos = x.pos + 1 WHERE x.term = '{a}' AND y.term = '{b}'"


def _rounded(df):
    return df.select("id", F.round("score", 9).alias("score"))


@query(_bm25_sql([_word("tion"), _word("heed")], "p0 OR p1", tail="ORDER BY score, id LIMIT 20"))
def bm25_or_top(spark, d):
    return _rounded(_scored(spark, d, "tion OR heed")).orderBy("score", "id").limit(20)


@query(_bm25_sql([_word("the"), _word("in")], "p0 AND p1"))
def bm25_and(spark, d):
    return _rounded(_scored(spark, d, "the in"))


@query(_bm25_sql([_pair("of", "the")], "p0"))
def phrase_match(spark, d):
    return _rounded(_scored(spark, d, '"of the"'))


@query(_bm25_sql(["SELECT id, pos FROM p WHERE starts_with(term, 'ent')"], "p0"))
def prefix_match(spark, d):
    return _rounded(_scored(spark, d, "ent*"))


@query(_bm25_sql([_word("the"), _word("and"), _word("to")], "p0 AND (p1 OR p2)", f"AND id NOT IN (SELECT id FROM ({_pair('of', 'the')}))"))
def boolean_not_match(spark, d):
    return _rounded(_scored(spark, d, 'the and OR to -"of the"'))


@query(_bm25_sql([_word("the"), _word("the")], "p0 AND p1"))
def repeated_phrase_counts_twice(spark, d):
    return _rounded(_scored(spark, d, "the the"))


@query()
def bm25_stemmed(spark, d):
    return _rounded(_scored(spark, d, "tions", True))


@query(f"WITH {INDEX} SELECT term, count(DISTINCT id) AS docs, count(*) AS uses FROM p GROUP BY term")
def term_vocabulary(spark, d):
    return stored.vocabulary(_talk(spark, d)).withColumnRenamed("stem", "term")


@query(f"WITH {INDEX}, m AS (SELECT DISTINCT id FROM p WHERE term = 'the') SELECT least(count(*), 1000) AS total, count(*) > 1000 AS total_capped, count(*) > 200 AS truncated FROM m")
def exact_count_capped(spark, d):
    n = _scored(spark, d, "the").limit(1001).agg(F.count("*").alias("n"))
    return n.select(F.least("n", F.lit(1000)).cast("bigint").alias("total"), (F.col("n") > 1000).alias("total_capped"), (F.col("n") > 200).alias("truncated"))


@query(
    f"""WITH {INDEX}, m AS (SELECT DISTINCT id FROM p WHERE term = 'the'), n AS (SELECT count(*) AS n FROM m)
 SELECT id, (row_number() OVER (ORDER BY id DESC))::INT AS rank, least(n, 1000) AS total, n > 1000 AS total_capped, n > 200 AS truncated, 40 < least(n, 200) AS has_more
 FROM m, n QUALIFY rank BETWEEN 21 AND 40"""
)
def exact_page_newest(spark, d):
    out = search.exact_page(_scored(spark, d, "the").select("id"), [F.desc("id")], 2, 20)
    return out.select("id", "rank", F.col("total").cast("bigint").alias("total"), "total_capped", "truncated", "has_more")


@query(
    rf"""WITH m AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
 SELECT page_id, title FROM m WHERE list_contains({TOK.replace('text', 'title')}, 'the') ORDER BY page_id DESC LIMIT 5"""
)
def title_match(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    from ..functions.text import tokens

    return rows.where(F.array_contains(tokens(F.col("title")), "the")).orderBy(F.desc("page_id")).limit(5)


@query(
    f"""WITH {INDEX} SELECT c.id, f.id AS near_id FROM (SELECT DISTINCT id FROM p WHERE term = 'heed') q JOIN c USING (id)
 JOIN c f ON f.conv_id = c.conv_id AND f.turn BETWEEN c.turn - 3 AND c.turn + 3"""
)
def context_window(spark, d):
    """A hit's neighbours: an equi-join on each place of the band."""
    rows = _passages(spark, d).select("id", F.col("conv_id").alias("episode"), F.col("turn").alias("seq"))
    ix = _talk(spark, d)
    hits = search.phrase_hits(ix.postings, parse("heed").groups[0][0], False).select("id").distinct()
    return engine.context(engine.Corpus(rows, rows, ix), hits, 3).select("id", "near_id")


@query(
    rf"""WITH m AS (SELECT {ID} AS id, coalesce(text, '') AS text FROM conversations),
 g AS (SELECT id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS w, regexp_split_to_array(text, '[\p{{L}}\p{{N}}]+') AS s FROM m),
 x AS (SELECT id, unnest(w) AS word, unnest(range(len(w))) AS token, w, s FROM g)
 SELECT id, (coalesce(list_sum(list_transform(s[1:token + 1], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(w[1:token], lambda y: length(y))), 0))::INT AS start,
  (coalesce(list_sum(list_transform(s[1:token + 1], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(w[1:token], lambda y: length(y))), 0) + length(word))::INT AS "end", token::INT AS token
 FROM x WHERE translate(lower(word), '{MARKED}', '{PLAIN}') IN ('heed', 'tion')"""
)
def highlight_spans(spark, d):
    return search.highlight(_passages(spark, d), "id", "text", ["heed", "tion"])


def _query_vector(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 7").select("embedding").first()[0]


_COS = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
_QV = "(SELECT embedding FROM embeddings WHERE vec_id = 7) q"


def _near(spark, d, rows=None, k=50):
    rows = table(spark, d, "embeddings") if rows is None else rows
    return ranking.nearest(rows, _query_vector(spark, d), k).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id AS id, {_COS} AS score FROM embeddings e, {_QV} ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, id LIMIT 50")
def vector_topk(spark, d):
    return _near(spark, d)


@query(f"SELECT vec_id AS id, {_COS} AS score FROM embeddings e, {_QV} WHERE label BETWEEN 3 AND 6 ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, id LIMIT 50")
def vector_topk_filtered(spark, d):
    """The filter runs before scoring, so the nearest are exact within it."""
    return _near(spark, d, table(spark, d, "embeddings").where("label BETWEEN 3 AND 6"))


@query(f"WITH t AS (SELECT vec_id AS id, {_COS} AS score FROM embeddings e, {_QV} ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, id LIMIT 50) SELECT * FROM t WHERE score >= 0.3")
def related_floor(spark, d):
    return ranking.within_floor(_near(spark, d), 0.3)


_LISTS = f"""k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY len({TOK}) DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50),
 v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, vec_id) AS rank FROM embeddings e, {_QV} QUALIFY rank <= 50),
 l AS (SELECT 0 AS list_no, * FROM k UNION ALL SELECT 1, * FROM v)"""


def _lists(spark, d):
    from pyspark.sql.window import Window

    from ..functions.text import tokens

    n = F.size(tokens(F.col("text")))
    k = table(spark, d, "documents").select(F.col("doc_id").alias("id"), n.alias("n")).orderBy(F.desc("n"), "id").limit(50)
    k = k.select(F.lit(0).alias("list_no"), "id", F.row_number().over(Window.orderBy(F.desc("n"), "id")).alias("rank"))
    v = ranking.nearest(table(spark, d, "embeddings"), _query_vector(spark, d), 50)
    v = v.select(F.lit(1).alias("list_no"), "id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))
    return k.unionByName(v)


@query(f"WITH {_LISTS} SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM l GROUP BY id")
def rrf_fusion(spark, d):
    return ranking.fuse(_lists(spark, d)).select("id", F.round("score", 9).alias("score"))


@query(
    f"""WITH {_LISTS}, f AS (SELECT id, round(sum(1.0 / (60 + rank)), 12) AS s, min((list_no, rank)) AS first FROM l GROUP BY id)
 SELECT f.id, row_number() OVER (ORDER BY s DESC, first)::INT AS place, k.rank::INT AS keyword_rank, v.rank::INT AS vector_rank FROM f LEFT JOIN k USING (id) LEFT JOIN v USING (id)"""
)
def smart_search_debug(spark, d):
    """Fusion with the ranks each list gave."""
    from pyspark.sql.window import Window

    lists = _lists(spark, d)
    fused = ranking.fuse(lists)
    fused = fused.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("score", 12)), "first")))
    k = lists.where("list_no = 0").select("id", F.col("rank").alias("keyword_rank"))
    v = lists.where("list_no = 1").select("id", F.col("rank").alias("vector_rank"))
    return fused.select("id", "place").join(k, "id", "left").join(v, "id", "left")


_HITS = "SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, ((epoch_us(ts) // 1000) - 1704067200000) // 60 AS hit_ms, event_id AS id FROM events WHERE event_type = 'click'"


def _hits(spark, d):
    from pyspark.sql.window import Window

    rows = table(spark, d, "events").where("event_type = 'click'")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    ms = F.floor((F.unix_millis(F.col("ts").cast("timestamp")) - 1704067200000) / 60)
    return rows.select(F.col("user_id").alias("episode"), rank.alias("rank"), ms.alias("hit_ms"), F.col("event_id").alias("id"))


@query(
    f"""WITH RECURSIVE h AS ({_HITS}), g AS (
 SELECT episode, 1 AS rank, [id] AS ids, [hit_ms] AS kept FROM h WHERE rank = 1
 UNION ALL
 SELECT h.episode, h.rank, CASE WHEN n THEN g.ids ELSE list_append(g.ids, h.id) END, CASE WHEN n THEN g.kept ELSE list_append(g.kept, h.hit_ms) END
 FROM g JOIN (SELECT * FROM h) h ON h.episode = g.episode AND h.rank = g.rank + 1,
 LATERAL (SELECT len(list_filter(g.kept, lambda x: abs(x - h.hit_ms) < 120000)) > 0 AS n)
 ) SELECT episode, unnest(ids) AS id FROM (SELECT episode, ids FROM g QUALIFY row_number() OVER (PARTITION BY episode ORDER BY rank DESC) = 1)"""
)
def collapse_greedy(spark, d):
    return ranking.collapse(_hits(spark, d)).select("episode", "id")


@query()
def collapse_folded(spark, d):
    return ranking.collapse(_hits(spark, d)).withColumn("folded", F.array_join("folded", ","))


@query(
    """WITH h AS (SELECT user_id AS episode, event_id AS rank, (epoch_us(ts) // 1000) AS hit_ms, event_id AS id FROM events),
 m AS (SELECT *, sum(coalesce((lag_e <> episode)::INT, 1)) OVER (ORDER BY rank) AS card FROM (SELECT *, lag(episode) OVER (ORDER BY rank) AS lag_e FROM h))
 SELECT card::BIGINT AS card, episode, array_to_string(list(id ORDER BY hit_ms, id), ',') AS ids, min(rank) AS first_rank FROM m GROUP BY card, episode"""
)
def cards_islands(spark, d):
    return _cards(table(spark, d, "events"))


def _cards(events):
    rows = events.select(F.col("user_id").alias("episode"), F.col("event_id").alias("rank"), F.unix_millis(F.col("ts").cast("timestamp")).alias("hit_ms"), F.col("event_id").alias("id"))
    return ranking.cards(rows).withColumn("ids", F.array_join("ids", ","))


@query(
    """WITH s AS (SELECT event_id AS id, event_id AS rank, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS score FROM events)
 SELECT id, row_number() OVER (ORDER BY score IS NULL, score DESC, rank)::INT AS new_rank FROM s"""
)
def rerank_order(spark, d):
    return _reranked(table(spark, d, "events"))


def _reranked(events):
    rows = events.select(F.col("event_id").alias("id"), F.col("event_id").alias("rank"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("score"))
    return ranking.rerank_order(rows).select("id", F.col("new_rank").cast("int").alias("new_rank"))


@query(
    """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS rn, count(*) OVER () AS m FROM orders),
 k AS (SELECT DISTINCT round_even(i * ((m - 21) / 14.0), 0) AS j FROM range(15) t(i), (SELECT any_value(m) AS m FROM o))
 SELECT o_orderkey FROM o WHERE rn < 20 OR rn - 20 IN (SELECT j FROM k)"""
)
def seed_sample(spark, d):
    """The newest 20 and 15 evenly spaced of the rest."""
    from ..operators import selection

    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", (-F.col("o_orderkey")).alias("k"))
    return selection.seed(rows, order=("o_orderdate", "k")).select("o_orderkey")


@query(
    """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS rn, count(*) OVER () AS m FROM orders)
 SELECT o_orderkey FROM o WHERE rn IN (SELECT round_even((i + 0.5) * m / 12.0, 0) FROM range(12) t(i), (SELECT any_value(m) AS m FROM o))"""
)
def selector_spread(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return ranking.evenly(rows, ["o_orderdate", "o_orderkey"], 12, 0.5, last=False).select("o_orderkey")
