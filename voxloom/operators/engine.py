"""The searches: exact, smart, related and by title, with filters, over a stored index.

Rankings are cut to their few best ids before passages are loaded, so texts and episodes are read for a
page of hits only.  Nothing is matched by a query without a positive term.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.querylang import STOPWORDS, Filters, Phrase, Query
from ..storage import write_table
from . import ranking, search
from .index import Index

#: Page size, results shown and counted, lengths of the fused lists and of titles, the floor.
PAGE, SHOWN, COUNTED, LIST, FUSED, TITLES, FLOOR = 20, 200, 1000, 50, 100, 5, 0.62


@dataclass(frozen=True)
class Corpus:
    """``passages`` (id, episode, seq, start_ms, word_starts, text, is_boilerplate), ``episodes`` (id, number, title, published, year), indexes of both, ``vectors`` (id, embedding)."""

    passages: DataFrame
    episodes: DataFrame
    index: Index
    titles: Index | None = None
    vectors: DataFrame | None = None


def episode_filter(f: Filters) -> Column:
    """The year and number filters; before and after leave the year itself out."""
    tests = [(f.year, lambda v: F.col("year") == v), (f.before, lambda v: F.col("year") < v), (f.after, lambda v: F.col("year") > v), (f.ep, lambda v: F.col("number") == v)]
    out = F.lit(True)
    for value, test in tests:
        if value is not None:
            out = out & F.coalesce(test(value), F.lit(False))
    return out


def passage_filter(q: Query) -> Column:
    return F.lit(True) if q.include_ads else ~F.col("is_boilerplate")


def allowed(corpus: Corpus, q: Query) -> DataFrame:
    """Rows (id, episode, seq, start_ms, published) of the passages that the filters leave; no text is read."""
    episodes = corpus.episodes.where(episode_filter(q.filters)).select(F.col("id").alias("episode"), "published")
    return corpus.passages.where(passage_filter(q)).select("id", "episode", "seq", "start_ms").join(episodes, "episode")


def keyword(corpus: Corpus, q: Query) -> DataFrame:
    """Rows (id, score, episode, seq, start_ms, published) of the passages that match; statistics cover all."""
    return search.scores(corpus.index.postings, corpus.index.lengths, q, corpus.index.stemmed).join(allowed(corpus, q), "id")


def order_of(sort: str) -> list[Column]:
    """Total orders; inside an episode hits always run forwards."""
    tail = [F.col("episode"), F.col("seq"), F.col("id")]
    return {"relevance": [F.round("score", 12), F.col("id")], "newest": [F.desc("published"), *tail], "oldest": [F.asc("published"), *tail]}[sort]


def place(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Ranks of a list that is already cut to a few hundred rows."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def marks(corpus: Corpus, ids: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """Rows (id, text, ranges, first_token) of the passages in ``ids``: what matched, as code-point ranges.

    Overlapping matches are one range, neighbours stay apart.  Ranges that are a stop word are left out
    unless all are; ``first_token`` numbers the space-separated token where the first kept range starts.
    """
    few = F.broadcast(ids.select("id"))  # a page, or a list, of hits
    mine = corpus.index.postings.join(few, "id", "left_semi")
    spans = None
    for p in phrases:
        n = len(search._stems(p, corpus.index.stemmed))
        some = search.phrase_hits(mine, p, corpus.index.stemmed).select("id", F.col("pos").alias("s"), (F.col("pos") + n).alias("e"))
        spans = some if spans is None else spans.unionByName(some)
    texts = corpus.passages.select("id", F.coalesce("text", F.lit("")).alias("text")).join(few, "id", "left_semi")
    if spans is None:
        return texts.withColumn("ranges", F.expr("CAST(array() AS array<struct<start:int,end:int>>)")).withColumn("first_token", F.lit(None).cast("int"))
    pattern = r"[\p{L}\p{N}]+"
    rows = texts.join(spans.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("hits")), "id", "left")
    rows = rows.withColumn("w", F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).withColumn("g", F.split("text", pattern, -1))
    starts = "aggregate(arrays_zip(g, w), named_struct('p', 0, 'o', CAST(array() AS array<int>)), (a, x) -> named_struct('p', a.p + char_length(x.g) + coalesce(char_length(x.w), 0), 'o', concat(a.o, array(a.p + char_length(x.g)))), a -> a.o)"
    rows = rows.withColumn("at", F.expr(starts))
    joined = (
        "aggregate(coalesce(hits, array()), CAST(array() AS array<struct<s:int,e:int>>), (a, h) -> IF(size(a) > 0 AND element_at(a, -1).e > h.s, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'e', greatest(element_at(a, -1).e, h.e)))), concat(a, array(named_struct('s', h.s, 'e', h.e)))))"
    )
    rows = rows.withColumn("joined", F.expr(joined))
    rows = rows.withColumn("every", F.expr("transform(joined, h -> named_struct('start', at[h.s], 'end', at[h.e - 1] + char_length(w[h.e - 1])))"))
    return rows.select("id", "text", without_stopwords(F.col("every"), F.col("text")).alias("ranges")).withColumn("first_token", first_token("text", "ranges"))


def without_stopwords(ranges: Column, text: Column) -> Column:
    kept = F.filter(ranges, lambda r: ~F.lower(F.substring(text, r["start"] + 1, r["end"] - r["start"])).isin(sorted(STOPWORDS)))
    return F.when(F.size(kept) > 0, kept).otherwise(ranges)


def first_token(text: str, ranges: str) -> Column:
    before = F.substring(F.col(text), F.lit(1), F.get(F.col(ranges), 0)["start"])
    return F.when(F.size(ranges) > 0, F.size(F.split(before, " ")) - 1)


def _timed(corpus: Corpus, hits: DataFrame, q: Query) -> DataFrame:
    """``hits`` with text, ranges and hit_ms: keyword hits cue at their first marked word, related ones at the passage's start."""
    related = F.col("match") == "related"
    k = marks(corpus, hits.where(~related), [p for g in q.groups for p in g]).select("id", "text", "ranges", "first_token")
    r = marks(corpus, hits.where(related), list(q.terms)).select("id", "text", "ranges", F.lit(None).cast("int").alias("first_token"))
    times = corpus.passages.select("id", "word_starts").join(F.broadcast(hits.select("id")), "id", "left_semi")
    rows = hits.join(k.unionByName(r), "id").join(times, "id")
    return rows.withColumn("hit_ms", ranking.hit_time(F.col("word_starts"), F.col("first_token"), F.col("start_ms"))).drop("word_starts", "first_token")


def _collapsed(rows: DataFrame) -> DataFrame:
    folded = ranking.collapse(rows.select("episode", "rank", "hit_ms", "id")).select("id", "folded")
    return rows.join(folded, "id").withColumn("more_in_episode", F.size("folded"))


def _shown(corpus: Corpus, hits: DataFrame, q: Query) -> DataFrame:
    """A list of a few hundred hits, written so that it is made once, timed, written and collapsed."""
    return _collapsed(write_table(_timed(corpus, write_table(hits, "hits"), q), "timed-hits"))


def exact(corpus: Corpus, q: Query, sort: str = "relevance", page: int = 1, limit: int = PAGE) -> DataFrame:
    """A page of keyword hits, collapsed within the page, with total, total_capped, truncated and has_more.

    Matches are counted to COUNTED and shown to SHOWN, before collapsing.
    """
    rows = keyword(corpus, q).withColumn("match", F.lit("keyword"))
    return _shown(corpus, search.exact_page(rows, order_of(sort), page, limit, (SHOWN, COUNTED)), q)


def _page(rows: DataFrame, page: int, limit: int) -> DataFrame:
    """A page of a collapsed list: kept hits in order, has_more over all of them."""
    rows = place(rows, [F.col("rank")], "place").withColumn("_n", F.count("*").over(Window.partitionBy()))
    rows = rows.where(F.col("place").between((page - 1) * limit + 1, page * limit))
    return rows.withColumn("has_more", F.col("_n") > page * limit).drop("_n")


def _resorted(rows: DataFrame, sort: str) -> DataFrame:
    return rows if sort == "relevance" else place(rows.drop("rank"), order_of(sort))


def fused(corpus: Corpus, q: Query, vector: list[float] | None) -> DataFrame:
    """Rows (id, rank, match, rrf_score, keyword_rank, vector_rank, vector_score, episode, seq, start_ms, published): smart search before collapsing.

    The keyword and the nearest LIST fuse to FUSED ids; those that only the vectors found must pass the filters and
    exclusions, a hit in both is a keyword hit.
    """
    order = order_of("relevance")
    words = write_table(place(keyword(corpus, q).orderBy(*order).limit(LIST), order).select("id", "rank"), "keyword-list")
    none = words.select("id", "rank", F.lit(0.0).alias("score")).limit(0)
    near = none
    if vector is not None and corpus.vectors is not None:
        near = ranking.nearest(corpus.vectors, vector, LIST, "id")
        near = write_table(place(near, [F.desc("score"), F.col("id")]), "near-list")
    lists = words.select(F.lit(0).alias("list_no"), "rank", "id").unionByName(near.select(F.lit(1).alias("list_no"), "rank", "id"))
    best = [F.desc(F.round("score", 12)), F.col("first")]
    top = place(ranking.fuse(lists).orderBy(*best).limit(FUSED), best).select("id", "rank", F.col("score").alias("rrf_score"))
    top = top.join(F.broadcast(words.select("id", F.col("rank").alias("keyword_rank"))), "id", "left")
    top = top.join(F.broadcast(near.select("id", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))), "id", "left")
    top = top.withColumn("match", F.when(F.col("keyword_rank").isNotNull(), "keyword").otherwise("related"))
    loaded = allowed(corpus, q).join(F.broadcast(top), "id")
    for p in q.negative:
        bad = search.phrase_hits(corpus.index.postings, p, corpus.index.stemmed).select("id").distinct()
        loaded = loaded.join(bad, "id", "left_anti")
    return loaded


def smart(corpus: Corpus, q: Query, vector: list[float] | None, sort: str = "relevance", page: int = 1, limit: int = PAGE, skipped: str | None = None) -> DataFrame:
    """A page of fused hits; ``degraded`` says why there was no meaning to search by (null: there was)."""
    vector = None if skipped else vector
    reason = F.lit(skipped if skipped else None if vector is not None else "unavailable").cast("string")
    if not q.groups:
        vector = None
    rows = _shown(corpus, _resorted(fused(corpus, q, vector), sort), q)
    return _page(rows, page, limit).withColumn("degraded", reason)


def related_list(corpus: Corpus, q: Query, vector: list[float], floor: float = FLOOR, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows (id, rank, match, vector_rank, vector_score, episode, seq, start_ms, published): near, but not matching.

    ``rerank`` takes (id, rank, text) and gives (id, score); ids without a score, and all if it fails, keep
    their order.
    """
    near = place(ranking.within_floor(ranking.nearest(corpus.vectors, vector, LIST, "id"), floor), [F.desc("score"), F.col("id")])
    near = write_table(near.select("id", "rank", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score")), "near-list")
    said = search.scores(corpus.index.postings, corpus.index.lengths, replace(q, negative=()), corpus.index.stemmed).select("id")
    rows = allowed(corpus, q).join(F.broadcast(near), "id").join(said, "id", "left_anti")
    for p in q.negative:
        rows = rows.join(search.phrase_hits(corpus.index.postings, p, corpus.index.stemmed).select("id").distinct(), "id", "left_anti")
    if rerank is not None:
        texts = corpus.passages.select("id", "text").join(F.broadcast(rows.select("id", "rank")), "id")
        try:
            scored = rerank(texts).select("id", "score").groupBy("id").agg(F.first("score").alias("score"))
        except Exception:  # a model that fails leaves the order as it is
            scored = None
        if scored is not None:
            both = rows.join(scored, "id", "left")
            valid = F.when(~F.isnan("score"), F.col("score"))
            rows = place(both.withColumnRenamed("rank", "_old"), [valid.isNull(), valid.desc(), F.col("_old")]).drop("_old", "score")
    return rows.withColumn("match", F.lit("related"))


def related(corpus: Corpus, q: Query, vector: list[float], sort: str = "relevance", page: int = 1, limit: int = PAGE, floor: float = FLOOR, rerank=None) -> DataFrame:
    """A page of related hits."""
    return _page(_shown(corpus, _resorted(related_list(corpus, q, vector, floor, rerank), sort), q), page, limit)


def by_title(corpus: Corpus, q: Query) -> DataFrame:
    """The TITLES best episodes by title: score, newest first, then id."""
    hits = search.scores(corpus.titles.postings, corpus.titles.lengths, q, corpus.titles.stemmed)
    rows = hits.join(corpus.episodes.where(episode_filter(q.filters)), "id")
    return rows.orderBy(F.round("score", 12), F.desc("published"), "id").limit(TITLES)


def context(corpus: Corpus, hits: DataFrame, radius: int = 3) -> DataFrame:
    """Rows (id, near_id, episode, seq): each hit's neighbours in its episode up to ``radius`` places away.

    The band is unrolled to 2 * radius + 1 equal places, so the join is on (episode, seq), and an episode
    that holds many passages is no single key.
    """
    places = F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda k: F.col("seq") + k)
    wanted = corpus.passages.join(hits.select("id"), "id", "left_semi").select(F.col("id"), "episode", F.explode(places).alias("seq"))
    return wanted.join(corpus.passages.select(F.col("id").alias("near_id"), "episode", "seq"), ["episode", "seq"]).select("id", "near_id", "episode", "seq")
