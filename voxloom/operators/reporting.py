"""Reports over logs, passages and rules: groups, examples, classes, coverage, pollution, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import squeeze

#: Filters inside searches, what tests put into theirs, levels of log lines.
FILTERS, BUSTER, TESTS = r"\b(?:year|ep|after|before|include|sort):\S+", r"\bz[qz][0-9]+\b", ("budget ", "killswitch check")
LEVELS = ("debug", "info", "warning", "error", "critical")


def weighted_counts(points: DataFrame, keys: list[str], weight: str = "sample") -> DataFrame:
    return points.groupBy(*keys).agg(F.sum(weight).alias("weight"), F.count("*").alias("n"))


def top(points: DataFrame, key: str, weight: str, n: int) -> DataFrame:
    """The n heaviest keys, ties by key."""
    return points.groupBy(key).agg(F.sum(weight).alias("weight")).orderBy(F.desc("weight"), key).limit(n)


def without_results(points: DataFrame, n: int, q: str = "q", results: str = "results", weight: str = "sample") -> DataFrame:
    """The heaviest searches that were answered and found nothing."""
    some = points.where((F.col("status") == 200) & (F.col(results) == 0))
    return top(some.select(squeeze(F.col(q)).alias("q"), weight), "q", weight, n)


def examples(points: DataFrame, by: str, order: str, n: int = 3) -> DataFrame:
    """The first n rows of each group: the few best a task go on, so a hot group is no task's whole sort."""
    rank = F.row_number().over(Window.partitionBy(by, "_part").orderBy(order))
    few = points.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(64))).withColumn("_r", rank).where(F.col("_r") <= n)
    final = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return few.withColumn("_r", final).where(F.col("_r") <= n).drop("_r", "_part")


def modes_by_weight(points: DataFrame, q: str, mode: str, weight: str) -> DataFrame:
    """Rows (key, modes): the modes of each search, heaviest first, ties by name."""
    by = points.where(F.col(q).isNotNull()).groupBy(squeeze(F.col(q)).alias("key"), F.col(mode).alias("_m")).agg(F.sum(weight).alias("_w"))
    return by.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_w")).alias("w"), F.col("_m").alias("m")))), lambda x: x["m"]).alias("modes"))


def retro_class(points: DataFrame, evaluation: DataFrame, q: str = "q", traffic: str = "traffic") -> DataFrame:
    """``points`` with ``traffic`` guessed where it is empty: eval for a question of the evaluation or of tests, else web.

    Filters are taken out before questions are compared; ``evaluation`` (q) is a small, fixed set of texts.
    """
    bare = squeeze(F.regexp_replace(F.col(q), FILTERS, ""))
    known = evaluation.select(squeeze(F.col("q")).alias("_q")).distinct().withColumn("_known", F.lit(True))
    whole, plain = squeeze(F.col(q)), bare
    rows = points.withColumn("_whole", whole).withColumn("_plain", plain)
    rows = rows.join(known.select(F.col("_q").alias("_whole"), F.col("_known").alias("_k1")), "_whole", "left")
    rows = rows.join(known.select(F.col("_q").alias("_plain"), F.col("_known").alias("_k2")), "_plain", "left")
    test = F.lit(False)
    for t in TESTS:
        test = test | F.col("_whole").startswith(t)
    guess = F.when(F.coalesce(F.col("_k1") | F.col("_k2") | test | F.col("_whole").rlike(BUSTER), F.coalesce("_k1", "_k2", F.lit(False))), "eval").otherwise("web")
    given = F.nullif(F.col(traffic), F.lit(""))
    return rows.withColumn(traffic, F.coalesce(given, guess)).drop("_whole", "_plain", "_k1", "_k2")


def level(name: Column) -> Column:
    """A level's place; unknown names count as info."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), F.lower(name)), F.lit(0)), F.lit(2))


def log_filter(lines: DataFrame, run: str | None = None, episode: str | None = None, least: str | None = None, since: Column | None = None) -> DataFrame:
    tests = [(run, lambda: F.col("run_id") == run), (episode, lambda: F.col("episode").contains(episode)), (least, lambda: level(F.col("level")) >= level(F.lit(least))), (since, lambda: F.col("ts") >= since)]
    for value, test in tests:
        if value is not None:
            lines = lines.where(test())
    return lines


def counters(lines: DataFrame, key: str = "step", n: str = "n") -> DataFrame:
    """Each run's counters as a map."""
    sums = lines.groupBy("run_id", key).agg(F.sum(n).alias("_n"))
    return sums.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "_n")))).alias("counts"))


def suspects(words: DataFrame, word: str, low: Column, least: int = 2, share: float = 0.25) -> DataFrame:
    """Words that recognition often doubts: at least so many doubted uses, and such a share of all."""
    g = words.groupBy(F.lower(word).alias("word")).agg(F.count("*").alias("uses"), F.count(F.when(low, 1)).alias("low"))
    return g.where((F.col("low") >= least) & (F.col("low") >= share * F.col("uses")))


def audit(rules: DataFrame, check: str, decision: str, decisions: list[str]) -> DataFrame:
    """How often each check passed and failed under each decision."""
    p = rules.groupBy(check, "passed").pivot(decision, decisions).count()
    return p.select(check, "passed", *[F.coalesce(F.col(f"`{d}`"), F.lit(0)).alias(d) for d in decisions])


def texts_by_episode(passages: DataFrame, least: int = 2) -> DataFrame:
    """Boilerplate texts with how many episodes hold each."""
    some = passages.where("is_boilerplate").select("text", "episode").distinct()
    return some.groupBy("text").agg(F.count("*").alias("episodes")).where(F.col("episodes") >= least)


def covered(spans: DataFrame, words: DataFrame) -> DataFrame:
    """Spans, covered words and their share of all, per episode and overall (id null)."""
    by = spans.groupBy("id").agg(F.count("*").alias("spans"), F.sum(F.col("e") - F.col("s")).alias("covered"))
    rows = words.join(by, "id", "left").rollup("id").agg(F.sum("n").alias("words"), F.coalesce(F.sum("spans"), F.lit(0)).alias("spans"), F.coalesce(F.sum("covered"), F.lit(0)).alias("covered"))
    return rows.withColumn("share", F.round(F.col("covered") / F.col("words"), 6))


def coverage_grid(runs: DataFrame, shared: DataFrame, gaps: list[int], lengths: list[int]) -> DataFrame:
    """Spans and covered words for each pair of a gap and a least length; runs are joined once for each gap."""
    from .sequences import boilerplate_spans

    out = None
    for gap in gaps:
        spans = boilerplate_spans(runs, shared, gap, 0)
        sizes = [F.struct(F.lit(gap).alias("gap"), F.lit(n).alias("least"), F.count(F.when(F.col("e") - F.col("s") >= n, 1)).alias("spans"), F.coalesce(F.sum(F.when(F.col("e") - F.col("s") >= n, F.col("e") - F.col("s"))), F.lit(0)).cast("bigint").alias("covered")) for n in lengths]
        some = spans.agg(F.array(*sizes).alias("x")).select(F.explode("x").alias("x")).select("x.*")
        out = some if out is None else out.unionByName(some)
    return out


def polluted(hits: DataFrame, passages: DataFrame, spans: DataFrame, top_n: int = 10, share: float = 0.25) -> DataFrame:
    """Per query the share of the first hits whose passage spans cover by ``share`` or more.

    ``passages`` (id, episode, s, e) and ``spans`` (episode as id, s, e) are word ranges.
    """
    from .sequences import overlaps

    few = hits.where(F.col("rank") <= top_n)
    mine = passages.join(few.select("id").distinct(), "id", "left_semi")
    cut = overlaps(mine.select(F.struct("id", "episode").alias("who"), F.col("episode").alias("key"), "s", "e"), spans.select(F.col("id").alias("key"), "s", "e"), "key", ["who"])
    by = cut.groupBy(F.col("who.id").alias("id")).agg(F.sum(F.col("e") - F.col("s")).alias("in"))
    rows = few.join(mine.select("id", (F.col("e") - F.col("s")).alias("size")), "id").join(by, "id", "left")
    bad = F.coalesce(F.col("in"), F.lit(0)) >= share * F.col("size")
    return rows.groupBy("query").agg(F.count("*").alias("hits"), F.round(F.avg(bad.cast("double")), 6).alias("polluted"))
