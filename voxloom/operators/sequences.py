"""Ordered sequences: word runs shared across documents, islands, interval joins, gaps, loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import write_table

N, SHARED_BY, GAP, LEAST = 8, 5, 12, 10
#: Shared runs are broadcast up to so many bytes, counted from their rows; beyond, joins shuffle.
BROADCAST_BYTES = 48 << 20


def _tokens(text: str) -> str:
    """SQL of the words (t, i) of a text that are not empty once only a-z, 0-9 and apostrophes are left; i counts all words."""
    return f"filter(transform(split(regexp_replace(lower(coalesce({text}, '')), \"[^a-z0-9' ]+\", ''), ' '), (w, i) -> named_struct('t', w, 'i', i)), x -> x.t <> '')"


def _run_lists(docs: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """Rows (id, at, runs) of documents: word indexes of the tokens, and hashes of each n following tokens."""
    rows = docs.select(F.col(id_col).alias("id"), F.expr(_tokens(f"CAST(`{text}` AS STRING)")).alias("x")).where(F.size("x") >= n)
    rows = rows.select("id", F.expr("transform(x, y -> y.i)").alias("at"), F.expr("transform(x, y -> y.t)").alias("t"))
    return rows.select("id", "at", F.expr(f"transform(sequence(0, size(t) - {n}), k -> xxhash64(slice(t, k + 1, {n})))").alias("runs"))


def word_runs(docs: DataFrame, id_col: str, text: str, n: int = N) -> DataFrame:
    """Rows (id, pos, last, run): hashes of n following non-empty tokens; ``pos`` and ``last`` are word indexes."""
    rows = _run_lists(docs, id_col, text, n)
    return rows.select("id", F.explode(F.expr(f"transform(runs, (r, k) -> named_struct('pos', at[k], 'last', at[k + {n - 1}], 'run', r))")).alias("r")).select("id", "r.pos", "r.last", "r.run")


def repeated_spans(docs: DataFrame, id_col: str, text: str, n: int = N, shared_by: int = SHARED_BY, gap: int = GAP, least: int = LEAST) -> DataFrame:
    """``boilerplate_spans`` of documents: runs are made once and written as one list a document.

    What is counted is (run, document) without positions, distinct inside the row; only runs that are shared
    come back, and only they are given places.
    """
    lists = write_table(_run_lists(docs, id_col, text, n), "run-lists")
    counts = lists.select(F.explode(F.array_distinct("runs")).alias("run")).groupBy("run").agg(F.count("*").alias("docs"))
    shared = write_table(counts.where(F.col("docs") >= shared_by).select("run"), "shared-runs")
    if shared.count() * 16 <= BROADCAST_BYTES:
        shared = F.broadcast(shared)
    places = lists.select("id", F.explode(F.expr(f"transform(runs, (r, k) -> named_struct('run', r, 's', at[k], 'e', at[k + {n - 1}] + 1))")).alias("x")).select("id", "x.run", "x.s", "x.e")
    return join_gaps(places.join(shared, "run", "left_semi").select("id", "s", "e"), gap).where(F.col("e") - F.col("s") >= least)


def shared_runs(runs: DataFrame, least: int = SHARED_BY) -> DataFrame:
    """Runs in at least ``least`` documents; a run is one row per document before the shuffle."""
    return runs.select("id", "run").distinct().groupBy("run").agg(F.count("*").alias("docs")).where(F.col("docs") >= least)


def join_gaps(spans: DataFrame, gap: int, key: str = "id", start: str = "s", end: str = "e") -> DataFrame:
    """Intervals joined where the next begins at most ``gap`` after all before end."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col(start) - reach > gap).cast("int"), F.lit(1))
    rows = spans.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def boilerplate_spans(runs: DataFrame, shared: DataFrame, gap: int = GAP, least: int = LEAST) -> DataFrame:
    """Word spans [s, e) that shared runs cover, joined over small gaps, then the short ones dropped."""
    hit = runs.join(shared.select("run"), "run", "left_semi").select("id", F.col("pos").alias("s"), (F.col("last") + 1).alias("e"))
    return join_gaps(hit, gap).where(F.col("e") - F.col("s") >= least)


def _met(a: DataFrame, b: DataFrame, key: str, extra: list[str]) -> DataFrame:
    """Pairs (key, s, e, s2, e2, extra) of intervals that overlap, each once.

    Time is dealt into stretches of about twice the mean length, both sides into those they touch, so
    a key with many intervals is many small joins; a pair counts where its later start lies.
    """
    mean = a.select("s", "e").unionByName(b.select("s", "e")).agg(F.avg(F.col("e") - F.col("s")).alias("m")).first()["m"]
    width = max(1, int(2 * (mean or 0)))
    touched = F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.greatest(F.col("s"), F.col("e") - 1) / width))).alias("_t")
    x = a.select(key, *extra, "s", "e", touched)
    y = b.select(F.col(key).alias("_k"), "s", "e", touched).select("_k", F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("_t").alias("_t2"))
    on = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_t") == F.col("_t2")) & (F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e"))
    return x.join(y, on).where(F.floor(F.greatest("s", "s2") / width) == F.col("_t")).drop("_k", "_t", "_t2")


def overlaps(a: DataFrame, b: DataFrame, key: str = "id", extra: list[str] = ()) -> DataFrame:
    """Intersections of two interval tables (key, s, e), with ``extra`` columns of the first."""
    both = _met(a, b, key, list(extra))
    return both.select(key, *extra, F.greatest("s", "s2").alias("s"), F.least("e", "e2").alias("e"))


def uncovered(words: DataFrame, longest: int = 1000, pad: int = 300) -> DataFrame:
    """Stretches between words (id, s, e) that no word reaches; a word reaches min(e, s + longest) + pad."""
    w = Window.partitionBy("id").orderBy("s", "e")
    reach = F.max(F.least(F.col("e"), F.col("s") + longest) + pad).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return words.withColumn("from", reach).where(F.col("s") > F.col("from")).select("id", F.col("from").alias("s"), F.col("s").alias("e"))


def holes(words: DataFrame, speech: DataFrame, loops: DataFrame | None = None) -> DataFrame:
    """Speech that no word covers, joined at 500 ms, 1.5 s or longer, united with loops, joined at 5 s."""
    found = join_gaps(overlaps(speech, uncovered(words)), 500).where("e - s >= 1500")
    return join_gaps(found if loops is None else found.unionByName(loops), 5000)


def speech_inside(spans: DataFrame, speech: DataFrame) -> DataFrame:
    """Rows (id, s, e, speech): milliseconds of speech inside each span."""
    inside = overlaps(spans.select("id", "s", "e", F.col("s").alias("s0"), F.col("e").alias("e0")).distinct(), speech, "id", ["s0", "e0"])
    sums = inside.groupBy(F.col("id").alias("_i"), "s0", "e0").agg(F.sum(F.col("e") - F.col("s")).alias("speech"))
    on = F.col("id").eqNullSafe(F.col("_i")) & (F.col("s") == F.col("s0")) & (F.col("e") == F.col("e0"))
    return spans.select("id", "s", "e").distinct().join(sums, on, "left").select("id", "s", "e", F.coalesce("speech", F.lit(0)).alias("speech"))


def repeated_sentences(sentences: DataFrame, least: int = 5, longest: int = 6) -> DataFrame:
    """Runs of ``least`` or more equal sentences (id, pos, norm) of up to ``longest`` words."""
    order = Window.partitionBy("id").orderBy("pos")
    new = F.coalesce((F.lag("norm").over(order) != F.col("norm")).cast("int"), F.lit(1))
    rows = sentences.withColumn("_run", F.sum(new).over(order))
    rows = rows.groupBy("id", "_run", "norm").agg(F.min("pos").alias("s"), F.max("pos").alias("e"), F.count("*").alias("n"))
    return rows.where((F.col("n") >= least) & (F.size(F.split("norm", " ")) <= longest) & (F.col("norm") != "")).select("id", "s", "e", "n")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """For each left row the first ``value`` of right at or after its time, without a range join.

    Both sides are one sorted sequence per key: a window carries the next right value back.
    """
    a = left.select(key, at, F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_row"))
    b = right.select(key, at, F.col(value).alias("_v"), F.lit(1).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(0, Window.unboundedFollowing)
    rows = a.unionByName(b).withColumn("found", F.first("_v", ignorenulls=True).over(w))
    return rows.where("_side = 0").select("_row.*", "found")
