"""Benchmark decontamination: n-gram windows of a benchmark found in whole training texts.

Only DataFrame functions.  A window is 13 consecutive words of an item (or the whole shorter item).
First a screen without loss: of any w consecutive words, the g = (w + 1) // 2 words from the next
multiple of w - g + 1 on lie inside, so a text is a candidate only if one of its g-grams at those
positions is a g-gram of an item; that takes n / 7 hashes a text instead of n.  All windows of
candidates are then scanned against the hash set, and hits are compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import write_table

WINDOW = 13
#: What separates words once A-Z are lower-cased; everything else is a word character.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The windows of a benchmark are broadcast up to so many rows (about 150 bytes each).
BROADCAST_ROWS = 500_000


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else; ``lower`` does just that to a text without other letters."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _grams(words: Column, width: int, salt: int, step: int = 1) -> Column:
    """Hashes of the ``width``-word runs from every ``step``-th word on."""
    last = F.size(words) - width
    starts = F.sequence(F.lit(0), last, F.lit(step))
    some = F.transform(starts, lambda i: F.xxhash64(F.lit(salt), F.slice(words, i + 1, width)))
    return F.when(last >= 0, some).otherwise(F.array().cast("array<bigint>"))


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def benchmark_windows(bench: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Rows (item_id, w, win, key): the windows of each item; items without words have none."""
    rows = bench.select(F.col(item).alias("item_id"), words_of(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    rows = rows.withColumn("w", F.least(F.lit(WINDOW), F.size("ws")))
    rows = rows.select("item_id", "w", "ws", F.explode(F.sequence(F.lit(0), F.size("ws") - F.col("w"))).alias("i"))
    rows = rows.select("item_id", "w", F.slice("ws", F.col("i") + 1, F.col("w")).alias("run"))
    return rows.select("item_id", "w", F.array_join("run", " ").alias("win"), F.xxhash64("w", "run").alias("key")).distinct()


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, text and a 128-bit key of both: rows equal in both are one text."""
    t, d = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), t.alias("text"), F.xxhash64(d, t).alias("k1"), F.xxhash64(F.lit(1), t, d).alias("k2"))


def _hits(docs: DataFrame, bench: DataFrame, text: str, item: str, bench_text: str):
    """(every text with n_words, texts with hits: spans [(pos, w)] and items), both by (k1, k2)."""
    windows = write_table(benchmark_windows(bench, item, bench_text), "windows")
    n = windows.count()
    widths = sorted(r.w for r in windows.select("w").distinct().collect())  # 13 values at most
    keyed = _keyed(docs, text)
    rows = keyed.select("doc_id", "k1", "k2", words_of(F.col("text")).alias("ws"))
    screens = [_grams(F.col("ws"), (w + 1) // 2, w, w - (w + 1) // 2 + 1) for w in widths]
    none = F.array().cast("array<bigint>")
    rows = write_table(rows.select("doc_id", "k1", "k2", F.size("ws").cast("bigint").alias("n_words"), (F.concat(*screens) if screens else none).alias("screen")), "screen")

    parts = windows.select("w", F.split("win", " ").alias("run"))
    grams = None
    for w in widths:
        some = parts.where(F.col("w") == w).select(F.explode(_grams(F.col("run"), (w + 1) // 2, w)).alias("gram"))
        grams = some if grams is None else grams.union(some)
    if grams is None:
        grams = parts.select(F.lit(0).cast("bigint").alias("gram")).limit(0)
    found = rows.select("k1", "k2", F.explode("screen").alias("gram")).join(_maybe_broadcast(grams.distinct(), 7 * n), "gram", "left_semi")
    candidates = write_table(found.select("k1", "k2").distinct(), "candidates")

    texts = keyed.select("k1", "k2", "text").join(candidates, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    texts = write_table(texts.select("k1", "k2", words_of(F.col("text")).alias("ws")), "texts")
    spots = None
    for w in widths:
        last = F.size("ws") - w
        runs = F.expr(f"transform(sequence(0, size(ws) - {w}), i -> struct(i AS pos, xxhash64({w}, slice(ws, i + 1, {w})) AS key))")
        some = texts.where(last >= 0).select("k1", "k2", F.lit(w).alias("w"), F.explode(runs).alias("s")).select("k1", "k2", "w", "s.pos", "s.key")
        spots = some if spots is None else spots.union(some)
    if spots is None:
        spots = texts.select("k1", "k2", F.lit(0).alias("w"), F.lit(0).alias("pos"), F.lit(0).cast("bigint").alias("key")).limit(0)
    wins = windows.select("w", "key", "win").distinct()
    near = spots.join(_maybe_broadcast(wins, n), ["w", "key"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "w", "win")).alias("hits"))
    sure = near.join(texts, ["k1", "k2"]).select("k1", "k2", F.expr("filter(hits, h -> array_join(slice(ws, h.pos + 1, h.w), ' ') = h.win)").alias("hits")).where(F.size("hits") > 0)
    sure = write_table(sure, "hits")
    spans = sure.select("k1", "k2", F.expr("array_sort(array_distinct(transform(hits, h -> struct(h.pos AS pos, h.w AS w))))").alias("spans"))
    seen = sure.select("k1", "k2", F.explode(F.expr("array_distinct(transform(hits, h -> h.win))")).alias("win"))
    items = seen.join(_maybe_broadcast(windows.select("win", "item_id").where("item_id IS NOT NULL").distinct(), n), "win")
    items = items.groupBy("k1", "k2").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    return rows.drop("screen"), spans.join(items, ["k1", "k2"], "left")


COVERED = "aggregate(spans, struct(0 AS n, 0 AS upto), (a, s) -> struct(a.n + greatest(0, s.pos + s.w - greatest(a.upto, s.pos)) AS n, greatest(a.upto, s.pos + s.w) AS upto)).n"


def contamination(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", bench_text: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, k1, k2), one per input row.

    ``n_hit`` counts the words inside any occurrence of a window; a document is contaminated when
    that is a twentieth of its words or more.  Null texts have no words; a null item id counts
    for hits but is no item; rows equal in id and text share a result.  Empty tables give no rows or
    no hits.  Other columns are ignored.
    """
    rows, hits = _hits(docs, bench, text, item, bench_text)
    hits = hits.select("k1", "k2", F.expr(COVERED).cast("bigint").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    out = rows.join(hits, ["k1", "k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    joined = F.coalesce(F.array_join(F.array_sort("items"), ","), F.lit(""))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(joined, 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "k1", "k2",
    )


def _carried(docs: DataFrame, text: str) -> DataFrame:
    """Rows (doc, k1, k2): each row as one struct, so columns of any name are carried, and its key."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    t, d = F.coalesce(F.col("doc")[text].cast("string"), F.lit("")), F.coalesce(F.col("doc")["doc_id"].cast("string"), F.lit("null"))
    return whole.select("doc", F.xxhash64(d, t).alias("k1"), F.xxhash64(F.lit(1), t, d).alias("k2"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, all columns as they were, whatever their names."""
    bad = contamination(docs, bench, text).where("contaminated").select("k1", "k2").distinct()
    kept = _carried(docs, text).join(bad, ["k1", "k2"], "left_anti")
    return kept.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def cut_spans(docs: DataFrame, bench: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the words inside benchmark windows, and the gaps after them, taken out; other columns as they were."""
    _, hits = _hits(docs, bench, text, "item_id", "text")
    out = _carried(docs, text).join(hits.select("k1", "k2", "spans"), ["k1", "k2"], "left").withColumn("t", F.col("doc")[text].cast("string"))
    out = out.withColumn("words", F.array_remove(F.split("t", RAW_GAP), "")).withColumn("lead", F.regexp_extract("t", "^" + RAW_GAP, 0))
    out = out.withColumn("gaps", F.regexp_extract_all(F.substring(F.col("t"), F.char_length("lead") + 1, F.lit(2**31 - 1)), F.lit(RAW_GAP), F.lit(0)))
    kept = F.expr("transform(filter(sequence(0, size(words) - 1), i -> NOT exists(spans, s -> i >= s.pos AND i < s.pos + s.w)), i -> concat(words[i], coalesce(get(gaps, i), '')))")
    cut = F.when(F.col("spans").isNull(), F.col("t")).otherwise(F.concat(F.col("lead"), F.array_join(kept, "")))
    return out.select(*[cut.alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns])
