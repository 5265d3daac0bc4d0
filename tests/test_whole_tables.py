"""Queries that SQL cannot express, over whole small tables, against plain Python."""

import re

from voxloom.plans.all_queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_folded_holds_every_hit_once(spark):
    rows = QUERIES["collapse_folded"](spark, SF).collect()
    ids = [x for r in rows for x in [r.id, *map(int, filter(None, r.folded.split(",")))]]
    clicks = [r.event_id for r in spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'click'").collect()]
    assert sorted(ids) == sorted(clicks)


def test_corrections_of_every_document(spark, tmp_path):
    texts = ["Yours thly there", "Thly yours. Thly, then", "earthly thlyness", "(thly) THLY!", "no hit", None, "", "a  thly thly"]
    rows = [(i, texts[i % len(texts)]) for i in range(1, 60)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in QUERIES["corrections_apply"](spark, str(tmp_path)).collect()}

    def want(text):
        out = []
        for w in text.split(" "):
            if re.sub(r"[^\w']", "", w.lower()) == "thly":
                opens = not out or out[-1][-1:] in (".", "!", "?")
                out.append(("Truly" if opens and re.sub(r"^\W+", "", w)[0].isupper() else "truly") + re.search(r"[^\w']*$", w)[0])
            else:
                out.append(w)
        return " ".join(out)

    assert got == {i: None if t is None else want(t) for i, t in rows}


def test_shown_pages(spark):
    """A marked page: marks are the query's words, hits cue at the first of them, folds and places are whole."""
    rows = QUERIES["search_smart_page"](spark, SF).collect()
    assert sorted(r.place for r in rows) == list(range(1, len(rows) + 1)) and all(r.degraded is None for r in rows)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        words = [w.lower() for w in re.findall(r"[^\W_]+", texts[r.id] or "")]
        if r.match == "keyword":
            assert "and" in words and r.marks == words.count("and")
            tokens = [k for k, t in enumerate(texts[r.id].split(" ")) if "and" in [w.lower() for w in re.findall(r"[^\W_]+", t)]]
            assert r.hit_ms == tokens[0] * 400
        else:
            assert r.hit_ms == 0


def test_chunks_hold_every_word(spark):
    rows = QUERIES["chunker"](spark, SF).collect()
    assert all(len(r.text.split(" ")) == len(r.word_starts.split(",")) for r in rows)
    assert all(r.end_ms - r.start_ms + 1 <= 45_000 for r in rows)


def test_chunks_by_row_and_by_word_agree(spark):
    from pyspark.sql import functions as F

    from voxloom.operators import transcript

    words = spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL").select(F.col("doc_id").alias("episode"), F.posexplode(F.split("text", r"\s+")).alias("pos", "text")).where("text <> ''")
    words = words.select("episode", "pos", "text", (F.col("pos") * 400).cast("bigint").alias("start_ms"), (F.col("pos") * 400 + 399).cast("bigint").alias("end_ms"), F.lit(False).alias("boilerplate"))
    want = {(r.episode, r.seq): (r.start_ms, r.end_ms, r.text) for r in transcript.chunks(words).collect()}
    assert {(r.episode, r.seq): (r.start_ms, r.end_ms, r.text) for r in QUERIES["chunker"](spark, SF).collect()} == want


def test_corrections_hold_few_words_at_once(spark):
    """Python workers stay small over batches of many words: before, up to 10,000 rows became dictionaries at once."""
    import threading

    import psutil

    from voxloom.operators import corrections
    from pyspark.sql import functions as F

    docs = spark.range(0, 3_000, 1, 1).select(F.col("id").cast("string").alias("stem"), F.concat(F.repeat(F.lit("some words here "), 200), F.lit("thly "), F.col("id").cast("string")).alias("text"))
    peak, over = [0], threading.Event()

    def watch():
        while not over.wait(0.02):
            for p in psutil.Process().children(recursive=True):
                try:
                    if "pyspark.daemon" in p.cmdline():
                        peak[0] = max(peak[0], p.memory_info().rss)
                except psutil.Error:
                    continue

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        rules = [corrections.Rule(("thly",), "truly"), corrections.Rule(("here", "some"), "hear some", "7")]
        words = corrections.correct(corrections.from_texts(docs, "text"), rules).select("stem", F.array_join("words.text", " ").alias("text"))
        got = words.agg(F.count("*"), F.sum(F.col("text").contains("truly").cast("int")), F.sum(F.col("text").contains("thly").cast("int")), F.sum(F.col("text").contains("hear some").cast("int"))).first()
    finally:
        over.set()
        watcher.join()
    assert tuple(got) == (3_000, 3_000, 0, 1) and 0 < peak[0] < 400e6, peak
