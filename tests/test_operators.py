import sqlite3

import pytest
from pyspark.sql import functions as F

from voxloom.functions import text as T
from voxloom.operators import publish, ranking, search, sequences, transcript
from voxloom.plans.querylang import parse


@pytest.fixture(scope="module")
def passages(spark):
    rows = [(1, "The gluing of hides: glue, glue."), (2, "Hide glue is old"), (3, "École running runs"), (4, None), (5, "hide the old glue, don't hide glue"), (6, "")]
    return spark.createDataFrame(rows, "id bigint, text string")


@pytest.mark.parametrize("q, match", [("glue", '"glue"'), ("hide glue", '"hide" AND "glue"'), ('"hide glue" OR ecole', '"hide glue" OR "ecole"'), ("run*", '"run"*'), ("old -glue", '"old" NOT "glue"'), ("don't", "\"don't\""), ("glue glue", '"glue" AND "glue"')])
def test_bm25_like_sqlite(spark, passages, q, match):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    for r in passages.collect():
        con.execute("INSERT INTO t(rowid, x) VALUES (?, ?)", (r.id, r.text or ""))
    want = {i: round(s, 9) for i, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
    index, sizes = search.postings(passages, "id", "text"), search.lengths(passages, "id", "text")
    assert {r.id: round(r.score, 9) for r in search.scores(index, sizes, parse(q)).collect()} == want


def test_collapse_has_no_chains(spark):
    hits = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 100_000, 11), (1, 3, 200_000, 12), (1, 4, 119_999, 13), (2, 1, 0, 14)], "episode bigint, rank bigint, hit_ms bigint, id bigint")
    got = {r.id: list(r.folded) for r in ranking.collapse(hits).collect()}
    assert got == {10: [11, 13], 12: [], 14: []}


def test_fusion_ties_go_to_the_first_list(spark):
    lists = spark.createDataFrame([(0, 1, 7), (0, 2, 8), (1, 1, 9), (1, 2, 8), (1, 3, 8)], "list_no int, rank int, id bigint")
    assert [r.id for r in ranking.fuse(lists).collect()] == [8, 7, 9]


def test_word_times(spark):
    d = spark.createDataFrame([(1000, "0,400,-100"), (5, "x"), (0, "")], "s bigint, e string").select("s", T.decode_times(F.col("s"), F.col("e")).alias("t"))
    got = d.withColumn("back", T.encode_times(F.col("s"), F.col("t"))).collect()
    assert list(got[0].t) == [1000, 1400, 1300] and got[0].back == "0,400,-100" and list(got[1].t) == list(got[2].t) == []


def test_times(spark):
    d = spark.createDataFrame([("1:02:03", "PT1H4M15S"), ("58:30", "PT"), ("x", None), ("1800", "P1DT1S")], "a string, b string")
    got = d.select(T.feed_duration(F.col("a")).alias("a"), T.iso_duration(F.col("b")).alias("b"), T.parse_clock(F.col("a")).alias("p")).collect()
    assert [r.a for r in got] == [3723, 3510, None, 1800] and [r.b for r in got] == [3855, 0, None, 86401] and [r.p for r in got] == [3723, 3510, None, 1800]


def test_titles(spark):
    from voxloom.functions import titles

    cases = [("#12: Dust & Chips", 99, 99, "Dust & Chips"), ("Dust | 609", None, 609, "Dust"), ("Old Planes", None, None, "Old Planes"), ("552 - Saws", None, 552, "Saws"), ("5 Tips", None, None, "5 Tips"), ("Best of 1987", None, None, "Best of 1987"), ("Shop Talk 595 Glue", None, 595, "Glue"), ("Ep. 7 - Yes", None, 7, "Yes"), ("12 Angry", None, None, "12 Angry"), ("#3", None, 3, "#3")]
    d = spark.createDataFrame([(t, n) for t, n, _, _ in cases], "t string, n int")
    number, rest = titles.split_title(F.col("t"), F.col("n"), ("Shop Talk",))
    got = {r.t: (r.a, r.b) for r in d.select("t", number.alias("a"), rest.alias("b")).collect()}
    assert got == {t: (a, b) for t, _, a, b in cases}
    shown = spark.createDataFrame([("Greasy Ham | Shop Talk 595", 596), ("Ep. 5 Recap | 608", 608), ("#12: Dust", 12), ("x", None)], "t string, n int")
    assert [r[0] for r in shown.select(titles.display_title(F.col("t"), F.col("n"), ("Shop Talk",))).collect()] == ["Greasy Ham | Shop Talk 595", "Ep. 5 Recap", "Dust", "x"]
    same = spark.createDataFrame([("#12: Don’t — Éa",), ("dont ea | Ep. 9",)], "t string")
    assert {r[0] for r in same.select(titles.platform_title(F.col("t"))).collect()} == {"dont ea"}
    ids = spark.createDataFrame([(1, "How do I glue walnut?"), (2, "how do i glue WALNUT"), (3, "?!")], "ord int, query string")
    assert [r.case_id for r in titles.id_slugs(ids).orderBy("ord").collect()] == ["how-do-i-glue-walnut", "how-do-i-glue-walnut-2", "case"]


def test_links_and_ranges(spark):
    from datetime import date, datetime, timedelta, timezone

    from voxloom.functions import links

    d = spark.createDataFrame([("https://site.example/a", "a😀b", 3), ("https://pages.example/x", "ab", 1), ("ftp://x/y", "", 0), (None, "😀", 2)], "u string, t string, o int")
    got = d.select(links.notes_link(F.col("u"), "pages.example").alias("n"), links.points_of(F.col("t"), F.col("o")).alias("p")).collect()
    assert [r.n for r in got] == ["https://site.example/a", None, None, None] and [r.p for r in got] == [2, 1, 0, 1]
    replies = spark.createDataFrame([("<think>x</think>\nQuery: \"hide glue for walnut.\"",), ("one",), ("a year:2014 b",)], "t string")
    assert [r[0] for r in replies.select(links.clean_reply(F.col("t"))).collect()] == ["hide glue for walnut", None, None]
    assert links.since("12h") == timedelta(hours=12) and links.day_range("3d", None, date(2026, 1, 10)) == (date(2026, 1, 8), date(2026, 1, 10))
    assert links.utc_bounds(date(2026, 1, 1), date(2026, 1, 1), timezone(timedelta(hours=2)))[0] == datetime(2025, 12, 31, 22, tzinfo=timezone.utc)
    with pytest.raises(ValueError):
        links.day_range("2026-02-01", "2026-01-01", date(2026, 1, 10))


def test_publishing_and_cases(spark, tmp_path):
    from datetime import datetime

    from voxloom.operators import lifecycle
    from voxloom.sources import cases

    p = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, text string")
    led = publish.digests(p, "id", ["id"], ["text"])
    lifecycle.publish(spark, str(tmp_path / "out"), p, led, "v1")
    assert lifecycle.published(spark, str(tmp_path / "out")) == "v1"
    assert {r.version for r in lifecycle.publish(spark, str(tmp_path / "out"), p, led, "v2").collect()} == {"v1"}
    lifecycle.publish(spark, str(tmp_path / "out"), p, led.limit(1), "v3")
    assert lifecycle.published(spark, str(tmp_path / "out")) == "v3"
    assert [len(b) for b in lifecycle.statements([(1, "x")] * 120)] == [50, 50, 20]
    day = lambda k: datetime(2026, 1, k)
    assert lifecycle.pull_start(None, datetime(2026, 4, 5, 3)) == datetime(2026, 1, 3) and lifecycle.pull_start(day(9), datetime(2026, 1, 10, 5)) == day(8)
    assert sum(len(x) for x in lifecycle.pulled(lambda a, b: [a] * (3 if (b - a).days else 1), day(1), day(3), 3)) == 48
    with pytest.raises(RuntimeError):
        list(lifecycle.pulled(lambda a, b: [a] * 3, day(1), day(2), 3))
    text = '[{"id": "a", "query": "hide glue", "tag": "exact", "expect": [{"episode": 3, "at": "1:05"}], "smoke": true}]'
    got = cases.read_cases(spark, {"f": text})
    items = cases.items_of(got)
    assert [(r.case_id, r.episode, r.at_s, r.at_ms) for r in items.collect()] == [("a", 3, 65, 65000)]
    assert cases.with_case(got, items, "Hide  Glue", 3, 100).count() == 1 and cases.with_case(got, items, "hide glue", 3, 200).count() == 0
    with pytest.raises(cases.CaseError):
        cases.read_cases(spark, {"f": text.replace("smoke", "smokes")})


def test_vector_files(spark, tmp_path):
    import numpy as np

    from voxloom.sources import cases

    np.savez(tmp_path / "e.npz", chunk_ids=np.array([4, 5]), text_sha=np.array(["aa", "bb"]), vectors=np.eye(2, 3, dtype=np.float32))
    assert [(r.chunk_id, r.text_sha, list(r.embedding)) for r in cases.vectors(spark, str(tmp_path)).collect()] == [(4, "aa", [1, 0, 0]), (5, "bb", [0, 1, 0])]


def test_evaluation_checks(spark):
    from voxloom.operators import evaluation as E

    items = spark.createDataFrame([("a", 0, 7, 60_000, 1, 1), ("b", 0, 8, None, None, 2)], "case_id string, ord int, episode bigint, at_ms bigint, more_in_episode bigint, cards bigint")
    answers = spark.createDataFrame([("a", "exact", 2, 7, 100_000, 1), ("a", "exact", 3, 9, 0, 0), ("b", "exact", 1, 8, 0, 0)], "case_id string, mode string, rank int, episode bigint, hit_ms bigint, more_in_episode bigint")
    assert {r.case_id: r.absent_ok for r in E.absent_passed(items, answers).collect()} == {"a": False, "b": False}
    assert {r.case_id: r.collapse_ok for r in E.collapse_passed(items, answers).collect()} == {"a": True, "b": False}
    assert [(r.passage_rank, r.episode_rank) for r in E.located(answers, 7, 0).collect()] == [(None, 2)]
    means = spark.createDataFrame([(None, 0.9, 0.5, 0.5, 0.7), ("paraphrase", 0.7, 0.1, 0.1, None)], "tag string, recall double, mrr double, ndcg double, time_hit double")
    assert {(r.scope, r.metric): r.met for r in E.targets(means).collect()} == {(None, "recall"): True, ("paraphrase", "recall"): False, (None, "time_hit"): False}
    now, old = (spark.createDataFrame(x, "case_id string, recall double, absent_ok boolean") for x in ([("a", 0.5, True), ("b", 1.0, False), ("c", 1.0, True)], [("a", 1.0, True), ("b", 1.0, True), ("c", 1.0, None)]))
    assert sorted(r.case_id for r in E.newly_missed(now, old).collect()) == ["a", "b"]


def test_numbering_without_one_task(spark):
    from voxloom.operators.ordered import before, numbered

    d = spark.range(500).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("v"))
    got = numbered(d, ["v"], "n", ["k"]).collect()
    for k in range(3):
        some = sorted((r.v, r.n) for r in got if r.k == k)
        assert [n for _, n in some] == list(range(1, len(some) + 1))
    last = {(r.k, r.v): r.p for r in before(d, "k", "v", "p").collect()}
    for k in range(3):
        vs = sorted(r.v for r in got if r.k == k)
        assert [last[k, v] for v in vs] == [None, *vs[:-1]]


def test_repeated_decisions_are_carried(spark):
    from voxloom.operators import repair

    schema = "episode bigint, id bigint, hole struct<start: bigint, end: bigint>, after array<struct<text: string>>, status string"
    old = spark.createDataFrame([(1, 1, (0, 10), [("The",), ("glue.",)], "rejected"), (1, 2, (50, 60), [("x",)], "proposed")], schema)
    new = spark.createDataFrame([(1, 5, (5, 20), [("the",), ("glue",)], "proposed"), (1, 6, (55, 70), [("x",)], "proposed"), (2, 7, (5, 20), [("the",), ("glue",)], "proposed")], schema)
    assert {r.id: r.status for r in repair.carried(old, new).collect()} == {5: "rejected", 6: "proposed", 7: "proposed"}


def test_islands_and_holes(spark):
    s = spark.createDataFrame([(1, 0, 10), (1, 12, 20), (1, 33, 40), (1, 5, 35)], "id bigint, s bigint, e bigint")
    assert [(r.s, r.e) for r in sequences.join_gaps(s, 2).collect()] == [(0, 40)]
    words = spark.createDataFrame([(1, 0, 9000), (1, 5000, 5100), (1, 5200, 5300)], "id bigint, s bigint, e bigint")
    assert [(r.s, r.e) for r in sequences.uncovered(words).collect()] == [(1300, 5000)]
    talk = spark.createDataFrame([(1, 1000, 4000)], "id bigint, s bigint, e bigint")
    assert [(r.s, r.e) for r in sequences.holes(words, talk).collect()] == [(1300, 4000)]


def test_chunks():
    words = [("w" + "." * (i % 25 == 24), i * 400, i * 400 + 399, False) for i in range(300)]
    got = transcript.cut(words)
    assert all(c[-1][2] - c[0][1] + 1 <= transcript.MAX_MS for c in got)
    assert all(c[-1][2] - c[0][1] + 1 >= transcript.TARGET_MS for c in got[:-1]) and got[1][0] == got[0][-25]
    assert {w for c in got for w in c} == set(words)
    edge = [("a", 0, 10, False), ("b.", 20, 30, False), ("ad", 40, 50, True), ("c", 60, 70, False)]
    assert [[w[0] for w in c] for c in transcript.cut(edge)] == [["a", "b."], ["ad"], ["c"]]


def test_digests_do_not_depend_on_order(spark):
    d = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, "a")], "k bigint, o bigint, v string")
    a = {r.k: r.digest for r in publish.digests(d, "k", ["o"], ["o", "v"]).collect()}
    b = publish.digests(d.orderBy(F.desc("o")), "k", ["o"], ["o", "v"])
    assert a == {r.k: r.digest for r in b.collect()}
    assert [r.k for r in publish.due(b, b.where("k = 1"), "k").collect()] == [2]
    with pytest.raises(ValueError):
        publish.guard_mass_change(d, 2)


def test_streaming_usage(spark, tmp_path):
    from voxloom.streaming.usage import daily_usage

    spark.sql("SELECT timestamp'2024-01-01 05:00:00' AS ts UNION ALL SELECT timestamp'2024-01-01 06:00:00' UNION ALL SELECT timestamp'2024-01-05 00:00:00'").write.parquet(f"{tmp_path}/in")
    q = daily_usage(spark.readStream.schema("ts timestamp").parquet(f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("usage").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r.day), r.n) for r in spark.table("usage").collect()) == [("2024-01-01", 2), ("2024-01-05", 1)]


def test_feed_and_logs(spark, tmp_path):
    from voxloom.sources import readers

    (tmp_path / "f.xml").write_text(
        '<rss xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel><item><title>#1 A</title><pubDate>Wed, 03 Jan 2024 10:00:00 +0000</pubDate><itunes:duration>1:00</itunes:duration>'
        '<enclosure url="http://a/x.mp3?y=1" length="1" type="a"/></item><item><title>no audio</title><pubDate>Wed, 03 Jan 2024 10:00:00 +0000</pubDate></item></channel></rss>'
    )
    (r,) = readers.feed(spark, str(tmp_path / "f.xml")).collect()
    assert (r.guid, r.duration_s, str(r.published_at)) == ("http://a/x.mp3", 60, "2024-01-03 10:00:00")
    (tmp_path / "l.jsonl").write_text('{"ts":"2024-01-01T00:00:00Z","level":"info","msg":"a"}\nnot json\n{"level":"info","msg":"b"}\n')
    assert [r.msg for r in readers.log_lines(spark, str(tmp_path / "l.jsonl")).collect()] == ["a"]
