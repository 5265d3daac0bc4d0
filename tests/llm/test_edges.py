"""Nulls, empty and long texts, repeated rows, clashing extra columns and empty tables, for every operator."""

import pytest
from pyspark.sql import functions as F

from voxloom.llm import bpe, decontam, kneser, lines, packing, pii, quality, quotes, setsketch, urls

WORDS = "the quick brown fox jumps over a lazy dog near some old river bank today".split()
LONG = " ".join(WORDS[i % 15] + str(i % 997) for i in range(20_000))
ROWS = [
    (1, " ".join(WORDS * 5), "en"), (2, None, "en"), (3, "", None), (None, " ".join(WORDS * 4), "en"), (5, " ".join(WORDS * 5), "en"),
    (5, " ".join(WORDS * 5), "en"), (7, LONG, "en"), (8, "\n\n \t", "de"), (9, "one", "xx"), (10, "é😀 ÀÉ one\x00two", None),
]
CLASH = ["_doc", "_spans", "_words", "_lead", "_gaps", "doc", "words", "id", "key", "n", "kept", "component", "component_id", "rep", "k1", "_gone", "a", "b", "spans", "gone", "h1", "t", "f1", "group"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    return df.withColumns({c: F.lit("x") for c in CLASH}).withColumn("n_words", F.lit(None).cast("int"))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(WORDS)), (2, None), (3, ""), (None, "lazy dog"), (4, "One")], "item_id bigint, text string")


def operators(spark, bench):
    return {
        "quality": quality.quality, "near": lambda d: setsketch.near_duplicates(d, width=2), "tokens": bpe.token_counts, "pii": pii.report, "kneser": kneser.score,
        "decontam": lambda d: decontam.contamination(d, bench),
    }


@pytest.mark.parametrize("name", ["quality", "near", "tokens", "pii", "kneser", "decontam"])
def test_one_row_per_row_and_none_for_none(spark, docs, bench, name):
    f = operators(spark, bench)[name]
    out = f(docs).collect()
    assert len(out) == len(ROWS)
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in ROWS)
    assert f(docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["quality", "lines", "near", "decontam", "spans"])
def test_filters_keep_columns_and_rows_that_share_no_fault(spark, docs, bench, name):
    f = {
        "quality": quality.keep_quality, "lines": lines.dedup_lines, "near": setsketch.drop_near_duplicates,
        "decontam": lambda d: decontam.drop_contaminated(d, bench), "spans": lambda d: decontam.cut_spans(d, bench),
    }[name]
    out = f(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert (None if name == "quality" else 7) in ids
    assert f(docs.limit(0)).collect() == []


def test_copies(spark, docs):
    got = {r.doc_id: r for r in setsketch.near_duplicates(docs, width=2).where("doc_id IS NOT NULL").collect()}
    assert got[5].component_id == 1 and not got[5].kept and got[1].kept
    assert got[2].n_shingles == got[3].n_shingles == got[8].n_shingles == 0 and got[2].kept and got[9].n_shingles == 1


def test_decontamination_values(spark, docs, bench):
    got = {r.doc_id: r for r in decontam.contamination(docs, bench).collect()}
    assert got[1].n_words == got[1].n_hit == 75 and got[1].contaminated and got[1].n_items == 1
    assert got[9].n_hit == 1 and got[9].contaminated and got[10].n_hit == 1
    assert got[2].n_words == 0 and not got[2].contaminated
    cut = {r.doc_id: r.text for r in decontam.cut_spans(docs, bench).collect()}
    assert cut[9] == "" and cut[2] is None and cut[7] == LONG


def test_packing_holds_every_token_once(spark, docs):
    out = packing.pack(docs.select("doc_id", "text", "group")).collect()
    assert sum(r.length for r in out) == sum(r.n_tokens for r in bpe.token_counts(docs).collect()) + len(ROWS)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs.limit(0)).collect() == []


def test_repeated_rows_spread_over_groups(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("same text").alias("text"))
    out = packing.pack(rows, with_ids=False)
    sizes = [r["count"] for r in out.groupBy(F.shiftright("sequence_id", 32).alias("g")).count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) == 5 and max(sizes) < 6_000


def test_urls(spark):
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, None, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    rows = [(1, "HTTP://a.Example.COM/en/x?y"), (2, None), (None, "no scheme"), (4, "x://www.example.com/en/"), (4, "x://y.net/es/#z"), (5, "a://net/es"), (6, "u://x.com"), (7, "u://EXAMPLE.org?q=://b.net/es/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("clash"))
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, labels).collect()]
    assert (1, "a.example.com", "/en/x", "example.com/en/", "block") in got
    assert (4, "www.example.com", "/en/", "www.example.com/en/", "allow") in got
    assert (4, "y.net", "/es/", "net/es/", "block") in got
    assert {x[3] for x in got if x[0] in (2, None, 5, 6, 7)} == {None} and len(got) == len(rows)
    assert (7, "example.org", "", None, "allow") in got
    # one bad label blocks its own host only once more pages confirm it, and never hosts without a label
    many = spark.createDataFrame([(k, "u://bad.co.uk/a") for k in range(1, 13)] + [(k, f"u://h{k}.co.uk/a") for k in range(13, 40)] + [(99, None), (100, "u://" + "x" * 50_000 + ".com/")], "page_id bigint, url string")
    marks = spark.createDataFrame([(k, 0, 1) for k in range(1, 13)] + [(k, 1, 0) for k in range(13, 26)], "doc_id bigint, quality int, toxic int")
    verdict = {(r.host, r.verdict) for r in urls.judge(many, marks).collect()}
    assert ("bad.co.uk", "block") in verdict and all(v == "allow" for h, v in verdict if h != "bad.co.uk")
    assert urls.judge(pages.limit(0), labels).collect() == [] and len(urls.judge(pages, labels.limit(0)).collect()) == len(rows)


def test_quotes(spark):
    m = [
        (1, 0, "user", "How do I glue walnut to maple?\n\nIt keeps failing."), (1, 1, "bot", "> How do I glue walnut to maple?\nUse hide glue, clamp it well."),
        (2, 0, "user", ">> How do I GLUE walnut, to maple\n> Use hide glue, clamp it well.\nThanks"), (3, 0, "user", None), (3, 0, "user", None), (None, 1, "x", "y"), (4, 0, "user", "> nobody ever wrote this line"),
    ]
    d = spark.createDataFrame(m, "conv_id bigint, turn bigint, role string, text string").withColumn("at", F.lit(1))
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(d).collect()}
    assert len(got) == 5
    assert (got[1, 1].parent_conv, got[1, 1].parent_turn) == (1, 0) and got[1, 1].own_text == "Use hide glue, clamp it well."
    assert (got[2, 0].parent_conv, got[2, 0].parent_turn, got[2, 0].depth, got[2, 0].root_conv) == (1, 1, 2, 1)
    assert got[2, 0].n_quotes == got[2, 0].n_linked == 2 and got[4, 0].n_linked == 0
    assert quotes.link_quotes(d.limit(0)).collect() == []
    assert [r.content for r in quotes.conversations(quotes.link_quotes(d)).where("root_conv = 1").orderBy("position").collect()][-1] == "Thanks"


def test_quotes_link_inside_their_conversation_first(spark):
    hello = "Good morning, how can I help you?"
    rows = [(1, 1, "assistant", hello), (1, 2, "user", "Nothing today."), (2, 1, "assistant", hello), (2, 2, "user", "One moment please."), (2, 3, "user", f"> {hello}\nMy order is late."), (2, 4, "assistant", "Sorry."), (3, 1, "user", f"> {hello}\nCopied here.")]
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    parent = {k: (r.parent_conv, r.parent_turn) for k, r in got.items()}
    assert parent[2, 3] == (2, 1) and parent[3, 1] == (1, 1)
    assert {(r.root_conv, r.root_turn) for k, r in got.items() if k[0] == 2} == {(2, 1)}
    assert (got[2, 4].depth, got[2, 4].n_linked, got[2, 3].n_linked) == (2, 0, 1)


def test_trimmed_and_nested_quotes_against_plain_python(spark):
    """Made mail: quotes whole, trimmed to a sentence or wrapped anew, nested, tied, introduced; sources by search."""
    import random
    import re

    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdeghiklmnorstu", k=r.randint(3, 8)))
    sentence = lambda: " ".join(word() for _ in range(r.randint(5, 9))).capitalize() + "."
    rows, paragraphs, want = [], {}, {}
    for conv in range(12):
        for turn in range(6):
            own = " ".join(sentence() for _ in range(r.randint(1, 3)))
            lines = []
            if turn and r.random() < 0.7:
                src = (conv, r.randrange(turn)) if r.random() < 0.7 or not conv else (r.randrange(conv), r.randrange(6))
                quoted = paragraphs[src]
                kind = r.choice(["whole", "trimmed", "wrapped"])
                if kind == "trimmed":
                    quoted = re.split(r"(?<=[.]) ", quoted)[-1]
                if kind == "wrapped":
                    ws = quoted.split(" ")
                    quoted = "\n> ".join(" ".join(ws[k : k + 4]) for k in range(0, len(ws), 4))
                lines += [f"On Monday {word()} wrote:", "> " + quoted, ""]
                want[conv, turn] = src
            paragraphs[conv, turn] = own
            rows.append((conv, turn, "user", "\n".join([*lines, own])))
    got = {(x.conv_id, x.turn): x for x in quotes.link_quotes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    for at, x in got.items():
        src = want.get(at)
        parent = src or ((at[0], at[1] - 1) if at[1] else (None, None))
        assert (x.parent_conv, x.parent_turn) == parent and x.own_text == paragraphs[at]
        assert (x.n_quotes, x.n_linked) == ((1, 1) if src else (0, 0))
    for root in {(x.root_conv, x.root_turn) for x in got.values()}:
        tree = sorted((x.depth, *at) for at, x in got.items() if (x.root_conv, x.root_turn) == root)
        assert [got[t[1:]].position for t in tree] == list(range(len(tree)))


def test_reply_chains_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(quotes, "ROUNDS", 2, raising=False)  # no number of rounds may bound a chain
    rows = [(1, k, "user", "x") for k in range(40)]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert all((r.root_turn, r.depth, r.position) == (0, r.turn, r.turn) for r in got) and len(got) == 40
