"""Quotation linking: messages without quotes, ordered by what they reply to.

A message's lines carry a quote level (its leading ``>`` marks).  Runs of quoted lines are split
into passages by level, normalised and hashed, whole and by sentence; so are the paragraphs that messages
wrote themselves.  A quoted passage is linked to the earliest message of its own conversation that wrote
it before (whole if any did, else a sentence of it, as when a quote was trimmed or wrapped anew), and only
where there is none to the earliest of all.  The reply's parent is the source of its shallowest quote,
or else the turn before it in the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import before, numbered
from .shared import write_table

#: Shorter passages (normalised) are not linked: greetings would link everything.
MIN_CHARS = 16
MARKS = r"^(?:[ \t]?>)+ ?"
#: A line that only introduces the quote after it.
INTRODUCES = r"(?i)^.{0,200}\b(?:wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$"
SENTENCE = r"(?<=[.!?])\s+|\n"


def _plain(text: Column) -> Column:
    """Letters and digits of all scripts, lower-cased, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def lines_of(messages: DataFrame) -> DataFrame:
    """Adds ``parts``: runs of lines of one quote level, as structs (level, text); lines that introduce a quote are left out."""
    split = F.transform(
        F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n"),
        lambda x: F.struct(
            (F.char_length(F.regexp_extract(x, MARKS, 0)) - F.char_length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), ">", ""))).alias("level"),
            F.regexp_replace(x, MARKS, "").alias("line"),
        ),
    )
    out = messages.withColumn("_lines", split)
    out = out.withColumn("_lines", F.expr(f"filter(_lines, (x, i) -> NOT (x.level = 0 AND coalesce(get(_lines, i + 1).level, 0) > 0 AND x.line RLIKE r\"{INTRODUCES}\"))"))
    # where a run begins: another level, or a blank line before
    begin = F.expr("filter(transform(_lines, (x, i) -> IF(i = 0 OR _lines[i - 1].level <> x.level OR trim(_lines[i - 1].line) = '', i, NULL)), i -> i IS NOT NULL)")
    out = out.withColumn("_begin", begin)
    run = "slice(_lines, b + 1, coalesce(get(_begin, k + 1), size(_lines)) - b)"
    parts = F.expr(f"transform(_begin, (b, k) -> named_struct('level', _lines[b].level, 'text', array_join(transform({run}, y -> y.line), '\\n')))")
    return out.withColumn("parts", parts).drop("_lines", "_begin")


def link_quotes(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, own_text, n_quotes, n_linked, parent_conv, parent_turn, root_conv, root_turn, depth, position), one per message.

    ``own_text`` is the message without quoted lines; ``parent`` the message replied to, ``root`` the
    first of its chain, ``depth`` the replies up to it and ``position`` the place in the root's
    conversation, by depth, conversation and turn.  A quote links only to a message before it
    (lower (conv_id, turn)); among several sources the earliest of the same conversation wins, then the
    earliest of all, so a passage that many messages hold is one row per conversation on its side of
    the first join and one on the second.  Null texts are empty; rows with a null conv_id or
    turn are left out; repeated (conv_id, turn) rows are one message, its least text standing.
    """
    rows = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.groupBy("conv_id", "turn").agg(F.min(F.struct("text", "role")).alias("m")).select("conv_id", "turn", "m.role", "m.text")
    rows = lines_of(rows)
    own = F.regexp_replace(F.array_join(F.transform(F.filter("parts", lambda p: p["level"] == 0), lambda p: p["text"]), "\n"), r"^\s+|\s+$", "")
    rows = write_table(rows.withColumn("own_text", own), "messages")
    at = F.struct("conv_id", "turn").alias("at")
    parts = rows.select(at, F.posexplode("parts").alias("no", "p")).select("at", "no", "p.level", _plain(F.col("p.text")).alias("norm"), F.split("p.text", SENTENCE).alias("said"))
    keys = F.array_distinct(F.concat(F.array("norm"), F.transform("said", _plain)))
    parts = parts.select("at", "no", "level", "norm", F.explode(F.filter(keys, lambda k: F.char_length(k) >= MIN_CHARS)).alias("key"))
    parts = parts.select("at", "no", "level", (F.col("key") != F.col("norm")).alias("part"), F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    parts = write_table(parts.withColumn("conv", F.col("at.conv_id")), "passages")
    inside = parts.where("level = 0").groupBy("conv", "h1", "h2").agg(F.min("at").alias("near"))
    sources = inside.groupBy("h1", "h2").agg(F.min("near").alias("far"))
    quotes = parts.where("level > 0").join(inside, ["conv", "h1", "h2"], "left").join(sources, ["h1", "h2"], "left")
    foreign = ~F.coalesce(F.col("near") < F.col("at"), F.lit(False))
    quotes = quotes.select("at", "no", "level", "part", foreign.alias("foreign"), F.when(foreign, F.col("far")).otherwise(F.col("near")).alias("source"))
    fits = F.when(F.col("source") < F.col("at"), F.struct("foreign", "part", "source"))
    quotes = quotes.groupBy("at", "no", "level").agg(F.min(fits).alias("hit"))
    linked = quotes.groupBy("at").agg(F.count("*").alias("n_quotes"), F.count("hit").alias("n_linked"), F.min(F.when(F.col("hit").isNotNull(), F.struct("level", "hit.foreign", "hit.part", "hit.source"))).alias("best"))
    nodes = before(rows.select("conv_id", "turn"), "conv_id", "turn", "prior").withColumn("at", F.struct("conv_id", "turn"))
    nodes = nodes.join(linked, "at", "left")
    parent = F.coalesce("best.source", F.when(F.col("prior").isNotNull(), F.struct("conv_id", F.col("prior").alias("turn"))))
    nodes = write_table(nodes.select("at", F.coalesce("n_quotes", F.lit(0)).cast("bigint").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), parent.alias("parent")), "replies")
    # pointer jumping: in each round a node whose ancestor is no root yet learns of one twice as far
    jump = write_table(nodes.select("at", F.coalesce("parent", "at").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), F.col("parent").isNotNull().alias("open")), "jump-0")
    k = 0
    while not jump.where("open").isEmpty():
        k += 1
        far = jump.select(F.col("at").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        moved = jump.where("open").select("at", "up", "depth").join(far, "up")
        moved = moved.select("at", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("d2") > 0).alias("open"))
        jump = write_table(jump.where("NOT open").unionByName(moved), f"jump-{k}")
    out = rows.drop("parts").withColumn("at", F.struct("conv_id", "turn")).join(nodes, "at").join(jump.select("at", F.col("up").alias("root"), "depth"), "at")
    out = out.select(
        "conv_id", "turn", "role", "text", "own_text", "n_quotes", "n_linked", F.col("parent.conv_id").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"),
        F.col("root.conv_id").alias("root_conv"), F.col("root.turn").alias("root_turn"), "depth",
    )
    placed = numbered(out.select("conv_id", "turn", "root_conv", "root_turn", "depth"), ["depth", "conv_id", "turn"], "position", ["root_conv", "root_turn"])
    placed = placed.select("conv_id", "turn", (F.col("position") - 1).cast("bigint").alias("position"))
    return out.join(placed, ["conv_id", "turn"])


def conversations(linked: DataFrame) -> DataFrame:
    """Rows (root_conv, root_turn, position, role, content): chat messages in reply order, without quotes.

    One row per message rather than one array per conversation, so no conversation has to fit in
    one task's memory.
    """
    return linked.where("own_text <> ''").select("root_conv", "root_turn", "position", "role", F.col("own_text").alias("content"))
