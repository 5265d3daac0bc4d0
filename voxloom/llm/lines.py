"""Fuzzy line dedup: character-shingle signatures, MinHash bands, exact Jaccard check, union-find.

Only DataFrame functions.  A line's signature holds twelve MinHash values of all its shingles of 12
bytes: four independent 32-bit hashes, each ordered three ways (xor with a constant).  Generated code takes
four shingles a row into a map-side aggregate, so neither a line's length nor its copies matter.  The
values form three groups, one of each hash; a band is three of a group's four.  At similarity s a group has a
band in common with chance p = s^4 + 4 s^3 (1 - s), so a pair is missed with chance (1 - p)^3: 0.6 % at
0.8, 0.01 % at 0.9, less for small sets.  Candidates whose signatures agree in AGREE of twelve places
are compared exactly, on all shingles of 12 characters (at 0.8 fewer agree with a chance of 0.4 %).

A bucket's members meet its earliest line as rows.  What stays apart in larger buckets is compared inside blocks, as
rows of pairs would grow with the square of a group: sketches rule pairs out there without loss: bit (hash mod 2,048) of a line's sketch tells whether it
has shingles there, so two sketches differ in no more bits than the sets differ in shingles, which for
linked lines is (|A| + |B|) (100 - percent) / (100 + percent) at most.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .shared import components, write_table

#: Shorter lines are never removed.
MIN_CHARS = 20
PERCENT = 80
#: Characters (in signatures, UTF-8 bytes) in a shingle.
WIDTH = 12
#: Independent hashes, orders of each, and shingles a row of the signing code.
HASHES, ORDERS, UNROLL = 4, 3, 4
MINS = HASHES * ORDERS
#: Places in which the signatures of compared lines agree, at least.
AGREE = 6
#: 64-bit words of a sketch.
SKETCH = 32
#: Lines in a block of the completing comparison.
BLOCK = 128
#: Characters of such a block's lines.
WIDE = 1 << 20
#: Tables are broadcast up to so many bytes, counted from their rows; beyond, joins shuffle.
BROADCAST_BYTES = 48 << 20
#: For tables of hashes and texts, whose values hardly repeat.
PLAIN = {"parquet.enable.dictionary": "false"}


def _small(df: DataFrame, row_bytes: int, items: str = "0") -> DataFrame:
    """The table, written; to be broadcast if it is small: ``row_bytes`` a row and 8 for each of ``items``."""
    df = write_table(df, "lines-side")
    size = df.agg(F.coalesce(F.sum(F.expr(f"bigint({items})")) * 8 + F.count("*") * row_bytes, F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """Rows (doc_id, no, line): the lines long enough, lower-cased and trimmed, numbered from 0."""
    split = F.split(F.lower(F.col(text).cast("string")), "\n")
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.posexplode(split).alias("no", "line"))
    return rows.select("doc_id", "no", F.trim("line").alias("line")).where(F.char_length("line") >= MIN_CHARS)


def _shingles_sql(line: str) -> str:
    """SQL: distinct 64-bit hashes of a line's shingles, by code points.

    The bytes are bound to a lambda's variable, so they are made once, and each is cut out in constant time.
    """
    every = f"transform(sequence(1, greatest(1, length(w) - {4 * WIDTH - 1}), 4), i -> xxhash64(substring(w, i, {4 * WIDTH})))"
    return f"array_distinct(transform(array(encode({line}, 'UTF-32')), w -> {every})[0])"


def _shingles(line: str) -> Column:
    return F.expr(_shingles_sql(line))


def signatures(lines: DataFrame) -> DataFrame:
    """Rows (h1, h2, at, most, m0 .. m11) of the distinct lines in ``lines`` (at, h1, h2, line): first and last place, signature.

    UNROLL shingles share a row, the last ones standing in for those past the end.
    """
    rows = lines.select("h1", "h2", "at", F.col("line").cast("binary").alias("w"))
    rows = rows.select("h1", "h2", "at", "w", F.expr(f"greatest(0, length(w) - {WIDTH})").alias("last"))
    rows = rows.select("h1", "h2", "at", "w", "last", F.explode(F.expr(f"sequence(0, last, {UNROLL})")).alias("i"))
    rows = rows.select("h1", "h2", "at", *[F.expr(f"xxhash64(substring(w, least(i + {u}, last) + 1, {WIDTH}))").alias(f"x0_{u}") for u in range(UNROLL)])
    for k in range(1, HASHES // 2):
        rows = rows.select("*", *[F.xxhash64(f"x{k - 1}_{u}").alias(f"x{k}_{u}") for u in range(UNROLL)])
    halves = ("int(shiftright({x}, 32))", "int(shiftright(shiftleft({x}, 32), 32))")
    rows = rows.select("h1", "h2", "at", *[F.expr(halves[s % 2].format(x=f"x{s // 2}_{u}")).alias(f"v{s}_{u}") for s in range(HASHES) for u in range(UNROLL)])
    least = [F.expr(f"min(least({', '.join(f'v{s}_{u} ^ ({_order(p)})' for u in range(UNROLL))}))") for p in range(ORDERS) for s in range(HASHES)]
    return rows.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.max("at").alias("most"), *[m.alias(f"m{k}") for k, m in enumerate(least)])


def _order(p: int) -> int:
    """A 32-bit constant whose first two bits are ``p``; the least value xor it is that nearest to it."""
    bits = (p << 30) | (0x9E3779B9 * (p + 1) & 0x3FFFFFFF)
    return bits - (1 << 32) if bits >> 31 else bits


def _halves(signed: DataFrame) -> DataFrame:
    """Rows (key, at, g, v0 .. v3): two keys for each group g of four values, one for each two of them."""
    pick = [F.struct(F.xxhash64(F.lit(2 * g + k), f"m{4 * g + 2 * k}", f"m{4 * g + 2 * k + 1}").alias("key"), F.lit(g).alias("g"), *[F.col(f"m{4 * g + v}").alias(f"v{v}") for v in range(4)]) for g in range(ORDERS) for k in range(2)]
    return signed.select("at", F.explode(F.array(*pick)).alias("p")).select("at", "p.*")


def _banded(signed: DataFrame) -> DataFrame:
    """Rows (key, at): keys for each three of the four values of a group, where another line has such a key or may have.

    Lines that agree in three of four agree in the first two or the last two, so only groups with
    a common key for two of their values get keys for three: half the rows, and the same buckets.
    """
    halves = _halves(signed)
    hot = halves.groupBy("key").agg(F.min("at").alias("least"), F.max("at").alias("most")).where("least <> most").select("key")
    some = halves.join(_small(hot, 24), "key").select("at", "g", *[f"v{v}" for v in range(HASHES)]).distinct()
    keys = [F.xxhash64(F.lit(k), "g", *[f"v{i}" for i in c]) for k, c in enumerate(combinations(range(HASHES), 3))]
    return some.select(F.explode(F.array(*keys)).alias("key"), "at")


def _agree(x: str, y: str) -> str:
    return " + ".join(f"int({x}.m{k} = {y}.m{k})" for k in range(MINS)) + f" >= {AGREE}"


def _fits(x: str, y: str, percent: int) -> str:
    """SQL: what signatures and sketches of linked lines meet; sketches lose nothing (n is the set's size or more)."""
    differ = " + ".join(f"bit_count({x}.o{k} ^ {y}.o{k})" for k in range(SKETCH))
    return f"{_agree(x, y)} AND {100 + percent} * ({differ}) <= {100 - percent} * ({x}.n + {y}.n)"


def _sketched(texts: DataFrame) -> DataFrame:
    """``texts`` (at, m, line) with the number of each line's shingles, with repeats, and its sketch put into ``m``."""
    rows = texts.select("at", F.expr("encode(line, 'UTF-32')").alias("w"))
    rows = rows.select("at", "w", F.expr(f"int(greatest(0, length(w) div 4 - {WIDTH}))").alias("last"))
    rows = rows.select("at", "w", "last", F.explode(F.expr(f"sequence(0, last, {UNROLL})")).alias("i"))
    rows = rows.select("at", "last", *[F.expr(f"xxhash64(substring(w, 4 * least(i + {u}, last) + 1, {4 * WIDTH}))").alias(f"h{u}") for u in range(UNROLL)])
    rows = rows.select("at", "last", *[F.expr(e).alias(f"{c}{u}") for u in range(UNROLL) for c, e in (("k", f"int(shiftright(h{u}, 6) & {SKETCH - 1})"), ("b", f"shiftleft(1L, int(h{u} & 63))"))])
    words = [F.expr(f"bit_or({' | '.join(f'IF(k{u} = {k}, b{u}, 0L)' for u in range(UNROLL))})").alias(f"o{k}") for k in range(SKETCH)]
    made = rows.groupBy("at").agg((F.max("last").cast("bigint") + 1).alias("n"), *words)
    m = F.struct("m.*", "n", *[f"o{k}" for k in range(SKETCH)])
    return texts.join(made, "at").select("at", m.alias("m"), "line")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of lines whose shingle sets reach the similarity."""
    a, b = (texts.select(F.col("at").alias(x), F.col("m").alias(f"m{x}"), F.col("line").alias(f"l{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").where(_agree("ma", "mb"))
    sets = both.select("a", "b", _shingles("la").alias("s"), _shingles("lb").alias("t"))
    # in a generator, not a filter: that would be pushed down and make the sets again for each mention
    return sets.select("a", "b", F.explode(F.expr(f"IF({_near('s', 't', percent)}, array(1), CAST(array() AS array<int>))"))).select("a", "b")


def _near(s: str, t: str, percent: int) -> str:
    """SQL: whether two sets, not both empty, reach the similarity."""
    sizes = f"100 * least(size({s}), size({t})) >= {percent} * greatest(size({s}), size({t}))"
    return f"{sizes} AND {100 + percent} * size(array_intersect({s}, {t})) >= {percent} * (size({s}) + size({t}))"


def _forest(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components in each block (xs, ys: arrays of (comp, at, light, line and what ``_fits`` takes)), as few as join them.

    What signatures and sketches leave is listed by place inside the row, and the sets of lines listed are made
    once.  A pair is compared if nothing in this block has joined its components, so a block gives fewer links
    than it has components, and no pair becomes a row unless it is one of them.
    """
    fit = f"y.comp <> x.comp AND (NOT y.light OR x.at < y.at) AND {_fits('x', 'y', percent)}"
    listed = f"filter(transform(ys, (y, j) -> IF({fit}, struct(i AS i, j AS j, x.comp AS k, y.comp AS l), NULL)), p -> p IS NOT NULL)"
    rows = blocks.select("xs", "ys", F.expr(f"flatten(transform(xs, (x, i) -> {listed}))").alias("ps"))
    rows = rows.select("xs", "ys", "ps", F.explode(F.expr("array_repeat(1, least(size(ps), 1))")).alias("any"))
    sets = [F.expr(f"transform({v}, (z, i) -> IF(exists(ps, p -> p.{p} = i), {_shingles_sql('z.line')}, NULL))").alias(f"s{v}") for v, p in (("xs", "i"), ("ys", "j"))]
    comps = "array_distinct(concat(transform(ps, p -> p.k), transform(ps, p -> p.l)))"
    rows = rows.select("ps", *[F.expr(f"transform({v}, z -> z.at)").alias(f"a{v}") for v in ("xs", "ys")], *sets, F.expr(comps).alias("comps"))
    k, l = (f"acc.lab[int(array_position(comps, p.{c})) - 1]" for c in "kl")
    joined = f"struct(transform(acc.lab, z -> IF(z = {l}, {k}, z)) AS lab, array_append(acc.links, struct(axs[p.i] AS a, ays[p.j] AS b)) AS links)"
    step = f"IF({k} <> {l} AND {_near('sxs[p.i]', 'sys[p.j]', percent)}, {joined}, acc)"
    start = "struct(comps AS lab, CAST(array() AS array<struct<a: bigint, b: bigint>>) AS links)"
    return rows.select(F.explode(F.expr(f"aggregate(ps, {start}, (acc, p) -> {step}, acc -> acc.links)")).alias("l")).select("l.a", "l.b")


def _across(shared: DataFrame, labels: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links between different components that some bucket holds together, as many as join them.

    A bucket of two has been compared whole, as pivot and member, and a bucket of one component needs nothing.
    In the others the component with most members is the base; under each base the
    members of others (``light``) meet all members of those buckets.  Both sides are dealt into blocks of
    about BLOCK lines, or WIDE characters; a block's pairs meet inside one row (``_forest``).
    """
    known = shared.join(_small(labels, 32), F.col("at") == F.col("id"), "left").select("key", "at", F.coalesce("component", "at").alias("comp"))
    mixed = known.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("n")).where("least <> most AND n > 2").select("key")
    known = write_table(known.join(_small(mixed, 24), "key"), "line-members")
    per = known.groupBy("key", "comp").agg(F.count("*").alias("c"))
    bases = per.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m")).select("key", F.col("m.comp").alias("base"))
    under = known.join(bases, "key").select("base", "at", "comp", (F.col("comp") != F.col("base")).alias("light")).distinct()
    under = write_table(under.join(texts.select("at", "wide"), "at"), "line-mixed")
    most = "int(ceil(greatest(count({0}) / {1}, coalesce(sum({2}), 0) / {3})))"
    size = under.groupBy("base").agg(F.expr(most.format("1", BLOCK, "wide", WIDE)).alias("cols"), F.expr(most.format("IF(light, 1, NULL)", BLOCK, "IF(light, wide, NULL)", WIDE)).alias("rows"))
    dealt = under.join(size, "base")
    light = dealt.where("light").select("base", "at", "comp", "light", F.pmod(F.xxhash64("at", F.lit(1)), "rows").cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"), F.lit(True).alias("x"))
    every = dealt.select("base", "at", "comp", "light", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), F.pmod(F.xxhash64("at", F.lit(2)), "cols").cast("int").alias("c"), F.lit(False).alias("x"))
    sketched = write_table(_sketched(texts.join(under.select("at").distinct(), "at", "left_semi")), "line-sketches")
    placed = light.unionByName(every).join(sketched, "at")
    item = F.struct("comp", "at", "light", "line", "m.*")
    blocks = placed.groupBy("base", "r", "c").agg(F.collect_list(F.when(F.col("x"), item)).alias("xs"), F.collect_list(F.when(~F.col("x"), item)).alias("ys"))
    return _forest(blocks, percent)


def duplicate_lines(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, gone): the line numbers, from 0, that repeat an earlier line or one like it.

    Lines are lower-cased and trimmed; those under MIN_CHARS characters are left alone.  Lines are
    linked when ``100 * |A & B| >= percent * |A | B|`` over all distinct shingles, and
    each component keeps its first line by (doc_id, number).  Equal lines (128-bit hashes) are one node, named by
    the place of the first; a bucket's members meet its earliest, and pairs of a bucket that stay apart
    after that are compared in blocks.  A component's label is its first place, so nothing is
    joined on components.  Rows that share an id are one document; rows with a null id are left out.
    """
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is not None and high - low >= 1 << 32:  # places hold 32 bits of an id: ids by rank, so that order stays
        ranks = write_table(numbered(docs.select(F.col("doc_id").alias("id")).distinct(), ["id"], "rank"), "line-ranks")
        ranked = docs.join(ranks, docs["doc_id"] == ranks["id"]).select(F.col("rank").cast("bigint").alias("doc_id"), "text")
        gone = _gone(ranked, 0, percent)
        return gone.join(ranks, gone["doc_id"] == ranks["rank"]).select(F.col("id").alias("doc_id"), "gone")
    return _gone(docs, low or 0, percent)


def _gone(docs: DataFrame, low: int, percent: int) -> DataFrame:
    """``duplicate_lines`` of rows (doc_id, text) with ids from ``low`` to under ``low + 2^32``; a place is (doc_id - low) * 2^31 + no."""
    place = F.shiftleft(F.col("doc_id") - F.lit(low).cast("bigint"), 31).bitwiseOR(F.col("no").cast("bigint"))
    lines = write_table(_lines(docs, "text").select(place.alias("at"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "line"), "lines", **PLAIN)
    signed = write_table(signatures(lines), "line-signatures", **PLAIN)
    keyed = write_table(_banded(signed), "line-keys")
    hot = keyed.groupBy("key").agg(F.min("at").alias("pivot"), F.max("at").alias("most")).where("pivot <> most").select("key", "pivot")
    shared = write_table(keyed.join(_small(hot, 32), "key"), "line-buckets")
    pairs = write_table(shared.where("at <> pivot").select(F.col("pivot").alias("a"), F.col("at").alias("b")).distinct(), "line-pairs")
    touched = _small(shared.select("at").distinct(), 24)
    texts = lines.select("at", "line").join(touched, "at").join(signed.select("at", F.struct(*[f"m{k}" for k in range(MINS)]).alias("m")).join(touched, "at"), "at")
    texts = write_table(texts.select("at", "m", "line", F.char_length("line").alias("wide")), "line-texts")
    links = write_table(_verified(pairs, texts, percent), "line-links")
    labels = components(links, "line-star")
    more = write_table(_across(shared.select("key", "at"), labels, texts, percent), "line-more")
    if not more.isEmpty():
        labels = components(links.union(more), "line-all")
    decided = signed.select("h1", "h2", "at", "most").join(_small(labels, 32), F.col("at") == F.col("id"), "left")
    decided = decided.where("at <> most OR component IS NOT NULL").select("h1", "h2", F.coalesce("component", "at").alias("first"))
    gone = lines.select("at", "h1", "h2").join(_small(decided, 40), ["h1", "h2"]).where("at <> first")
    gone = gone.select((F.shiftright("at", 31) + F.lit(low).cast("bigint")).alias("doc_id"), F.col("at").bitwiseAND(F.lit((1 << 31) - 1).cast("bigint")).cast("int").alias("no"))
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("no")).alias("gone"))


def dedup_lines(docs: DataFrame, text: str = "text", percent: int = PERCENT, empty: str = "drop") -> DataFrame:
    """``docs`` with repeated lines taken out of the text; other columns as they were.

    A document of which nothing but blank lines is left is dropped (``empty="keep"`` keeps it).
    Null texts and rows with null ids stay as they are.  Columns of any name are carried: the document
    travels as one struct beside the lines to drop.
    """
    gone = _small(duplicate_lines(docs, text, percent), 48, "size(gone)")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    both = whole.join(gone, F.col("doc.doc_id").cast("bigint") == F.col("doc_id"), "left")
    old = F.col("doc")[text].cast("string")
    kept = F.array_join(F.filter(F.split(old, "\n"), lambda line, i: ~F.array_contains(F.col("gone"), i)), "\n")
    new = F.when(F.col("gone").isNull(), old).otherwise(kept)
    out = both.select("doc", F.col("gone").isNull().alias("whole"), new.alias("left"))
    if empty == "drop":
        out = out.where(F.col("whole") | F.coalesce("left", F.lit("")).rlike(r"\S"))
    return out.select(*[F.col("left").alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns])
