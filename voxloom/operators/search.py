"""Full-text search: postings, boolean and phrase matching, BM25, highlighting.

The inverted index is a DataFrame (id, pos, term, stem); every query is a semi-join of its few stems
with it, so a query touches only its own postings.  Write the index partitioned or bucketed by
stem to make that a partition read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import porter
from ..functions.text import tokens
from ..plans.querylang import Phrase, Query

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_col: str, text: str, stemmed: bool = True) -> DataFrame:
    """Rows (id, pos, term, stem); ``stem`` is the term itself when not stemmed.

    Python sees distinct terms only; the stems come back through a join on the term.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(tokens(F.col(text))).alias("pos", "term"))
    if not stemmed:
        return rows.withColumn("stem", F.col("term"))
    return rows.join(porter.stems(rows), "term").select("id", "pos", "term", "stem")


def lengths(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Rows (id, dl) of all documents, empty ones too: they count in the average."""
    return docs.select(F.col(id_col).alias("id"), F.size(tokens(F.col(text))).alias("dl"))


def _stems(phrase: Phrase, stemmed: bool) -> list[str]:
    import re
    import unicodedata

    from ..functions.text import MARKED, PLAIN

    text = phrase.text.lower().translate(str.maketrans(MARKED, PLAIN))
    words = [w for w in re.split(r"[\W_]+", text) if w and any(unicodedata.category(c)[0] in "LN" for c in w)]
    return [porter.stem(w) if stemmed else w for w in words]


def _is(index: DataFrame, stem: str):
    """The stem's postings; of a stored index, only its bucket's files are read."""
    fits = F.col("stem") == stem
    if "bucket" in index.columns:
        from .index import bucket_of

        fits = fits & (F.col("bucket") == bucket_of(stem))
    return fits


def phrase_hits(index: DataFrame, phrase: Phrase, stemmed: bool = True) -> DataFrame:
    """Rows (id, pos): where the phrase's stems stand in a row; a prefix applies to the last."""
    words = _stems(phrase, stemmed)
    if not words:
        return index.select("id", "pos").limit(0)
    out = None
    for k, w in enumerate(words):
        fits = F.col("stem").startswith(w) if phrase.prefix and k == len(words) - 1 else _is(index, w)
        some = index.where(fits).select("id", (F.col("pos") - k).alias("pos"))
        out = some if out is None else out.join(some, ["id", "pos"], "left_semi")
    return out


def scores(index: DataFrame, sizes: DataFrame, query: Query, stemmed: bool = True) -> DataFrame:
    """Rows (id, score) of the documents that match: BM25 as negative numbers, lower is better.

    The unit is the phrase, repeats count again, statistics cover all documents, and an idf that
    is not positive becomes 1e-6.  Without a positive phrase nothing matches.
    """
    phrases = [p for g in query.groups for p in g]
    if not phrases:
        return sizes.select("id", F.lit(0.0).alias("score")).limit(0)
    tagged = [phrase_hits(index, p, stemmed).select("id", F.lit(i).alias("phrase")) for i, p in enumerate(phrases)]
    tf = reduce(DataFrame.unionAll, tagged).groupBy("id", "phrase").agg(F.count("*").alias("tf"))
    n = tf.groupBy("phrase").agg(F.count("*").alias("n"))
    whole = sizes.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))
    idf = F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weights = n.join(F.broadcast(whole)).select("phrase", "avgdl", F.when(idf <= 0, 1e-6).otherwise(idf).alias("idf"))  # a row a phrase
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    rows = tf.join(F.broadcast(weights), "phrase").join(sizes, "id")
    seen = [F.max(F.when(F.col("phrase") == i, True)).alias(f"p{i}") for i in range(len(phrases))]
    rows = rows.groupBy("id").agg(F.sum(-part).alias("score"), *seen)
    at, needed = 0, []
    for g in query.groups:
        needed.append(reduce(lambda a, b: a | b, [F.coalesce(F.col(f"p{at + i}"), F.lit(False)) for i in range(len(g))]))
        at += len(g)
    rows = rows.where(reduce(lambda a, b: a & b, needed)).select("id", "score")
    for p in query.negative:
        rows = rows.join(phrase_hits(index, p, stemmed).select("id").distinct(), "id", "left_anti")
    return rows


def highlight(docs: DataFrame, id_col: str, text: str, words: list[str], stemmed: bool = False) -> DataFrame:
    """Rows (id, start, end, token): code-point ranges of matching tokens, and their token number.

    Matches and gaps alternate, so lengths of split pieces add up to positions, natively.
    """
    pattern = r"[\p{L}\p{N}]+"
    rows = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("w"), F.split(text, pattern, -1).alias("g"))
    rows = rows.select("id", "w", "g", F.posexplode("w").alias("token", "word"))
    start = F.aggregate(F.slice("g", 1, F.col("token") + 1), F.lit(0), lambda a, x: a + F.char_length(x)) + F.aggregate(
        F.slice("w", 1, F.col("token")), F.lit(0), lambda a, x: a + F.char_length(x)
    )
    from ..functions.text import fold

    rows = rows.where(fold(F.col("word")).isin(words))
    return rows.select("id", start.alias("start"), (start + F.char_length("word")).alias("end"), "token")


def exact_page(matches: DataFrame, sort: list, page: int, limit: int, caps: tuple[int, int] = (200, 1000)) -> DataFrame:
    """A page of matches with total, total_capped, truncated and has_more (capped counts)."""
    shown, counted = caps
    rows = max(0, min(limit, shown - (page - 1) * limit))
    n = matches.limit(counted + 1).agg(F.count("*").alias("n"))
    ranked = matches.orderBy(*sort).limit((page - 1) * limit + rows)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(*sort))).where(F.col("rank") > (page - 1) * limit)
    return ranked.join(F.broadcast(n)).select(
        *ranked.columns, F.least("n", F.lit(counted)).alias("total"), (F.col("n") > counted).alias("total_capped"),
        (F.col("n") > shown).alias("truncated"), (F.lit(page * limit) < F.least("n", F.lit(shown))).alias("has_more"),
    )
