"""Episode titles: the number in them, what platforms agree on, what is shown, file names."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import fold, slug

#: Dashes that separate a number, bounds of a plausible bare number.
DASH, PLAUSIBLE = r"\-–—", (10, 1899)


def marked_pattern(shows: tuple[str, ...] = ()) -> str:
    r"""A number with a marker before it: ``#12``, ``Ep. 12``, ``Episode 12``, or a show's own name."""
    names = "|".join(rf"\b{re.escape(s).replace(re.escape(' '), r'\s*')}" for s in shows)
    return rf"(?i)(?:(?:{names + '|' if names else ''}\bep(?:isode)?\.?)[\s{DASH}:#|]*|#\s*)([0-9]{{1,4}})\b"


LEADING, TRAILING = rf"^\s*([0-9]{{1,4}})\s*[{DASH}:|]", rf"(?:^|[\s|:{DASH}])([0-9]{{1,4}})\s*$"
EDGES = rf"^[\s|:.{DASH}]+|[\s|:{DASH}]+$"


def _number(title: Column, pattern: str) -> Column:
    return F.regexp_extract(title, pattern, 1).try_cast("int")


def _tidy(rest: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(rest, EDGES, ""), F.lit("")), title)


def _without(title: Column, pattern: str, number_only: bool) -> Column:
    """The title without the pattern's first match, or only without the digits in it."""
    whole = F.regexp_extract(title, pattern, 0)
    at = F.call_function("locate", whole, title)
    left = F.regexp_replace(whole, "[0-9]+", "") if number_only else F.lit("")
    return F.concat(F.substring(title, F.lit(1), at - 1), left, F.substring(title, at + F.char_length(whole), F.lit(1 << 30)))


def split_title(title: Column, feed_number: Column, shows: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """(number, title without its marker): the feed's number wins, then a marked one, then a plausible bare one.

    A bare number leads before a separator or trails after one; it is plausible if it is the feed's, or
    without that one within PLAUSIBLE.  A marker is cut whatever its number is.
    """
    feed, marked = feed_number.cast("int"), marked_pattern(shows)

    def plausible(pattern: str) -> Column:
        n = _number(title, pattern)
        return title.rlike(pattern) & F.coalesce(F.when(feed.isNotNull(), n == feed).otherwise(n.between(*PLAUSIBLE)), F.lit(False))

    has = title.rlike(marked)
    number = F.when(has, F.coalesce(feed, _number(title, marked))).when(plausible(LEADING), _number(title, LEADING)).when(plausible(TRAILING), _number(title, TRAILING)).otherwise(feed)
    rest = F.when(has, _without(title, marked, False)).when(plausible(LEADING), _without(title, LEADING, True)).when(plausible(TRAILING), _without(title, TRAILING, True)).otherwise(title)
    return number, _tidy(rest, title)


def display_title(title: Column, number: Column, shows: tuple[str, ...] = ()) -> Column:
    """The title without its own number, marked, leading or trailing; another number's marker stays."""
    own = F.pandas_udf(lambda t, n: t.combine(n, lambda a, b: _display(a, b, shows)), "string")
    return F.when(number.isNull() | ~title.rlike("[0-9]"), title).otherwise(own(title, number.cast("double")))


def _display(title: str | None, number, shows: tuple[str, ...]) -> str | None:
    if title is None or number is None or number != number:
        return title
    for pattern, whole in ((marked_pattern(shows), True), (LEADING, False), (TRAILING, False)):
        for m in re.finditer(pattern, title):
            if int(m[1]) == int(number):
                a, b = m.span(0 if whole else 1)
                return re.sub(EDGES, "", title[:a] + title[b:]) or title
    return title


def platform_title(title: Column, shows: tuple[str, ...] = ()) -> Column:
    """What platforms agree on: no number marker, apostrophe, mark or punctuation, lower case."""
    rest = F.lower(split_title(title, F.lit(None), shows)[1])
    plain = fold(F.regexp_replace(rest, "['’‘ʼ]", ""))
    return F.trim(F.regexp_replace(plain, r"(?U)[\W_]+", " "))


def plain_ascii(text: str) -> str:
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


def stems(episodes: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """``episodes`` (id, published, number, title) with ``stem``: date, number and slug; repeats get -2, -3 in order of id.

    ``taken`` (stem) are names in use; a repeated base counts on from those that start with it.
    """
    base = F.concat_ws("_", F.date_format("published", "yyyy-MM-dd"), F.when(F.col("number").isNotNull(), F.concat(F.lit("ep"), F.lpad(F.col("number").cast("string"), F.greatest(F.lit(3), F.char_length(F.col("number").cast("string"))), F.lit("0")))), slug(F.col("title")))
    rows = episodes.withColumn("_base", base)
    used = None
    if taken is not None:
        used = taken.select(F.regexp_replace("stem", "-[0-9]+$", "").alias("_base")).groupBy("_base").agg(F.count("*").alias("_used"))
        rows = rows.join(used, "_base", "left")
    else:
        rows = rows.withColumn("_used", F.lit(0))
    n = F.row_number().over(Window.partitionBy("_base").orderBy("id")) + F.coalesce("_used", F.lit(0))
    return rows.withColumn("_n", n).withColumn("stem", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), "_n"))).drop("_base", "_n", "_used")


def id_slugs(queries: DataFrame, text: str = "query", longest: int = 48) -> DataFrame:
    """``queries`` (ord, text) with ``case_id``: whole words of the query up to ``longest`` characters, repeats numbered from 2."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0))
    grow = F.aggregate(words, F.struct(F.lit("").alias("s"), F.lit(True).alias("open")), lambda a, w: F.struct(
        F.when(a["open"] & (F.char_length(a["s"]) + F.when(a["s"] == "", 0).otherwise(1) + F.char_length(w) <= longest), F.concat_ws("-", F.nullif(a["s"], F.lit("")), w)).otherwise(a["s"]).alias("s"),
        (a["open"] & (F.char_length(a["s"]) + F.when(a["s"] == "", 0).otherwise(1) + F.char_length(w) <= longest)).alias("open")), lambda a: a["s"])
    base = F.coalesce(F.nullif(grow, F.lit("")), F.substring(F.get(words, 0), 1, longest), F.lit("case"))
    rows = queries.withColumn("_base", base).withColumn("_n", F.row_number().over(Window.partitionBy("_base").orderBy("ord")))
    return rows.withColumn("case_id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), "_n"))).drop("_base", "_n")
