"""Scalar text functions as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _marked() -> tuple[str, str]:
    """Lower-case Latin letters with one mark, by Unicode's decompositions, and the letters under them."""
    found = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) == 2 and "a" <= parts[0] <= "z" and unicodedata.combining(parts[1]):
            found[c] = parts[0]
    return "".join(found), "".join(found.values())


#: Latin letters with marks and the letters that search treats them as.
MARKED, PLAIN = _marked()


def fold(text: Column) -> Column:
    """Lower-cased, without marks on Latin letters."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits; null and empty text give an empty array."""
    return F.array_remove(F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def squeeze(text: Column) -> Column:
    """Lower-cased, white space collapsed and trimmed (log queries)."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def run_token(word: Column) -> Column:
    """A word as repeated-passage detection sees it: a-z, 0-9 and apostrophes."""
    return F.regexp_replace(F.lower(word), r"[^a-z0-9']+", "")


def correction_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\w']+", "")


def slug(title: Column, longest: int = 60) -> Column:
    """Words joined by hyphens, cut at a word boundary; nothing left is "untitled"."""
    s = F.regexp_replace(F.regexp_replace(fold(title), r"['’]", ""), r"[^a-z0-9]+", "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    cut = F.regexp_replace(F.substring(s, 1, longest + 1), r"-[^-]*$", "")
    return F.when(s == "", "untitled").when(F.char_length(s) <= longest, s).otherwise(F.substring(cut, 1, longest))


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s.cast("bigint"))).otherwise(F.format_string("%d:%02d", m, s.cast("bigint")))


def parse_clock(text: Column) -> Column:
    """Seconds of s, m:ss or h:mm:ss (parts after the first under 60); else null."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: F.when(p.rlike(r"^\d{1,5}$"), p.cast("int")))
    fine = (F.size(parts) <= 3) & F.forall(parts, lambda p: p.isNotNull()) & F.forall(F.slice(parts, 2, 2), lambda p: p < 60)
    return F.when(fine, F.aggregate(parts, F.lit(0), lambda a, p: a * 60 + p))


def feed_duration(text: Column) -> Column:
    """Seconds of a feed's duration field, any number of base-60 parts; bad parts give null."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: F.when(F.trim(p).rlike(r"^\d+$"), F.trim(p).cast("int")))
    return F.when(F.forall(parts, lambda p: p.isNotNull()), F.aggregate(parts, F.lit(0), lambda a, p: a * 60 + p))


def iso_duration(text: Column) -> Column:
    """Seconds of an ISO-8601 duration of days, hours, minutes and seconds; else null."""
    pattern = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("int"), F.lit(0))
    return F.when(text.rlike(pattern), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4))


def base_url(url: Column) -> Column:
    """A url without query and fragment."""
    return F.regexp_replace(url, r"[?#].*$", "")


def text_sha(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def decode_times(start_ms: Column, encoded: Column) -> Column:
    """Word starts of a comma-separated list of differences; anything malformed gives no times."""
    steps = F.transform(F.split(encoded, ","), lambda x: x.try_cast("bigint"))
    fold_ = F.aggregate(
        steps, F.struct(start_ms.cast("bigint").alias("t"), F.array().cast("array<bigint>").alias("out")),
        lambda a, d: F.struct((a["t"] + d).alias("t"), F.concat(a["out"], F.array(a["t"] + d)).alias("out")), lambda a: a["out"],
    )
    return F.when(F.forall(steps, lambda x: x.isNotNull()), fold_).otherwise(F.array().cast("array<bigint>"))


def encode_times(start_ms: Column, times: Column) -> Column:
    """Differences of word starts, the first from the passage's start, comma-separated."""
    return F.array_join(F.transform(times, lambda t, i: (t - F.when(i == 0, start_ms.cast("bigint")).otherwise(F.get(times, i - 1))).cast("string")), ",")


def cue_seconds(hit_ms: Column, offset_s: Column, lead_s: int = 7) -> Column:
    """Where a player starts: whole seconds less the lead, moved by the platform's offset, never below 0."""
    return F.greatest(F.lit(0).cast("bigint"), F.floor(hit_ms / 1000) - lead_s + offset_s)


def capped_count(n: Column, capped: Column) -> Column:
    return F.concat(F.format_number(n, 0), F.when(capped, "+").otherwise(""))


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Cc}", "")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, summed in double; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size)
