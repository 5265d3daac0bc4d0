"""Player links with cue times, times on command lines, UTF-16 offsets, checked report fields."""

from __future__ import annotations

import re
from datetime import date, datetime, time, timedelta, tzinfo, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cue_seconds

#: Link formats of the platforms.
YOUTUBE, SPOTIFY = "https://www.youtube.com/watch?v={}&t={}s", "https://open.spotify.com/episode/{}?t={}"


def encoded(text: Column) -> Column:
    """A url component: spaces as %20, the marks that browsers leave alone left alone."""
    out = F.url_encode(text)
    for quoted, plain in (("\\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.regexp_replace(out, quoted, plain)
    return out


def _filled(template: str, ident: Column, at: Column) -> Column:
    a, b, c = template.split("{}")
    return F.when(F.coalesce(ident, F.lit("")) != "", F.concat(F.lit(a), encoded(ident), F.lit(b), at.cast("string"), F.lit(c)))


def deep_links(hit_ms: Column, lead_s: int, show_url: str, pages_url: str, page_host: str) -> Column:
    """A struct of links at a hit: youtube, apple, spotify, page, notes; null where the platform has no id."""
    at = {p: cue_seconds(hit_ms, F.col(f"offset_{p}_s"), lead_s) for p in ("youtube", "apple", "spotify")}
    return F.struct(
        _filled(YOUTUBE, F.col("youtube_video_id"), at["youtube"]).alias("youtube"), _filled(show_url + "?i={}&t={}", F.col("apple_episode_id"), at["apple"]).alias("apple"),
        _filled(SPOTIFY, F.col("spotify_episode_id"), at["spotify"]).alias("spotify"), _filled(pages_url + "{}?seek={}", F.col("guid"), cue_seconds(hit_ms, F.lit(0), lead_s)).alias("page"),
        notes_link(F.col("page_url"), page_host).alias("notes"),
    )


def notes_link(url: Column, page_host: str) -> Column:
    """The feed's own page if it is a web address on another host than the player's."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#]*)", 1)), ":[0-9]*$", "")
    return F.when(url.rlike(r"(?i)^https?://[^/?#\s]") & (host != page_host), url)


def published_video(video_id: Column, video_s: Column, feed_s: Column, within: int = 3) -> Column:
    """The video id where its length is the feed's, within a few seconds."""
    return F.when(F.abs(video_s - feed_s) <= within, video_id)


def inserted_ads(seconds: Column, feed_s: Column, more: int = 5) -> Column:
    """Whether a copy is longer than the feed says: advertisements were put in."""
    return F.coalesce(seconds > feed_s + more, F.lit(False))


def whole_copy(seconds: Column, feed_s: Column) -> Column:
    """Whether a download's length can be the episode's: 98 % of the feed's to ten minutes more."""
    return F.coalesce(seconds.between(0.98 * feed_s, feed_s + 600), F.lit(True))


def clipped(start: Column, end: Column, low: Column, high: Column) -> Column:
    """A span cut to [low, high) and moved there; null if nothing is left."""
    a, b = F.greatest(start, low) - low, F.least(end, high) - low
    return F.when(b > a, F.struct(a.alias("start"), b.alias("end")))


def points_of(text: Column, utf16: Column) -> Column:
    """The code-point index of a UTF-16 offset: pairs before it count once."""
    head = F.decode(F.substring(F.encode(text, "UTF-16BE"), F.lit(1), utf16 * 2), "UTF-16BE")
    return F.char_length(head)


def since(text: str) -> timedelta:
    """A span like 30m, 12h or 7d."""
    m = re.fullmatch(r"\s*([0-9]+)([mhd])\s*", text)
    if not m:
        raise ValueError(f"{text!r}: use a span like 30m, 12h or 7d")
    return timedelta(**{{"m": "minutes", "h": "hours", "d": "days"}[m[2]]: int(m[1])})


def day_range(first: str | None, last: str | None, today: date) -> tuple[date, date]:
    """Local days, both included: given dates, ``Nd`` back from today, or the week that ends with ``last``."""
    try:
        end = date.fromisoformat(last.strip()) if last else today
        days = re.fullmatch("([0-9]+)d", (first or "").strip())
        start = end - timedelta(days=6) if first is None else today - timedelta(days=int(days[1]) - 1) if days else date.fromisoformat(first.strip())
    except ValueError:
        raise ValueError("use dates like 2026-10-29 or a span like 7d") from None
    if start > end or (days and int(days[1]) == 0):
        raise ValueError(f"the range from {start} to {end} is empty")
    return start, end


def utc_bounds(first: date, last: date, zone: tzinfo) -> tuple[datetime, datetime]:
    """When the first day begins and the last ends, in UTC."""
    return tuple(datetime.combine(d, time(), zone).astimezone(timezone.utc) for d in (first, last + timedelta(days=1)))  # type: ignore[return-value]


#: Lengths of a report's fields.
LONGEST = {"quoted_text": 4000, "suggested_text": 4000, "note": 1000, "token": 2048}


def report_error(chunk: Column, quoted: Column, suggested: Column, note: Column, token: Column, longest: dict = LONGEST) -> Column:
    """What is wrong with a report's fields, or null.  Without a passage it is feedback: a note and nothing else."""
    def bare(c: Column) -> Column:
        return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))

    def long(c: Column, name: str) -> Column:
        return F.char_length(bare(c)) > longest[name]

    feedback = chunk.isNull()
    return (
        F.when(feedback & (quoted.isNotNull() | suggested.isNotNull()), "feedback takes a message only")
        .when(feedback & bare(note).isNull(), "feedback missing").when(~feedback & (chunk < 1), "passage unknown").when(~feedback & bare(quoted).isNull(), "quoted text missing")
        .when(long(quoted, "quoted_text"), "quoted text too long").when(long(suggested, "suggested_text"), "suggested text too long").when(long(note, "note"), "note too long")
        .when(F.coalesce(token, F.lit("")).eqNullSafe(F.lit("")) | (F.char_length(token) > longest["token"]), "check missing")
    )


def clean_reply(text: Column, most: int = 12) -> Column:
    """A model's reply as a query: its first line without label, quotes and full stop; null if it is none."""
    line = F.regexp_extract(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?m)^\s*(\S.*?)\s*$", 1)
    line = F.regexp_replace(line, r"(?i)^(?:search )?query:\s*", "")
    line = F.trim(F.regexp_replace(F.regexp_replace(F.trim(line), "^[\"'“”]+|[\"'“”]+$", ""), r"\.+$", ""))
    return F.when(F.size(F.split(line, r"\s+")).between(2, most) & ~line.contains('"') & ~line.rlike(r"(?i)\b(?:year|before|after|ep|include):|(?:^|\s)-\w|\bOR\b|\*"), line)
