"""The search query language: words, phrases, prefixes, OR, exclusions and filters.

``parse`` never fails.  The result is a conjunction of groups, each a disjunction of phrases, less
the negative phrases.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

#: Query bound, characters that phones type for quotes, and words not worth marking.
MAX_CHARS = 200
DOUBLE, SINGLE = "“”„‟″＂", "‘’‚‛′"
STOPWORDS = frozenset(
    """a an the and or but if then so than as because of at by for from in into on onto to with about is are was were be been
    being am do does did doing have has had having i me my we us our you your he him his she her it its they them their this that these
    those there here what which who whom whose when where why how can could would should will shall may might must not no just very any
    some also too i'm i've i'd i'll it's that's there's what's let's you're we're they're don't doesn't didn't can't won't isn't wasn't""".split()
)


@dataclass(frozen=True)
class Phrase:
    text: str
    prefix: bool = False


@dataclass(frozen=True)
class Filters:
    year: int | None = None
    before: int | None = None
    after: int | None = None
    ep: int | None = None


@dataclass(frozen=True)
class Query:
    groups: tuple[tuple[Phrase, ...], ...] = ()
    negative: tuple[Phrase, ...] = ()
    filters: Filters = field(default_factory=Filters)
    include_ads: bool = False
    terms: tuple[Phrase, ...] = ()

    @property
    def semantic(self) -> str:
        """The positive words and phrases, for embedding."""
        return " ".join(p.text for g in self.groups for p in g)


#: What the scanner tells apart, each under its name.
_TOKEN = re.compile(
    r"""
    (?P<phrase> (?P<neg> (?<![^\s"]) -+ )? "(?P<quoted>[^"]*)" )
  | (?P<or> (?<![^\s"]) OR (?![^\s"]) )
  | (?P<limit> (?<![^\s"]) (?i: year:[0-9]{4}(?:[-–][0-9]{4})? | (?:before|after):[0-9]{4} | ep:[0-9]{1,5} ) (?![^\s"]) )
  | (?P<ads> (?<![^\s"]) (?i:include:ads) (?![^\s"]) )
  | (?P<word> [^\s"]+ )
    """,
    re.VERBOSE,
)
_SIGNS = str.maketrans(dict.fromkeys(DOUBLE, '"') | dict.fromkeys(SINGLE, "'"))


def _clean(text: str) -> str:
    plain = text[:MAX_CHARS].translate(_SIGNS)
    return "".join(" " if unicodedata.category(c) in ("Cc", "Cs") else c for c in plain)


def _searchable(text: str) -> bool:
    return any(unicodedata.category(c)[0] in "LN" for c in text)


@dataclass(frozen=True)
class _Item:
    """A token as the grammar sees it: code P (wanted), N (unwanted), O (or), F (filter)."""

    code: str
    phrase: Phrase | None = None
    marks: tuple[Phrase, ...] = ()
    limits: dict | None = None


def _limits(text: str) -> dict:
    name, _, value = text.lower().partition(":")
    ends = sorted(int(x) for x in re.split("[-–]", value))
    if name == "year" and ends[0] < ends[-1]:
        return {"after": ends[0] - 1, "before": ends[-1] + 1}
    return {name: ends[0]}


def _item(m: re.Match) -> _Item | None:
    """The token's item; none where there is nothing to search for."""
    kind = m.lastgroup if m.lastgroup not in ("neg", "quoted") else "phrase"
    if kind in ("or", "limit", "ads"):
        return {"or": lambda: _Item("O"), "limit": lambda: _Item("F", limits=_limits(m[0])), "ads": lambda: _Item("F", limits={"ads": True})}[kind]()
    if kind == "phrase":
        unwanted, p = bool(m["neg"]), Phrase(" ".join(m["quoted"].split()))
        parts = [Phrase(w) for w in p.text.split(" ")]
    else:
        dashes, stem, stars = re.fullmatch(r"(-*)(.*?)(\**)", m[0], re.DOTALL).groups()
        unwanted, p = bool(dashes), Phrase(stem, bool(stars))
        parts = [p]
    if not _searchable(p.text):
        return None
    marks = tuple(w for w in parts if _searchable(w.text) and (w.prefix or w.text.lower() not in STOPWORDS))
    return _Item("N" if unwanted else "P", p, () if unwanted else marks)


def parse(text) -> Query:
    """A query of any input; what is not text is the empty query.

    Tokens become one letter each, and groups are the runs ``P(O+P)*`` of that string: an OR joins only
    wanted neighbours, and an unwanted word or a filter between them ends the run.
    """
    if not isinstance(text, str):
        return Query()
    items = [i for i in map(_item, _TOKEN.finditer(_clean(text))) if i]
    codes = "".join(i.code for i in items)
    groups = [tuple(i.phrase for i in items[m.start() : m.end()] if i.code == "P") for m in re.finditer("P(?:O+P)*", codes)]
    limits: dict = {}
    for i in items:
        limits |= i.limits or {}
    return Query(
        tuple(groups), tuple(i.phrase for i in items if i.code == "N"), Filters(**{k: v for k, v in limits.items() if k != "ads"}),
        "ads" in limits, tuple(w for i in items for w in i.marks),
    )


def parse_or_plain(text) -> Query:
    """``parse``; should it ever fail, the input's plain words, all wanted."""
    try:
        return parse(text)
    except Exception:  # a search never fails for what was typed
        words = [w for w in re.findall(r"[^\W_]+", str(text)[:MAX_CHARS]) if _searchable(w)]
        return Query(tuple((Phrase(w),) for w in words), terms=tuple(Phrase(w) for w in words))


def effective_years(q: Query, this_year: int, first: int = 2000) -> tuple[int, int] | None:
    """The years that the filters leave, if any filter is set; an empty range reads from past to."""
    f = q.filters
    if f.year is None and f.before is None and f.after is None:
        return None
    lows = [first if f.after is None else f.after + 1, *([] if f.year is None else [f.year])]
    highs = [this_year if f.before is None else f.before - 1, *([] if f.year is None else [f.year])]
    return max(lows), min(highs)


_EMOJI = "\U0001F000-\U0001FAFF\u2600-\u27BF\u2B00-\u2BFF\u231A-\u23FF\u25AA-\u25FE\u2934\u2935\u3030\u303D\u3297\u3299\u00A9\u00AE\u203C\u2049\u2122\u2139\u2194-\u21AA\U000E0020-\U000E007F\uFE0F\u20E3"


def normalise_query(text: str) -> str:
    """Emoji and what joins them taken out, white space collapsed."""
    text = re.sub(f"\u200D(?=[{_EMOJI}])|(?<=[{_EMOJI}])\u200D", "", text)
    return " ".join(re.sub(f"[{_EMOJI}]", "", text).split())


def without_filters(text: str, names: tuple[str, ...] = ("year", "before", "after", "ep", "include")) -> str:
    """The query without the filters of these names, and without ORs that touch them."""
    q = normalise_query(text)
    found = list(_TOKEN.finditer(_clean(q)))
    codes = "".join("F" if (m["limit"] or m["ads"]) and m[0].lower().partition(":")[0] in names else "O" if m["or"] else "." for m in found)
    keep, at = [], 0
    for run in re.finditer("[FO]*F[FO]*", codes):
        keep.append(q[at : found[run.start()].start()])
        at = found[run.end() - 1].end()
    return normalise_query(" ".join([*keep, q[at:]]) if keep else q)


def _with(text: str, token: str, names: tuple[str, ...]) -> str:
    """The query with one filter in place of those of ``names``: last, or first where the bound would cut it."""
    rest = without_filters(text, names)
    last = normalise_query(f"{rest} {token}")
    return last if len(last) <= MAX_CHARS else normalise_query(f"{token} {rest}")


def set_range(text: str, a: int, b: int) -> str:
    low, high = sorted((a, b))
    return _with(text, f"year:{low}" if low == high else f"year:{low}-{high}", ("year", "before", "after"))


def set_episode(text: str, number: int) -> str:
    return _with(text, f"ep:{number}", ("ep",))


def range_label(years: tuple[int, int] | None) -> str:
    if years is None:
        return "Any year"
    return "–".join(map(str, dict.fromkeys(years)))


#: Modes, sorts and the last page of each mode at twenty results a page.
SORTS, LAST_PAGE = ("relevance", "newest", "oldest"), {"exact": 10, "related": 5}


@dataclass(frozen=True)
class State:
    q: str = ""
    mode: str = "exact"
    sort: str = "relevance"
    page: int = 1


def read_state(search: str) -> State:
    """The state that a url's query string holds; what is unknown falls back, nothing fails."""
    from urllib.parse import parse_qs

    given = {k: v[0] for k, v in parse_qs(search.removeprefix("?"), keep_blank_values=True).items()}
    mode = "related" if given.get("mode") in ("related", "smart") else "exact"
    sort = given.get("sort", "").lower()
    page = given.get("page", "")
    number = int(page) if re.fullmatch("[0-9]{1,300}", page) else 1
    return State(normalise_query(given.get("q", "")), mode, sort if sort in SORTS else SORTS[0], min(max(number, 1), LAST_PAGE[mode]))


def write_state(state: State) -> str:
    """A state as a query string, defaults left out; empty where nothing is left."""
    from urllib.parse import urlencode

    now = State(normalise_query(state.q), state.mode, state.sort, min(max(state.page, 1), LAST_PAGE[state.mode]))
    parts = {k: v for k, v in vars(now).items() if v != getattr(State(), k)}
    return f"?{urlencode(parts)}" if parts else ""


def cache_key(text: str, version: str, **params) -> str:
    """A key for cached answers: white space does not matter, case does, and so does the corpus version."""
    return "|".join([" ".join(text.split()), *[f"{k}={params[k]}" for k in sorted(params)], version])


def page_of(value, last: int) -> int:
    """A page number clamped to 1..last."""
    return min(max(int(value), 1), last) if re.fullmatch("[0-9]+", str(value or "")) else 1


def limit_of(value, most: int = 20) -> int:
    return min(max(int(value), 1), most) if re.fullmatch("[0-9]+", str(value or "")) else most


def floor_of(value) -> float | None:
    try:
        n = float(value)
    except (TypeError, ValueError):
        return None
    return n if 0 <= n <= 1 else None


def radius_of(value, usual: int = 3, most: int = 6) -> int:
    return min(int(value), most) if re.fullmatch("[0-9]+", str(value or "")) else usual


def id_of(value) -> int | None:
    n = int(value) if re.fullmatch("[0-9]{1,15}", str(value or "")) else 0
    return n if n > 0 else None


def last_page(shown: int, limit: int) -> int:
    """The last page of ``shown`` results, at least 1."""
    return max(1, -(-shown // limit))
