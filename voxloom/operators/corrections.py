"""Dictionary corrections of timed words: a trie of rules, per episode and for all.

A rule names words by their keys (lower case, letters, digits, apostrophes).  At each word the trie is
walked as deep as rules go; an episode's own rule beats one for all, then the longer wins, then one that
keeps the words as they are.  What is put in is never matched again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import WORDS, Word
from .sentences import ends_sentence


#: Words that are Python objects at once, about.
SLICE = 1 << 16


@dataclass(frozen=True)
class Rule:
    """``match`` keys become ``put`` ("" deletes them, None keeps them), in one episode or in all."""

    match: tuple[str, ...]
    put: str | None
    episode: str | None = None


@lru_cache(1 << 14)
def key(text: str) -> str:
    return re.sub(r"[^\w']+", "", text.lower())


def rules_of(mapping: dict) -> list[Rule]:
    """Rules of a file read as text: ``keep`` (list), ``global`` (key to value), ``episodes`` (stem to such a mapping)."""

    def keys(text) -> tuple[str, ...]:
        return tuple(filter(None, map(key, str(text).split())))

    given = [(k, None, None) for k in mapping.get("keep") or []]
    given += [(k, v, None) for k, v in (mapping.get("global") or {}).items()]
    given += [(k, v, stem) for stem, some in (mapping.get("episodes") or {}).items() for k, v in (some or {}).items()]
    return [Rule(keys(k), v if v is None else str(v), stem) for k, v, stem in given if keys(k)]


def read_rules(text: str) -> list[Rule]:
    """Rules of a file's text: two levels of indentation, ``key: value`` lines and ``- item`` lists, all values text."""
    found: dict = {}
    section = stem = None
    for line in text.splitlines():
        bare = re.sub(r"(?:^|\s)#.*$", "", line).rstrip()
        if not bare:
            continue
        depth, item = len(bare) - len(bare.lstrip()), bare.strip()
        if item.startswith("- "):
            found.setdefault(section, []).append(_unquoted(item[2:]))
            continue
        name, colon, value = _split_line(item)
        if not colon:
            raise ValueError(f"not a rule: {line!r}")
        if depth == 0:
            section, stem = name, None
            if section not in ("keep", "global", "episodes"):
                raise ValueError(f"unknown section {section!r}")
        elif section == "episodes" and not value and (stem is None or depth <= stem[1]):
            stem = (name, depth)
            found.setdefault(section, {}).setdefault(name, {})
        elif section == "episodes":
            found[section][stem[0]][name] = value
        else:
            found.setdefault(section, {})[name] = value
    return rules_of(found)


def _unquoted(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def _split_line(item: str) -> tuple[str, str, str]:
    m = re.match(r"""("[^"]*"|'[^']*'|[^:]+(?::(?!\s|$)[^:]*)*):(?:\s+(.*))?$""", item)
    return (_unquoted(m[1]), ":", _unquoted(m[2] or "")) if m else (item, "", "")


class Trie:
    def __init__(self, rules: list[Rule], episode: str | None):
        self.root: dict = {}
        for rank, r in enumerate(rules):
            if r.episode in (None, episode):
                node = self.root
                for k in r.match:
                    node = node.setdefault(k, {})
                # better rules sort first: the episode's, those that keep, then the earlier
                node.setdefault("", []).append((r.episode is None, r.put is not None, rank, r))

    def longest(self, keys: list[str], at: int) -> Rule | None:
        found, node, depth = [], self.root, 0
        while at + depth < len(keys) and keys[at + depth] and (node := node.get(keys[at + depth])) is not None:
            depth += 1
            found += [(general, -depth, puts, rank, r) for general, puts, rank, r in node.get("", ())]
        return min(found, key=lambda x: x[:4])[4] if found else None


def _put(span: list[Word], put: str, opens: bool) -> list[Word]:
    """The words put in, sharing the span's time evenly; the last takes the span's closing marks."""
    texts = put.split()
    if opens and put == put.lower() and re.sub(r"^[\W_]+", "", span[0].text)[:1].isupper():
        texts[0] = texts[0][:1].upper() + texts[0][1:]
    texts[-1] += _marks(span[-1].text)
    first, last = span[0].start, span[-1].end
    edges = [first + round(k * (last - first + 1) / len(texts)) for k in range(len(texts))] + [last + 1]
    sure = min(w.prob for w in span)
    return [Word(t, edges[k], edges[k + 1] - 1, sure) for k, t in enumerate(texts)]


def _marks(text: str) -> str:
    return re.search(r"[^\w']*$", text)[0]


def corrected(words: list[Word], trie: Trie) -> list[Word]:
    keys, out, at = [key(w.text) for w in words], [], 0
    while at < len(words):
        rule = trie.longest(keys, at) if keys[at] in trie.root else None
        span = words[at : at + (len(rule.match) if rule else 1)]
        at += len(span)
        if rule is None or rule.put is None:
            out += span
        elif rule.put.split():
            out += _put(span, rule.put, not out or ends_sentence(out[-1].text))
        elif (marks := _marks(span[-1].text)) and out and not _marks(out[-1].text):
            out[-1] = out[-1]._replace(text=out[-1].text + marks)
    return out


def correct(episodes: DataFrame, rules: list[Rule], stem: str = "stem", words: str = "words") -> DataFrame:
    """``episodes`` with ``words`` (text, start, end, prob) corrected; null words stay null.

    Only rows that hold a rule's first key go to Python, as Arrow arrays (Spark ends a batch at 64 MB); of a batch,
    about SLICE words at a time become objects.  The rules, a small dictionary, travel with the function.
    """
    firsts = sorted({r.match[0] for r in rules})
    if not firsts:
        return episodes
    keys = F.transform(F.col(words), lambda w: F.regexp_replace(F.lower(w["text"]), r"(?U)[^\w']+", ""))
    holds = F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, firsts))), F.lit(False))

    def fix(stems, column):
        import pyarrow as pa

        special, tries = {r.episode for r in rules}, lru_cache(16)(lambda s: Trie(rules, s))
        return pa.concat_arrays([_fixed(stems.slice(at, n), column.slice(at, n), lambda s: tries(s if s in special else None)) for at, n in _slices(column)])

    fixed = F.arrow_udf(fix, WORDS)(F.col(stem).cast("string"), F.when(holds, F.col(words)).cast(WORDS))
    return episodes.withColumn(words, F.when(holds, fixed).otherwise(F.col(words).cast(WORDS)))


def _slices(column) -> list[tuple[int, int]]:
    """First row and number of rows of the pieces of a list array that hold about SLICE items (one row at least)."""
    import pyarrow.compute as pc

    out, at, held = [], 0, 0
    for k, n in enumerate(pc.fill_null(pc.list_value_length(column), 0).to_pylist()):
        if k > at and held + n > SLICE:
            out.append((at, k - at))
            at, held = k, 0
        held += n
    return [*out, (at, len(column) - at)]


def _fixed(stems, column, trie_of) -> object:
    """The list array of words, corrected row by row; lists of plain values hold no more than these rows."""
    import pyarrow as pa
    import pyarrow.compute as pc

    items = column.flatten()
    given = zip(*[pc.struct_field(items, n).to_pylist() for n in Word._fields], strict=True)
    ends, out = [0], []
    for s, n in zip(stems.to_pylist(), pc.list_value_length(column).to_pylist(), strict=True):
        out += corrected([Word(*next(given)) for _ in range(n)], trie_of(s)) if n else []
        ends.append(len(out))
    fields = items.type
    values = pa.StructArray.from_arrays([pa.array([w[k] for w in out], fields.field(n).type) for k, n in enumerate(Word._fields)], fields=[fields.field(n) for n in Word._fields])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=column.type, mask=column.is_null())


def changes(episodes: DataFrame, before: list[Rule], after: list[Rule], stem: str = "stem", words: str = "words") -> DataFrame:
    """Rows (stem, start, was, now): words, by start, that two sets of rules leave different."""
    def starts(rules: list[Rule], name: str) -> DataFrame:
        rows = correct(episodes, rules, stem, words).select(F.col(stem).alias("stem"), F.explode(words).alias("w"))
        return rows.groupBy("stem", F.col("w.start").alias("start")).agg(F.array_join(F.sort_array(F.collect_list("w.text")), " ").alias(name))

    both = starts(before, "was").join(starts(after, "now"), ["stem", "start"], "full_outer")
    return both.where(~F.col("was").eqNullSafe(F.col("now")))


def from_texts(docs: DataFrame, text: str, step: int = 400) -> DataFrame:
    """``docs`` with ``words``: the space-separated tokens of a text, ``step`` milliseconds apart."""
    word = F.transform(F.split(text, " "), lambda t, i: F.struct(t.alias("text"), (i * step).cast("bigint").alias("start"), (i * step + step - 1).cast("bigint").alias("end"), F.lit(1.0).alias("prob")))
    return docs.withColumn("words", word)


def iterate(words: list) -> Iterator[Word]:
    return (Word(w["text"], w["start"], w["end"], w["prob"]) for w in words)
