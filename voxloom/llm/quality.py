"""Quality rules and distribution divergence from language references.

Per document: plain counts over words and lines, a histogram over character classes, and one over
the common words of its language.  A language's reference is the mean of the normalised histograms of
all its documents, so a long or odd document weighs as much as any other.  A document is kept
when the sum of its two Jensen-Shannon distances to the reference stays under a limit, which is
wider for short texts, whose histograms are noisy; those too short to judge are not judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import Texts, rows_of, slices, texts_of, window_hashes
from .shared import write_table

#: Function words by language; the last bin of a histogram holds all other words.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which".split(),
    "fr": "le la les de des du un une et en que qui dans pour sur pas au par avec ce se il elle ne plus est son sont mais ou".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "es": "el la los las de y en que a un una del se por con no para su al lo es como más o pero sus le ya este ha".split(),
}
CLASSES = ("lower", "upper", "digit", "stop", "symbol", "other", "letter")
#: Limit of the sum of both Jensen-Shannon distances (base 2, 0 to 1 each): LIMIT + NOISE / words.
LIMIT, NOISE = 0.43, 4.0
MIN_CHARS, MIN_WORDS = 200, 50
#: A language has a reference from so many documents on that pass the base rules; with fewer, none is judged.
MIN_DOCS = 20

_CLASS = np.full(256, 5, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 3
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 4
_CLASS[128:192] = 7  # inside a longer character
_CLASS[192:] = 6
_CLASS[[32, 9, 10, 11, 12, 13]] = 7
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_HEAD = np.ones(256, bool)
_HEAD[128:192] = False


def _word_hashes(words: list[str]) -> np.ndarray:
    import pyarrow as pa

    t = texts_of(pa.array(words))
    return t.span_hash(t.prefix_hash(), t.offsets[:-1], t.offsets[1:])


def base_counts(t: Texts, langs: list[str | None]) -> dict[str, np.ndarray]:
    """Counts of each text (arrays of n) and histograms (arrays of n rows)."""
    n = len(t)
    prefix = t.prefix_hash()
    start, end, owner = t.words()
    bounds = rows_of(owner, n)
    heads = np.concatenate([[0], np.cumsum(_HEAD[t.data])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[t.data])])
    chars = np.concatenate([[0], np.cumsum(heads[end] - heads[start])])
    hashes = t.span_hash(prefix, start, end)

    # lines: cut at \n and at text bounds; those with a word that equal an earlier one
    cut = np.flatnonzero(t.data == 10)
    line_a = np.unique(np.concatenate([t.offsets[:-1], cut + 1]))
    line_a = line_a[line_a < len(t.data)]
    line_of = np.searchsorted(t.offsets, line_a, "right") - 1
    nxt = np.append(line_a[1:], len(t.data))
    line_b = np.where((nxt > line_a) & (t.data[nxt - 1] == 10) if len(nxt) else nxt > line_a, nxt - 1, nxt)
    worded = np.searchsorted(start, line_b) > np.searchsorted(start, line_a)
    line_a, line_b, line_of = line_a[worded], line_b[worded], line_of[worded]
    line = t.span_hash(prefix, line_a, line_b)
    order = np.lexsort((line, line_of))
    same = (line[order][1:] == line[order][:-1]) & (line_of[order][1:] == line_of[order][:-1])
    dup_lines = np.bincount(line_of[order][1:][same], minlength=n)

    repeats = np.zeros(n, np.int64)
    windows = window_hashes(hashes, 3)
    for i in range(n):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if b - a < 4:
            continue
        w = windows[a : b - 2]
        order = np.argsort(w)
        s = w[order]
        eq = s[1:] == s[:-1]
        if eq.any():
            twice = np.zeros(len(w), bool)
            twice[order[1:][eq]] = True
            twice[order[:-1][eq]] = True
            hit = np.zeros(len(w) + 2, bool)
            hit[:-2] = twice
            hit[1:-1] |= twice
            hit[2:] |= twice
            repeats[i] = hit.sum()

    of = np.repeat(np.arange(n), np.diff(t.offsets))
    classes = np.bincount(of * 8 + _CLASS[t.data], minlength=8 * n).reshape(n, 8)[:, :7]
    low = t.lowered()
    folded = low.span_hash(low.prefix_hash(), start, _trimmed(low.data, start, end))
    common = np.zeros((n, 31), np.int64)
    common[:, 30] = np.diff(bounds)
    for lang, words in COMMON.items():
        mine = np.array([x == lang for x in langs], bool)
        if mine.any():
            keys = _word_hashes(words)
            by = np.argsort(keys)
            at = np.minimum(np.searchsorted(keys[by], folded), len(keys) - 1)
            hit = (keys[by][at] == folded) & mine[owner]
            seen = np.bincount(owner[hit] * 31 + by[at[hit]], minlength=31 * n).reshape(n, 31)
            common += seen
            common[:, 30] -= seen.sum(axis=1)
    return {
        "n_words": np.diff(bounds), "word_chars": chars[bounds[1:]] - chars[bounds[:-1]], "n_symbols": symbols[t.offsets[1:]] - symbols[t.offsets[:-1]],
        "n_dup_lines": dup_lines, "n_repeat_words": repeats, "classes": classes, "common": common,
    }


def _trimmed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Word ends without one closing stop character."""
    return np.where((end - start > 1) & (_CLASS[data[end - 1]] == 3), end - 1, end) if len(end) else end


def features(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """One row per input row: doc_id, lang, the counts, and the two histograms."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text"):
                got = base_counts(texts_of(part.column("text")), part.column("lang").to_pylist())
                cols = [part.column("doc_id"), part.column("lang")]
                for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
                    cols.append(pa.array(got[name].astype(np.int64)))
                for name in ("classes", "common"):
                    k = got[name].shape[1]
                    at = pa.array(np.arange(len(part.column("doc_id")) + 1, dtype=np.int32) * k)
                    cols.append(pa.ListArray.from_arrays(at, pa.array(got[name].astype(np.float64).reshape(-1))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).cast("string").alias("text"))
    schema = "doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, classes array<double>, common array<double>"
    return rows.mapInArrow(run, schema)


def _share(h: Column) -> Column:
    total = F.aggregate(h, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(h, lambda x: x / total))


def _js(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two aligned distributions."""

    def part(x, y):
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda x, y: (part(x, y) + part(y, x)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def references(rows: DataFrame) -> DataFrame:
    """One row per language: mean normalised histograms over all documents long enough to judge that pass the base rules."""
    fit = rows.where((F.col("word_chars") >= MIN_CHARS) & (F.col("n_words") >= MIN_WORDS) & ~_failed()).select("lang", _share(F.col("classes")).alias("p"), _share(F.col("common")).alias("w"))
    means = [F.avg(F.col("p")[i]) for i in range(len(CLASSES))], [F.avg(F.col("w")[i]) for i in range(31)]
    return fit.groupBy("lang").agg(F.array(*means[0]).alias("ref_chars"), F.array(*means[1]).alias("ref_words"), F.count("*").alias("docs")).where(F.col("docs") >= MIN_DOCS).drop("docs")


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, js_chars, js_words).

    ``base_failed``: under 50 words, or over half of the words in repeated 3-word windows.
    ``kept``: not base_failed, and the distances' sum within its limit.  A document with fewer than
    MIN_CHARS word characters or MIN_WORDS words has null distances; so has one of a language
    without a reference (under MIN_DOCS documents to take it from), and null languages share one reference.  A language
    without a list of common words has all words in the rest bin: its word distance is 0.
    Null texts count nothing.  Null or repeated ids are carried; one row per input row.
    """
    rows = write_table(features(docs, text, lang), "quality")
    scored = rows.join(references(rows), "lang", "left")
    long_enough = (F.col("word_chars") >= MIN_CHARS) & (F.col("n_words") >= MIN_WORDS) & F.col("ref_chars").isNotNull()
    scored = scored.withColumn("js_chars", F.when(long_enough, _js(_share(F.col("classes")), F.col("ref_chars"))))
    scored = scored.withColumn("js_words", F.when(long_enough, _js(_share(F.col("common")), F.col("ref_words"))))
    failed = _failed()
    near = F.coalesce(F.col("js_chars") + F.col("js_words") <= LIMIT + NOISE / F.col("n_words"), F.lit(True))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & near).alias("kept"), "js_chars", "js_words",
    )


def keep_quality(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that ``quality`` keeps, all columns as they were.

    Rows that share an id are kept only if all of them are; rows with a null id stay, since
    nothing joins them to a verdict.
    """
    verdict = quality(docs, text, lang)
    bad = verdict.where("NOT kept").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].cast("bigint") == bad["_bad"], "left_anti")
