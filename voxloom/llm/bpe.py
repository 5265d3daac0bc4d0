"""Token counts by rank-synchronous merging of ragged arrays of byte-pair symbols.

Texts of a batch are one array of code points.  Class boundaries cut it into pre-tokens, all at
once; equal pre-tokens are found by 64-bit hashes.  The distinct ones, as byte symbols laid
end to end, merge in rounds: each sequence finds its lowest-rank adjacent pair and all
occurrences in all sequences merge together; sequences without a mergeable pair leave.  What
survives is the token count.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U, mix

OTHER, LETTER, NUMBER, SPACE = range(4)

#: White space, and letters and numbers that Unicode 16 added, which Python 3.13's
#: character database does not have yet.
WHITE = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

NO_RANK = np.int32(2**31 - 1)
#: Distinct pre-tokens that a worker keeps (20 bytes each, and their ids for packing).
CACHE = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    kinds = "".join(unicodedata.category(chr(c))[0] for c in range(0x110000))
    major = np.frombuffer(kinds.encode(), np.uint8)
    out[major == ord("L")] = LETTER
    out[major == ord("N")] = NUMBER
    for ranges, kind in ((WHITE, SPACE), (LETTERS_16, LETTER), (NUMBERS_16, NUMBER)):
        for a, b in ranges:
            out[a : b + 1] = kind
    return out


_POINT = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 4096, dtype=np.uint64) * U(2) + U(1)


def pretoken_starts(points: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each code point; ``begin`` marks where texts start.

    The rules: runs of letters, of numbers, of other characters and of white space; the last
    character of a run of white space before something else stands alone or, if a plain space, joins
    what follows; an apostrophe that begins a pre-token takes s, t, m, d, re, ve or ll after it.
    """
    n = len(points)
    kind = classes()[points]
    start = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= begin
    run = start.copy()
    edge = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~begin[1:])
    start[edge] = True
    start[edge[points[edge] == 32] + 1] = False
    mark = np.flatnonzero(points[:-1] == 39)
    mark = mark[start[mark] & run[mark] & (kind[mark + 1] == LETTER) & ~begin[mark + 1]]
    if len(mark):
        one = points[mark + 1]
        far = np.minimum(mark + 2, n - 1)
        two = np.where((mark + 2 < n) & ~begin[far], points[far], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = np.zeros(len(mark), bool)
        for a, b in ("re", "ve", "ll"):
            double |= (one == ord(a)) & (two == ord(b))
        start[mark[single | double] + 1] = False
        cut = mark[single] + 2
        start[cut[cut < n]] = True
        cut = mark[double] + 3
        start[cut[cut < n]] = True
    return start


class Merger:
    """Merge ranks of one byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.first = np.array([vocab[c] for c in byte_letters()], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int32)
        self.into = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        return np.where(self.key[at] == pair, self.rank[at], NO_RANK)

    def merge(self, data: np.ndarray, sizes: np.ndarray, ids_too: bool = False):
        """Token counts of the byte sequences laid end to end in ``data``; with ids if asked."""
        out = sizes.astype(np.int64)
        ids = self.first[data]
        name = np.arange(len(sizes))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        sizes = out.copy()
        last = np.cumsum(sizes) - 1
        rank = np.full(len(ids), NO_RANK, np.int32)
        if len(ids):
            rank[:-1] = self.ranks(ids[:-1], ids[1:])
            rank[last] = NO_RANK
        while len(ids):
            best = np.minimum.reduceat(rank, last - sizes + 1)
            live = best != NO_RANK
            if not live.all():
                stay = np.repeat(live, sizes)
                out[name[~live]] = sizes[~live]
                if ids_too:
                    done.append((name[~live], ids[~stay]))
                ids, rank, sizes, name, best = ids[stay], rank[stay], sizes[live], name[live], best[live]
                if not len(ids):
                    break
                last = np.cumsum(sizes) - 1
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            if len(at) > 1:  # in a run of overlapping hits (a a a) every second one merges
                fresh = np.ones(len(at), bool)
                np.greater(np.diff(at), 1, out=fresh[1:])
                run = np.flatnonzero(fresh)
                place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
                at = at[place % 2 == 0]
            ids[at] = self.into[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            sizes = sizes - np.bincount(np.searchsorted(last, at), minlength=len(sizes))
            moved = (np.cumsum(keep) - 1)[at]
            ids, rank = ids[keep], rank[keep]
            last = np.cumsum(sizes) - 1
            look = np.concatenate([moved, moved[moved > 0] - 1])
            rank[look] = self.ranks(ids[look], ids[np.minimum(look + 1, len(ids) - 1)])
            rank[last] = NO_RANK
        if not ids_too:
            return out
        flat = np.empty(int(out.sum()), np.uint32)
        at = np.cumsum(out) - out
        for names, some in done:
            n = out[names]
            flat[np.repeat(at[names] - (np.cumsum(n) - n), n) + np.arange(len(some))] = some
        return out, flat


@lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


class Known:
    """Distinct pre-tokens seen by this worker, by hash: token counts and, if asked, ids."""

    def __init__(self, path: str, encode=None):
        self.merger, self.encode = merger(path), encode
        self.clear()

    def clear(self) -> None:
        self.hashes, self.counts = np.zeros(0, U), np.zeros(0, np.int64)
        self.starts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray, strings) -> np.ndarray:
        """Places of sorted distinct hashes; ``strings(i)`` gives (bytes, sizes) of those numbered i."""
        if len(self.hashes) > CACHE:
            self.clear()
        at = np.searchsorted(self.hashes, hashes)
        new = np.flatnonzero((at == len(self.hashes)) | (self.hashes[np.minimum(at, len(self.hashes) - 1)] != hashes)) if len(self.hashes) else np.arange(len(hashes))
        if len(new):
            data, sizes = strings(new)
            if self.encode is None:
                counts, starts = self.merger.merge(data, sizes), np.zeros(len(new), np.int64)
            else:
                counts, ids = self.encode(data, sizes)
                starts = len(self.ids) + np.cumsum(counts) - counts
                self.ids = np.concatenate([self.ids, ids])
            where = at[new]
            self.hashes, self.counts, self.starts = np.insert(self.hashes, where, hashes[new]), np.insert(self.counts, where, counts), np.insert(self.starts, where, starts)
            at = np.searchsorted(self.hashes, hashes)
        return at


def look_up(texts: list[str], known: Known) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``known`` of all pre-tokens of the texts, in order, and where each text's begin (n + 1)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    bound = np.concatenate([[0], np.cumsum(sizes)])
    begin = np.zeros(len(points) + 1, bool)
    begin[bound[:-1]] = True
    start = np.flatnonzero(pretoken_starts(points, begin[:-1]))
    end = np.append(start[1:], len(points))
    # a polynomial over code points: Horner by prefix sums needs powers, so reuse the byte kernel's
    from .kernel import _powers

    pw, inv = _powers(len(points) + 1)
    prefix = np.zeros(len(points) + 1, U)
    np.cumsum((_POINT[points & 4095] + mix((points >> 12).astype(U)) if points.max() > 4095 else _POINT[points]) * pw[: len(points)], out=prefix[1:])
    hashes = mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U) * U(0x9E3779B97F4A7C15))
    distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)

    def strings(i: np.ndarray):
        a, n = start[first[i]], (end - start)[first[i]]
        flat = points[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        raw = np.frombuffer(flat.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        wide = 1 + (flat > 0x7F).astype(np.int64) + (flat > 0x7FF) + (flat > 0xFFFF)
        return raw, np.add.reduceat(wide, np.cumsum(n) - n)

    places = known.find(distinct, strings)[which]
    return places, np.searchsorted(start, bound)


_COUNTERS: dict[str, Known] = {}


def parts(text: str, special: dict[str, int]) -> Iterator[tuple[str | None, str]]:
    """The text cut at special strings, leftmost first: (special string or None, piece)."""
    while True:
        found = min(((at, s) for s in special if (at := text.find(s)) >= 0), default=None)
        if found is None:
            if text:
                yield None, text
            return
        at, s = found
        if at:
            yield None, text[:at]
        yield s, s
        text = text[at + len(s) :]


def counts_of(texts: list[str | None], path: str) -> np.ndarray:
    """Token counts of whole texts; a null is empty."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Known(path)
    known = _COUNTERS[path]
    special = known.merger.special
    plain, owner, extra = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        for s, piece in parts(text or "", special):
            if s is None:
                plain.append(piece)
                owner.append(i)
            else:
                extra[i] += 1
    places, bound = look_up(plain, known)
    total = np.concatenate([[0], np.cumsum(known.counts[places])])
    return extra + np.bincount(np.array(owner, np.int64), total[bound[1:]] - total[bound[:-1]], len(texts)).astype(np.int64)


def token_counts(docs: DataFrame, text: str = "text", limit: int = 512, path: str | None = None) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one per input row, of whole texts.

    Counts equal the library's for the file, without added special tokens; special strings inside a
    text count one each, as its default has it.  A null text is empty: no bytes, no tokens.  Ids
    are carried as they are (nulls and repeats too); other columns are ignored.
    """
    path = path or default_path()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .kernel import slices

        for batch in batches:
            for part in slices(batch, "text"):
                n = counts_of(part.column("text").to_pylist(), path)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.col(text).cast("string").alias("text"),
    )
    out = rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
