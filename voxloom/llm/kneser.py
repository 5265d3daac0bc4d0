"""Language-model scoring: an interpolated modified Kneser-Ney bigram model of the corpus.

Counting runs in Spark: tasks sort and count their own n-grams and send packed arrays, dealt by
shard, so a frequent word is one entry per task whatever its count.  The model is sorted arrays of
hashes and keys with counts, one file per shard in the shared folder, which the scoring workers
memory-map.  A word's id is its place among all sorted word hashes; a bigram's key is both ids.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U, Texts, mix, rows_of, slices, texts_of
from .shared import fresh_path, write_table

#: Hash of the end token, and of the start context (no word's: a word has at least one byte).
END, START = U(0x51ED270B7A2F4C01), U(0x2545F4914F6CDD1D)
#: Distinct n-grams that a counting task holds before it sends them.
HOLD = 3_000_000
#: Text that a shard of the model stands for, at most; there are as many shards as shuffle partitions at least.
SHARD_BYTES = 64 << 20
ALPHA = 0.1


def local_path(path: str) -> str:
    """The POSIX path of the shared folder, which the workers memory-map."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"the model's folder must be mounted on all machines; spark.checkpoint.dir is {path}")
    return path


def pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted keys as differences, and columns, by byte planes, compressed (high planes of small counts cost nothing)."""
    import pyarrow as pa

    step = np.diff(keys, prepend=U(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    planes = [step.T.tobytes()] + [c.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
    return len(keys).to_bytes(8, "little") + pa.compress(b"".join(planes), "zstd", asbytes=True)


def unpack(blob: bytes, columns: int) -> tuple[np.ndarray, ...]:
    import pyarrow as pa

    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], n * (8 + 8 * columns), "zstd", asbytes=True), np.uint8)
    keys = np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").reshape(-1), dtype=U)
    cols = [np.ascontiguousarray(raw[n * (8 + 8 * i) : n * (16 + 8 * i)].reshape(8, n).T).view("<u8").reshape(-1) for i in range(columns)]
    return keys, *(c.astype(np.int64) for c in cols)


def summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys and the columns' sums."""
    if not len(keys):
        return keys, *columns
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    at = np.flatnonzero(new)
    return keys[at], *(np.add.reduceat(c[order], at) for c in columns)


def merged(blobs: list[bytes], columns: int) -> tuple[np.ndarray, ...]:
    got = [unpack(b, columns) for b in blobs]
    if not got:
        return np.zeros(0, U), *([np.zeros(0, np.int64)] * columns)
    return summed(*(np.concatenate(x) for x in zip(*got, strict=True)))


def save(path: str, array: np.ndarray) -> None:
    """Write and move into place: a task that runs again leaves the same file."""
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as f:
        f.write(np.ascontiguousarray(array).tobytes())
    os.replace(part, path)


def mapped(path: str, dtype) -> np.ndarray:
    return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits, or in 64 where one needs them; ``mapped_counts`` tells by the file's size."""
    return counts.astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.uint64)


def mapped_counts(path: str, n: int) -> np.ndarray:
    return mapped(path, np.uint64 if n and os.path.getsize(path) == 8 * n else np.uint32)


def shard_of_hash(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> U(40)) * U(shards) >> U(24)).astype(np.int64)


class Words:
    """Ids of word hashes, by memory-mapped sorted hashes in shards; unknown words have id -1."""

    def __init__(self, folder: str, sizes: list[int]):
        self.shards = len(sizes)
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.total = int(self.base[-1])
        self.hashes = [mapped(f"{folder}/word.{s}", U) for s in range(self.shards)]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        distinct, which = np.unique(hashes, return_inverse=True)
        bounds = np.searchsorted(shard_of_hash(distinct, self.shards), np.arange(self.shards + 1))
        out = np.full(len(distinct), -1, np.int64)
        for s in np.flatnonzero(np.diff(bounds)):
            want, have = distinct[bounds[s] : bounds[s + 1]], self.hashes[s]
            if len(have):
                at = np.minimum(np.searchsorted(have, want), len(have) - 1)
                out[bounds[s] : bounds[s + 1]] = np.where(have[at] == want, self.base[s] + at, -1)
        return out[which]


def tokens_of(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of tokens (words, then one end a text), those before them, bounds (n + 1), word counts."""
    low = texts.lowered()
    start, end, owner = low.words()
    words = rows_of(owner, len(texts))
    n = np.diff(words)
    bounds = words + np.arange(len(texts) + 1)
    cur = np.empty(bounds[-1], U)
    last = np.zeros(len(cur), bool)
    last[bounds[1:] - 1] = True
    cur[last] = END
    cur[~last] = low.span_hash(low.prefix_hash(), start, end)
    prev = np.empty_like(cur)
    prev[1:] = cur[:-1]
    prev[bounds[:-1]] = START
    return cur, prev, bounds, n


class Model:
    """What the workers need to look a bigram up: the folder, shard sizes, totals and discounts."""

    def __init__(self, folder: str, sizes: list[int], hot: list[int]):
        self.folder, self.sizes, self.hot = folder, sizes, hot
        self.tokens = self.types = 0
        self.pairs = 0
        self.d2 = self.d1 = (0.0, 0.0, 0.0)

    def words(self) -> Words:
        return Words(self.folder, self.sizes)


def key_of(prev: np.ndarray, cur: np.ndarray) -> np.ndarray:
    return prev.astype(U) << U(32) | cur.astype(U)


def key_shard(prev: np.ndarray, key: np.ndarray, hot: np.ndarray, shards: int, total: int) -> np.ndarray:
    """Shards by ranges of the first id, which is as good as random; hot first ids are spread by key."""
    plain = prev * shards // max(total + 1, 1)
    return np.where(np.isin(prev, hot), (mix(key) % U(shards)).astype(np.int64), plain)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams seen once, twice, 3 and 4 times."""
    n1, n2, n3, n4 = (max(x, 0) for x in n)
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0
    return tuple(float(min(max(x, 0.05), k - 0.05)) for k, x in zip((1, 2, 3), d, strict=True))


def _counting(rows: DataFrame, grams, shards: int) -> DataFrame:
    """Packed (keys, counts) by shard; ``grams(texts)`` gives keys and their shards."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def send():
            keys, shard, count = _by_shard(held)
            bounds = np.searchsorted(shard, np.arange(shards + 1))
            some = np.flatnonzero(np.diff(bounds))
            blobs = [pack(keys[bounds[s] : bounds[s + 1]], count[bounds[s] : bounds[s + 1]]) for s in some]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], names=["shard", "blob"])

        for batch in batches:
            for part in slices(batch, "text"):
                keys, shard = grams(texts_of(part.column("text")))
                if not len(keys):
                    continue
                distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
                held.append((distinct, shard[first], count.astype(np.int64)))
                size += len(distinct)
                if size > HOLD:
                    held = [_folded(held)]
                    size = len(held[0][0])
                    if size > HOLD // 2:
                        yield send()
                        held, size = [], 0
        if size:
            held = [_folded(held)]
            yield send()

    return rows.mapInArrow(run, "shard int, blob binary")


def _folded(held):
    keys, shard, count = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, shard, count = keys[order], shard[order], count[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    at = np.flatnonzero(new)
    return keys[at], shard[at], np.add.reduceat(count, at)


def _by_shard(held):
    keys, shard, count = held[0]
    order = np.argsort(shard, kind="stable")
    return keys[order], shard[order], count[order]


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count and store the model of the whole texts of ``docs``."""
    spark = docs.sparkSession
    folder = local_path(fresh_path(spark, "kneser"))
    os.makedirs(folder, exist_ok=True)
    rows = docs.select(F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))

    def unigrams(texts: Texts):
        cur = tokens_of(texts)[0]
        return cur, shard_of_hash(cur, shards)

    def keep_words(table):
        import pyarrow as pa

        s = table.column("shard")[0].as_py()
        keys, count = merged(table.column("blob").to_pylist(), 1)
        save(f"{folder}/word.{s}", keys)
        save(f"{folder}/count.{s}", count.astype(np.int64))
        top = np.argsort(-count, kind="stable")[:64]
        return pa.table({"shard": [s], "n": [len(keys)], "total": [int(count.sum())], "top": [top.astype(np.int64).tolist()], "often": [count[top].tolist()]})

    got = _counting(rows, unigrams, shards).groupBy("shard").applyInArrow(keep_words, "shard bigint, n bigint, total bigint, top array<bigint>, often array<bigint>").collect()
    sizes = [0] * shards
    for r in got:
        sizes[r.shard] = r.n
    for s in range(shards):
        if not sizes[s]:
            for name in ("word", "count"):
                save(f"{folder}/{name}.{s}", np.zeros(0, U))
    tokens = sum(r.total for r in got)
    base = np.concatenate([[0], np.cumsum(sizes)])
    # contexts with over a quarter of a shard's share of tokens: at most 4 * shards of them
    hot = [int(base[r.shard] + i) for r in got for i, c in zip(r.top, r.often, strict=True) if 4 * shards * c > tokens]
    model = Model(folder, sizes, [*hot, int(base[-1])])
    model.tokens, model.types = tokens, int(base[-1])
    hot_ids = np.array(model.hot)
    total = model.types

    state: dict[str, Words] = {}

    def bigrams(texts: Texts):
        words = state.get(folder) or state.setdefault(folder, Words(folder, sizes))
        cur, prev, bounds, _ = tokens_of(texts)
        ids = words.ids(cur)
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[bounds[:-1]] = total
        key = key_of(before, ids)
        return key, key_shard(before, key, hot_ids, shards, total)

    def keep_pairs(table):
        import pyarrow as pa

        s = table.column("shard")[0].as_py()
        keys, count = merged(table.column("blob").to_pylist(), 1)
        save(f"{folder}/pair.{s}", keys)
        save(f"{folder}/often.{s}", narrow(count))
        first, second = keys >> U(32), keys & U(0xFFFFFFFF)
        one, two, more = ((count == 1).astype(np.int64), (count == 2).astype(np.int64), (count > 2).astype(np.int64))
        ctx = summed(first, count, one, two, more)
        cont = summed(second, np.ones(len(second), np.int64))
        edges = np.append(base[:-1], total + 1).astype(U)  # the start context goes to the last shard
        out_shard, out_kind, blobs = [], [], []
        for kind, cols in ((0, ctx), (1, cont)):
            at = np.searchsorted(cols[0], edges)
            for t in range(shards):
                if at[t + 1] > at[t]:
                    out_shard.append(t)
                    out_kind.append(kind)
                    blobs.append(pack(*(c[at[t] : at[t + 1]] for c in cols)))
        coc = [int((count == k).sum()) for k in (1, 2, 3, 4)]
        return pa.table({
            "shard": pa.array([-1 - s, *out_shard], pa.int32()), "kind": pa.array([2, *out_kind], pa.int32()),
            "blob": pa.array([b"", *blobs], pa.binary()), "coc": pa.array([coc, *([None] * len(blobs))], pa.list_(pa.int64())),
        })

    parts = write_table(_counting(rows, bigrams, shards).groupBy("shard").applyInArrow(keep_pairs, "shard int, kind int, blob binary, coc array<bigint>"), "kneser-parts")
    pairs = parts.where("kind = 2").select("shard", "coc").collect()  # one small row a shard
    seen = {-1 - r.shard for r in pairs}
    for s in range(shards):
        if s not in seen:
            save(f"{folder}/pair.{s}", np.zeros(0, U))
            save(f"{folder}/often.{s}", np.zeros(0, np.uint32))
    model.d2 = discounts([sum(r.coc[k] for r in pairs) for k in range(4)])

    def keep_contexts(table):
        import pyarrow as pa

        s = table.column("shard")[0].as_py()
        kind = table.column("kind").to_pylist()
        blobs = table.column("blob").to_pylist()
        n = sizes[s] + (1 if s == shards - 1 else 0)
        keys, *cols = merged([b for b, k in zip(blobs, kind, strict=True) if k == 0], 4)
        for name, c in zip(("sum", "one", "two", "more"), cols, strict=True):
            full = np.zeros(n, np.int64)
            full[(keys - U(base[s])).astype(np.int64)] = c
            save(f"{folder}/{name}.{s}", narrow(full))
        keys, c = merged([b for b, k in zip(blobs, kind, strict=True) if k == 1], 1)
        full = np.zeros(n, np.int64)
        full[(keys - U(base[s])).astype(np.int64)] = c
        save(f"{folder}/cont.{s}", narrow(full))
        return pa.table({"shard": [s], "coc": [[int((full == k).sum()) for k in (1, 2, 3, 4)]], "pairs": [int(full.sum())], "types": [int((full > 0).sum())], "big": [[int(((full > 2)).sum())]]})

    got = parts.where("kind < 2").groupBy("shard").applyInArrow(keep_contexts, "shard bigint, coc array<bigint>, pairs bigint, types bigint, big array<bigint>").collect()
    seen = {r.shard for r in got}
    for s in range(shards):
        if s not in seen:
            for name in ("sum", "one", "two", "more", "cont"):
                save(f"{folder}/{name}.{s}", np.zeros(sizes[s] + (1 if s == shards - 1 else 0), np.uint32))
    coc = [sum(r.coc[k] for r in got) for k in range(4)]
    model.d1 = discounts(coc)
    model.pairs = sum(r.pairs for r in got)
    model.spread = (coc[0], coc[1], sum(r.big[0] for r in got))
    return model


class Scorer:
    """The model's files, memory-mapped, and look-ups of arrays of ids."""

    def __init__(self, m: Model):
        self.m, self.words = m, m.words()
        s = len(m.sizes)
        self.hot = np.array(m.hot)
        self.count = [mapped(f"{m.folder}/count.{i}", np.int64) for i in range(s)]
        ids = [m.sizes[i] + (1 if i == s - 1 else 0) for i in range(s)]
        self.by_id = {name: [mapped_counts(f"{m.folder}/{name}.{i}", ids[i]) for i in range(s)] for name in ("sum", "one", "two", "more", "cont")}
        self.pair = [mapped(f"{m.folder}/pair.{i}", U) for i in range(s)]
        self.often = [mapped_counts(f"{m.folder}/often.{i}", len(self.pair[i])) for i in range(s)]

    def gather(self, files: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
        """Values of sorted ids (0 where -1)."""
        out = np.zeros(len(ids), np.int64)
        edges = np.append(self.words.base[:-1], self.words.total + 1)
        at = np.searchsorted(ids, edges)
        for s in np.flatnonzero(np.diff(at)):
            out[at[s] : at[s + 1]] = files[s][ids[at[s] : at[s + 1]] - edges[s]]
        return out

    def pair_counts(self, prev: np.ndarray, key: np.ndarray) -> np.ndarray:
        shards = len(self.pair)
        shard = key_shard(prev, key, self.hot, shards, self.words.total)
        order = np.lexsort((key, shard))
        at = np.searchsorted(shard[order], np.arange(shards + 1))
        out = np.zeros(len(key), np.int64)
        for s in np.flatnonzero(np.diff(at)):
            some = order[at[s] : at[s + 1]]
            have, want = self.pair[s], key[some]
            if len(have):
                i = np.minimum(np.searchsorted(have, want), len(have) - 1)
                out[some] = np.where(have[i] == want, self.often[s][i], 0)
        return out

    def score(self, texts: Texts) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score and score of each text."""
        m, n = self.m, len(texts)
        cur, _, bounds, _ = tokens_of(texts)
        ids = self.words.ids(cur)
        prev = np.empty_like(ids)
        prev[1:] = ids[:-1]
        prev[bounds[:-1]] = m.types
        words, which = np.unique(ids, return_inverse=True)
        count = self.gather(self.count, words)
        cont = self.gather(self.by_id["cont"], words)
        v1 = m.types + 1
        base = np.log10((count + ALPHA) / (m.tokens + ALPHA * v1))
        d = np.array([0.0, *m.d1])
        if m.pairs:
            spare = (d[1] * m.spread[0] + d[2] * m.spread[1] + d[3] * m.spread[2]) / m.pairs
            low = (cont - d[np.minimum(cont, 3)]) / m.pairs + spare / v1
        else:
            low = np.full(len(words), 1 / v1)
        ctx, back = np.unique(prev, return_inverse=True)
        total, one, two, more = (self.gather(self.by_id[k], ctx) for k in ("sum", "one", "two", "more"))
        e = np.array([0.0, *m.d2])
        known = total > 0
        gamma = np.where(known, (e[1] * one + e[2] * two + e[3] * more) / np.maximum(total, 1), 1.0)
        p = gamma[back] * low[which]
        both = (ids >= 0) & (prev >= 0)
        key, kth = np.unique(key_of(prev[both], ids[both]), return_inverse=True)
        c = self.pair_counts((key >> U(32)).astype(np.int64), key)[kth]
        p[both] += (c - e[np.minimum(c, 3)]) / np.maximum(total[back][both], 1)
        owner = np.repeat(np.arange(n), np.diff(bounds))
        return np.diff(bounds), np.bincount(owner[ids >= 0], minlength=n), np.bincount(owner, base[which], n), np.bincount(owner, np.log10(p), n)


_OPEN: dict[str, Scorer] = {}


def score(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity), one per row.

    The model learns from the texts whose ``crc32(doc_id as text) mod 10`` is not 0 (a null id
    counts as held out) and scores all.  Tokens are the lower-cased words and one end; a null text is
    just the end.  With nothing to learn from, every token has an equal chance.  Rows with repeated
    ids are scored one by one; other columns are ignored.
    """
    rest = F.crc32(F.col("doc_id").cast("bigint").cast("string")) % 10
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(rest == 0, F.lit(True)).alias("held_out"), F.col(text).cast("string").alias("text"))
    model = train(rows.where("NOT held_out"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if model.folder not in _OPEN:
            _OPEN.clear()
            _OPEN[model.folder] = Scorer(model)
        scorer = _OPEN[model.folder]
        for batch in batches:
            for part in slices(batch, "text"):
                n, known, base, full = scorer.score(texts_of(part.column("text")))
                cols = [part.column("doc_id"), part.column("held_out"), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(full)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = rows.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
