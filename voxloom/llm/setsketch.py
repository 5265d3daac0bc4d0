"""Near-duplicate documents by SetSketch registers: banded candidates, joint estimate, exact check.

A document's set holds the hashes of its distinct word shingles.  Its sketch has ``m`` registers;
register i is ``floor(1 - log_b(v_i))`` for the least value ``v_i`` among independent exponential
variables of the elements, truncated to ``0 .. q + 1``.  Registers of a union are the maxima of
the registers (``merge``), and two sketches share a register with a chance close to the Jaccard
similarity.  Runs of registers (bands) give join keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U, mix, shingle_sets, slices, texts_of
from .shared import components, write_table

#: Registers, and registers in a band: a pair at similarity 0.8 shares none of the 40 bands with
#: a chance of 5e-6.
M, ROWS = 240, 6
BASE, TOP = 1.001, 65534
_RATE = 20.0
#: Standard errors below the threshold at which an estimate still gets the exact check.
SLACK = 5.0
#: Shingles in a block of the completing comparison (8 bytes each).
BLOCK = 1_000_000


def registers(hashes: np.ndarray, bounds: np.ndarray, m: int = M) -> np.ndarray:
    """Sketches of the sets hashes[bounds[i]:bounds[i + 1]]: an (n, m) array of uint16.

    An element is a Poisson process: its j-th point comes an exponential time after the one
    before and hits a random register, so a register's first hit over an element's points is
    exponential.  Only points before a horizon that fills all registers are made; a set whose
    registers are not all filled by then gets a horizon twice as far.  Work is O(n + m log m).
    """
    n = len(bounds) - 1
    low = np.full((n, m), np.inf)
    count = np.diff(bounds)
    todo = np.flatnonzero(count)
    horizon = np.zeros(n)
    horizon[todo] = (np.log(m) + 6.0) * m / count[todo]
    owner_all = np.repeat(np.arange(n), count)
    while len(todo):
        open_ = np.zeros(n, bool)
        open_[todo] = True
        pick = open_[owner_all]
        owner, state, when = owner_all[pick], hashes[pick], np.zeros(int(pick.sum()))
        low[todo] = np.inf
        while len(owner):
            state = mix(state + U(0x9E3779B97F4A7C15))
            when = when - np.log((state >> U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
            keep = when <= horizon[owner]
            owner, state, when = owner[keep], state[keep], when[keep]
            place = (mix(state ^ U(0x5851F42D4C957F2D)) % U(m)).astype(np.int64)
            np.minimum.at(low.reshape(-1), owner * m + place, when)
        todo = todo[np.isinf(low[todo]).any(axis=1)]
        horizon[todo] *= 2
    # a point of rate one over m registers makes each register's value exponential with rate 1 / m
    with np.errstate(divide="ignore", invalid="ignore"):
        k = np.floor(1.0 - np.log(low / m / _RATE) / np.log(BASE))
    return np.where(np.isinf(low), 0, np.clip(k, 0, TOP)).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sketched sets."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """An (n, bands) array of signed 64-bit keys, each hashing a band's number and registers."""
    n, m = regs.shape
    bands = m // rows
    keys = np.tile(mix(np.arange(1, bands + 1, dtype=U)), (n, 1))
    blocks = regs[:, : bands * rows].reshape(n, bands, rows).astype(U)
    for r in range(rows):
        keys = mix(keys * U(0xD6E8FEB86659FD93) + blocks[:, :, r] + U(r + 1))
    return keys.view(np.int64)


def joint_jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of sketch pairs, given the sets' exact sizes.

    With shares u, v of the sizes, a register is larger in a with probability p(u - vJ), in b with
    p(v - uJ), else equal; p(x) = -log_b(1 - x (b - 1) / b).  The likelihood is concave in J: bisection.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = na / np.maximum(na + nb, 1)
    v = 1 - u
    c = (BASE - 1) / BASE

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * c) / np.log(BASE)

    lo, hi = np.zeros(len(u)), np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))
    for _ in range(30):
        j = (lo + hi) / 2
        x, y = p(u - v * j), p(v - u * j)
        dx, dy = -v, -u
        slope = more * dx / x + less * dy / y - same * (dx + dy) / np.maximum(1 - x - y, 1e-12)
        lo, hi = np.where(slope > 0, j, lo), np.where(slope > 0, hi, j)
    return (lo + hi) / 2


def sketch_table(docs: DataFrame, text: str, width: int) -> DataFrame:
    """Per document: id, n (set size), f1, f2 (set fingerprint), keys (bands), regs (bytes)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text"):
                hashes, bounds = shingle_sets(texts_of(part.column("text")), width)
                n = np.diff(bounds)
                regs = registers(hashes, bounds)
                total = np.concatenate([np.zeros(1, U), np.cumsum(mix(hashes), dtype=U)])
                other = np.concatenate([np.zeros(1, U), np.cumsum(mix(hashes ^ U(0xC2B2AE3D27D4EB4F)), dtype=U)])
                keys = pa.array(band_keys(regs).reshape(-1))
                at = np.arange(len(n) + 1, dtype=np.int32) * (M // ROWS)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(n.astype(np.int64)),
                        pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)),
                        pa.array((other[bounds[1:]] - other[bounds[:-1]]).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(at), keys),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                    ],
                    names=["id", "n", "f1", "f2", "keys", "regs"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, n bigint, f1 bigint, f2 bigint, keys array<bigint>, regs binary")


def set_table(docs: DataFrame, ids: DataFrame, text: str, width: int) -> DataFrame:
    """The shingle hashes (sorted, 8 bytes each) of the documents in ``ids`` (id)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text"):
                hashes, bounds = shingle_sets(texts_of(part.column("text")), width)
                sets = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], names=["id", "hashes"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.join(ids, "id", "left_semi").mapInArrow(run, "id bigint, hashes binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ha"), batch.column("hb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
    b = sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ha", "hb").mapInArrow(run, "a bigint, b bigint")


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose joint estimate does not rule the similarity out."""
    limit = percent / 100
    least = limit - SLACK * (limit * (1 - limit) / M) ** 0.5

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("ra", "rb"))
                na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
                ok = (joint_jaccard(ra, rb, na, nb) >= least) & (np.minimum(na, nb) >= limit * np.maximum(na, nb) - 1e-9)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    a = sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    b = sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a bigint, b bigint")


def _across(shared: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components that some bucket holds together.

    In a bucket with several components the one with most members is its base.  Under each
    base, the members of other components (``light``) meet every member of those buckets, so
    each pair of a bucket that is not yet connected is checked, once for all buckets of the base.
    Both sides are dealt into blocks by size; a block is compared exactly through an inverted
    index of its light sets, so no pair becomes a row unless it is a link.
    """
    known = shared.join(labels, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    known = write_table(known, "members")
    per = known.groupBy("key", "component").agg(F.count("*").alias("c"))
    mixed = per.groupBy("key").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("k")).where("k > 1")
    under = known.join(mixed.select("key", F.col("m.component").alias("base")), "key").select("base", "id", "n", (F.col("component") != F.col("base")).alias("light")).distinct()
    under = write_table(under, "mixed")
    size = under.groupBy("base").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("light"), F.col("n")).otherwise(0)).alias("some"))
    size = size.select("base", F.ceil(F.col("some") / F.lit(BLOCK)).cast("int").alias("rows"), F.ceil(F.col("all") / F.lit(BLOCK)).cast("int").alias("cols"))
    dealt = under.join(size, "base")
    light = dealt.where("light").select("base", "id", F.pmod(F.xxhash64("id", F.lit(1)), "rows").alias("r"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"), F.lit(True).alias("light"))
    every = dealt.select("base", "id", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), F.pmod(F.xxhash64("id", F.lit(2)), "cols").alias("c"), F.lit(False).alias("light"))
    placed = light.select("base", "id", F.col("r").cast("int"), F.col("c").cast("int"), "light").unionByName(every.select("base", "id", F.col("r").cast("int"), F.col("c").cast("int"), "light"))

    def run(table):
        import pyarrow as pa

        is_light = table.column("light").to_numpy(zero_copy_only=False).astype(bool)
        ids = table.column("id").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), U) for x in table.column("hashes")]
        rows = np.flatnonzero(is_light)
        out_a, out_b = [], []
        if len(rows):
            n = np.array([len(sets[i]) for i in rows])
            hashes = np.concatenate([sets[i] for i in rows])
            owner = np.repeat(np.arange(len(rows)), n)
            order = np.argsort(hashes, kind="stable")
            hashes, owner = hashes[order], owner[order]
            for i in np.flatnonzero(~is_light):
                lo, hi = np.searchsorted(hashes, sets[i], "left"), np.searchsorted(hashes, sets[i], "right")
                some = hi - lo
                if not some.any():
                    continue
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(some)[:-1]]), some) + np.arange(some.sum())
                both = np.bincount(owner[at], minlength=len(rows))
                hit = (both > 0) & (100 * both >= percent * (n + len(sets[i]) - both)) & (ids[rows] != ids[i])
                out_a += ids[rows[hit]].tolist()
                out_b += [int(ids[i])] * int(hit.sum())
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    blocks = placed.join(sets, "id").select("base", "r", "c", "id", "light", "hashes")
    return blocks.groupBy("base", "r", "c").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate groups: rows (doc_id, n_shingles, component_id, kept), one per input row.

    Documents are linked when ``100 * |A & B| >= percent * |A | B|`` over their distinct
    lower-cased ``width``-word shingles; ``component_id`` is the least id reachable and
    ``kept`` says that the document is it.  Equal sets are one node, so exact copies never meet
    pairwise; each bucket first links its members to one pivot and only pairs of a
    bucket that stay apart are compared further (``_across``).

    Null or wordless texts have an empty set and are linked with nothing.  Rows with a null id
    are returned with a null component and kept.  Rows that share an id are one document for
    linking.  Other columns are ignored; an empty table gives an empty result.
    """
    sketches = write_table(sketch_table(docs, text, width), "sketch")
    full = sketches.where("n > 0 AND id IS NOT NULL")
    classes = full.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"))
    member = full.select("id", "n", "f1", "f2").join(classes, ["n", "f1", "f2"]).select("id", "rep")
    nodes = full.join(classes.select(F.col("rep").alias("id"), "n", "f1", "f2"), ["id", "n", "f1", "f2"], "left_semi")
    keyed = nodes.select(F.explode("keys").alias("key"), "id", "n")
    hot = keyed.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("pivot")).where("c > 1").select("key", "pivot")
    shared = write_table(keyed.join(hot, "key"), "shared")
    pairs = shared.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    touched = shared.select("id").distinct()
    sets = write_table(set_table(docs, touched, text, width).dropDuplicates(["id", "hashes"]), "sets")
    few = sketches.join(touched, "id", "left_semi").select("id", "n", "regs")
    links = write_table(_verified(_likely(pairs, few, percent), sets, percent), "links")
    labels = components(links, "star")
    more = _across(shared.select("key", "id", "n"), labels, sets, percent)
    joined = more.union(labels.select(F.col("id"), F.col("component")))
    final = components(joined, "near")
    named = member.join(final.select(F.col("id").alias("rep"), "component"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component")).distinct()
    named = named.groupBy("id").agg(F.min("component").alias("component"))
    return sketches.select("id", "n").join(named, "id", "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, all columns as they were."""
    gone = near_duplicates(docs, text, width, percent).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["_gone"], "left_anti")
