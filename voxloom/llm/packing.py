"""First-fit-decreasing packing of token pieces, in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Known, default_path, look_up, merger, parts
from .shared import write_table

LENGTH = 2048
END = 1
#: Pieces in a group, on average: a group's unfilled last bins cost about one sequence.
GROUP = 4096


class Bins:
    """Open bins by number; ``place`` finds the first bin with room through a tournament tree.

    Leaf i holds the room left in bin i and an inner node the larger room of its two children,
    so going left wherever the left child has room leads to the lowest-numbered bin that fits.
    """

    def __init__(self, n: int, room: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.room = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Bin and room before placing; the caller gives at most n pieces of at most ``room``."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        left = room[at]
        room[at] = left - size
        bin_no = at - self.leaves
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return bin_no, left


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece; larger pieces first, ties by position."""
    order = np.argsort(-sizes, kind="stable")
    bins, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    tree = Bins(len(sizes), room)
    for i in order.tolist():
        bins[i], left = tree.place(int(sizes[i]))
        offset[i] = room - left
    return bins, offset


_KNOWN: dict[str, Known] = {}


def ids_of(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Ids of whole texts, each followed by the end id.

    Equal to the library's: each distinct pre-token is merged once, and a text's ids are its
    pre-tokens' ids in order, since merges never cross pre-tokens.
    """
    if path not in _KNOWN:
        m = merger(path)
        _KNOWN[path] = Known(path, lambda data, sizes: m.merge(data, sizes, ids_too=True))
    known = _KNOWN[path]
    special = known.merger.special
    plan, plain = [], []
    for text in texts:
        cut = list(parts(text or "", special))
        plan.append([s for s, _ in cut])
        plain += [piece for s, piece in cut if s is None]
    places, bound = look_up(plain, known)
    n = known.counts[places]
    at = np.cumsum(n) - n
    flat = known.ids[np.repeat(known.starts[places] - at, n) + np.arange(int(n.sum()))]
    edge = np.append(at, len(flat))[bound]
    out, k, end = [], 0, np.array([END], np.uint32)
    for cut in plan:
        ids = []
        for s in cut:
            if s is None:
                ids.append(flat[edge[k] : edge[k + 1]])
                k += 1
            else:
                ids.append(np.array([special[s]], np.uint32))
        out.append(np.concatenate([*ids, end]))
    return out


def token_pieces(docs: DataFrame, text: str = "text", length: int = LENGTH, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens[, ids]) of at most ``length`` tokens."""
    path = path or default_path()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .kernel import slices

        for batch in batches:
            for part in slices(batch, "text"):
                row, start, size, crc, total, kept = [], [], [], [], [], []
                for i, ids in enumerate(ids_of(part.column("text").to_pylist(), path)):
                    n = len(ids)
                    for at in range(0, n, length):
                        piece = ids[at : at + length].astype("<u4").tobytes()
                        row.append(i)
                        start.append(at)
                        size.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        if with_ids:
                            kept.append(piece)
                cols = [part.column("doc_id").take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols.append(pa.array(kept, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids
    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, text: str = "text", length: int = LENGTH, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Every token of every text, in sequences of at most ``length``: the pieces and their places.

    A document is its ids and one end id; it is cut at multiples of ``length`` and the pieces are
    packed first-fit decreasing within random groups of about ``GROUP`` pieces, dealt by row, so that no
    repeated id or text fills one.  Columns: those of
    ``token_pieces`` and sequence_id, offset.  A null or empty text is one piece, the end id.
    Rows are packed one by one: null or repeated ids and repeated rows lose nothing.  Full pieces
    are sequences of their own.  An empty table gives an empty result.
    """
    pieces = write_table(token_pieces(docs, text, length, path, with_ids), "pieces")
    groups = max(1, -(-pieces.count() // GROUP))

    def run(table):
        import pyarrow as pa

        sizes = table.column("length").to_numpy()
        bins, offset = first_fit_decreasing(sizes, length)
        group = table.column("group").to_numpy().astype(np.int64)
        out = table.drop_columns(["group"])
        return out.append_column("sequence_id", pa.array((group << 32) | bins)).append_column("offset", pa.array(offset))

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids
    # the row's place in the written table is the salt: repeated rows spread too, and a task run again deals alike
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(run, schema + ", sequence_id bigint, offset bigint")
