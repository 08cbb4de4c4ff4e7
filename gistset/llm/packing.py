"""Packing documents into windows: best-fit decreasing over a segment tree of remaining capacities."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sent_if_small, slices, small_batches
from .tokenizing import encoder


#: Bytes of a row group of the written pieces, held in memory while it fills.
_ROW_GROUP = 16 << 20


class CapacityTree:
    """Segment tree over remaining capacities 0..size: which capacities have open windows."""

    def __init__(self, size: int):
        self.n = 1 << size.bit_length()
        self.any = [False] * (2 * self.n)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.n
        self.any[i] = is_open
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int:
        """The smallest capacity of at least ``need`` that has an open window, or -1."""
        i = need + self.n
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):
                i >>= 1
            if i <= 1:
                return -1
            i += 1
            while i < self.n:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.n


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit-decreasing places for ``counts[length]`` pieces of each length below ``size``.

    Pieces of one length are alike, and so are windows filled alike: windows are kept as groups
    (first window, how many, filled) under their remaining capacity, and whole groups take pieces at
    once. The result and the work depend on the number of lengths, not on the number of pieces.
    Returns rows (length, first rank, last rank + 1, first window, pieces a window, offset): the piece
    of rank r goes to window ``first + (r - first rank) // pieces`` at ``offset + ((r - first rank) % pieces) * length``.
    """
    tree, groups, windows, rows = CapacityTree(size), {}, 0, []

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            groups.setdefault(remaining, []).append((first, n))
            tree.set(remaining, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = tree.tightest(length)
            if remaining < 0:
                first, n, remaining = windows, -(-left // (size // length)), size
                windows += n
            else:
                first, n = groups[remaining].pop()
                if not groups[remaining]:
                    del groups[remaining]
                    tree.set(remaining, False)
            each = remaining // length
            full = min(n, left // each)
            used = full
            if full:
                rows.append((length, rank, rank + full * each, first, each, size - remaining))
                put(remaining - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and used < n:  # one window takes the rest
                rows.append((length, rank, rank + left, first + used, left, size - remaining))
                put(remaining - left * length, first + used, 1)
                left, used = 0, used + 1
            put(remaining, first + used, n - used)
    return rows


def cut_pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", as_bytes: bool = False) -> DataFrame:
    """Tokenize, append ``end_id``, and cut: full windows first, then the rest of the document.

    Returns ``id_col, start, length, doc_tokens, ids, part, rank``; ``rank`` numbers the pieces of one
    length within the task ``part``. ``ids`` is an array, or with ``as_bytes`` the ids as little-endian
    unsigned 32-bit integers in one binary value. Nulls and repeats: see ``pack``.
    """
    kind = dict(docs.dtypes)[id_col]
    own = docs.select(docs[id_col].alias("k"), docs[text_col].alias("t"))

    def run(batches: Iterable[pa.RecordBatch]):
        part, enc, seen = TaskContext.get().partitionId(), encoder(tokenizer), np.zeros(size + 1, np.int64)
        for batch in slices(batches, "t", 1 << 20):
            raw = enc.encode(batch.column(1).to_pylist(), end_id)
            n = np.array([len(x) // 4 for x in raw], np.int64)
            pieces = -(-n // size)
            doc = np.repeat(np.arange(len(n)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
            length = np.minimum(size, n[doc] - start)
            order = np.argsort(length, kind="stable")
            by = length[order]
            rank = np.empty(len(doc), np.int64)
            rank[order] = np.arange(len(doc)) - np.searchsorted(by, by) + seen[by]
            seen += np.bincount(length, minlength=size + 1)
            ends, whole = np.concatenate([[0], np.cumsum(length)]).astype(np.int32), b"".join(raw)
            if as_bytes:
                ids = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(4 * ends), pa.py_buffer(whole)])
            else:
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(whole, "<i4")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(n[doc]), ids, pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)],
                [id_col, "start", "length", "doc_tokens", "ids", "part", "rank"],
            )

    return own.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, doc_tokens long, ids {'binary' if as_bytes else 'array<int>'}, part int, rank long")


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", as_bytes: bool = False) -> DataFrame:
    """Pack all documents into windows of at most ``size`` tokens.

    Returns a row per piece: ``id_col, start, length, doc_tokens, sequence_id, offset, ids`` (an array, or
    with ``as_bytes`` a binary value, see ``cut_pieces``).
    Documents are cut into full windows, which stand alone, and one rest, which best-fit decreasing
    puts into the tightest open window. The driver sees one count per piece length (at most ``size``
    rows), never the pieces; ranks among pieces of one length come from per-task counts, so the
    packing is the same best-fit decreasing as over one sorted list, without a global sort.

    The token ids are written once to the shared folder, since tokenizing again would cost more and
    ranks must not change if a task is lost. A null text is empty (one piece with ``end_id``);
    null and repeated ids are packed as documents of their own; an empty table gives no rows;
    other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        pieces = materialize(cut_pieces(docs, tokenizer, size, end_id, id_col, text_col, as_bytes), "pieces", _ROW_GROUP)
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    before = materialize(by_part.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "piece-counts")
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    n_full = counts.pop(size, 0)
    rows = [(ln, a, first + n_full, each, off) for ln, a, _, first, each, off in plan(counts, size)]
    if n_full:
        rows.append((size, 0, 0, 1, 0))
    # lengths are at most `size` and each makes a few rows, whatever the number of documents
    by_length: dict[int, list[tuple[int, ...]]] = {}
    for ln, *place in sorted(rows):
        by_length.setdefault(ln, []).append(tuple(place))
    places = spark.createDataFrame(list(by_length.items()), "length long, places array<struct<low:long,first:long,each:long,off:long>>")
    ranked = pieces.join(sent_if_small(before.select("length", "part", "before")), ["length", "part"]).withColumn("rank", F.col("before") + F.col("rank"))
    placed = ranked.join(F.broadcast(places), "length").withColumn("at", F.element_at(F.filter("places", lambda p: p["low"] <= F.col("rank")), -1))
    k = F.col("rank") - F.col("at.low")
    sequence = F.col("at.first") + F.floor(k / F.col("at.each"))
    return placed.select(id_col, "start", "length", "doc_tokens", "ids", sequence.cast("long").alias("sequence_id"), (F.col("at.off") + F.pmod(k, F.col("at.each")) * F.col("length")).cast("long").alias("offset"))


def sequences(packed: DataFrame, size: int = 2048, pad_id: int = 0) -> DataFrame:
    """The windows themselves, of ``packed`` with ids as arrays: ``sequence_id, n_tokens, ids``, padded to ``size`` unless filled to a power of two."""
    whole = packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("own"))
    n = F.size("own")
    pad = F.when(F.bit_count(n) == 1, 0).otherwise(size - n)
    return whole.select("sequence_id", n.cast("long").alias("n_tokens"), F.concat("own", F.array_repeat(F.lit(pad_id), pad)).alias("ids"))
