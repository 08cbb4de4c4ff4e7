"""Repeated substrings: run-length compressed Burrows-Wheeler indexes over sharded candidate text.

A window is ``width`` consecutive bytes. The smallest hash of the short grams in a window names its
shard, so equal windows meet in one shard wherever they stand, and a document falls into pieces
whose windows share a name. Pieces whose name occurs in one document only hold no repeated window
and go nowhere; each shard indexes the others' distinct texts.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_heavy, materialize, sent_if_small, slices, small_batches, text_hash
from .near_dedup import mix

GRAM = 20
#: Windows a piece holds at most (long periodic stretches are cut), and most bits of the name filter.
_MOST, _FILTER_BITS = 256, 30
#: Distinct texts of one name, and their bytes, above which its windows are grouped by themselves, without an index.
HOT_TEXTS, HOT_BYTES = 50_000, 1 << 20
#: Bytes of text from which on a shard's names go into one index.
_INDEX_BYTES = 1 << 20


def names(raw: np.ndarray, width: int, gram: int = GRAM) -> np.ndarray:
    """For each window of ``width`` bytes the smallest hash of its ``gram``-byte grams (16 to 24 bytes)."""
    if len(raw) < width:
        return np.zeros(0, np.uint64)
    x = raw.astype(np.uint64)
    for half in (1, 2, 4):
        x = x[:-half] | (x[half:] << np.uint64(8 * half))
    n = len(raw) - gram + 1
    with np.errstate(over="ignore"):
        h = mix(x[:n] * np.uint64(0x9E3779B97F4A7C15) + mix(x[8 : n + 8]) + x[gram - 8 : n + gram - 8] * np.uint64(0xD6E8FEB86659FD93))
    left, span = width - gram + 1, 1
    while 2 * span <= left:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (left - span)], h[left - span :]) if left > span else h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, base, np.uint64)) if n else np.zeros(0, np.uint64)
        down = np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64)) if n else np.zeros(0, np.uint64)
    return up, down


def pieces(raws: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, name, content hash, first window, number of windows) of the pieces of documents, in order."""
    sizes = np.array([len(r) for r in raws], np.int64)
    raw = np.frombuffer(b"".join(raws), np.uint8)
    h = names(raw, width)
    none = np.zeros(0, np.int64)
    if not len(h):
        return none, h, none, none, none
    stop = np.cumsum(sizes)
    valid = np.zeros(len(raw) + 1, np.int8)  # a window starts in its document and ends in it
    valid[(stop - sizes)[sizes >= width]] += 1
    np.subtract.at(valid, (stop - width + 1)[sizes >= width], 1)
    valid = np.cumsum(valid)[: len(h)].astype(bool)
    fresh = np.concatenate([[True], h[1:] != h[:-1]])
    fresh[(stop - sizes)[(sizes >= width)]] = True
    begin = np.flatnonzero(fresh & valid)
    edge = np.flatnonzero(fresh | ~valid)
    after = np.append(edge, len(h))[np.searchsorted(edge, begin, "right")]
    n = after - begin
    cuts = -(-n // _MOST)
    if (cuts > 1).any():
        at = np.repeat(np.arange(len(n)), cuts)
        step = (np.arange(len(at)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * _MOST
        begin, n = begin[at] + step, np.minimum(_MOST, n[at] - step)
    doc = np.searchsorted(stop, begin, "right")
    x = raw.astype(np.uint64)
    for half in (1, 2, 4):
        x = x[:-half] | (x[half:] << np.uint64(8 * half))
    up, down = _powers(len(x))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x) * up, dtype=np.uint64)])
        content = mix((total[begin + n + width - 8] - total[begin]) * down[begin] + n.astype(np.uint64))
    return doc, h[begin], content.view(np.int64), begin - (stop - sizes)[doc], n


class RunLengthIndex:
    """Samples at the run ends of the Burrows-Wheeler transform of several texts.

    The transform is cut into runs of one sign. Within a run, neighbouring suffixes stay neighbours one
    step to the left, so it is enough to keep, where a run ends, a suffix's place in the text, that of its neighbour in
    suffix order, and how long both agree (up to ``depth``): three numbers a run, few where texts repeat.
    All other places follow from the next sample to their right.
    """

    def __init__(self, texts: list[bytes], depth: int):
        text = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)  # no UTF-8 text holds this byte
        self.depth, self.n, self.ends = depth, len(text), np.cumsum([len(t) + 1 for t in texts]) - 1
        words = np.zeros(self.n + depth + 8, np.uint64)  # the eight bytes from each place on
        for j in range(8):
            words[: self.n - j] |= text[j:].astype(np.uint64) << np.uint64(56 - 8 * j)
        order, row = self._sorted(words[: self.n])
        before = text[order - 1]
        begins = np.concatenate([[True], before[1:] != before[:-1]])
        first = row[0]  # the first place has nothing before it
        begins[first : first + 2] = True
        self.n_runs = int(begins.sum())
        place = order[begins] - 1
        place = np.append(place[place >= 0], self.n - 1)
        place.sort()
        above = row[place]
        self.place, self.neighbour = place, np.where(above > 0, order[above - 1], place)
        self.agree = np.where(above > 0, self._agree(words, self.place, self.neighbour), 0)

    @staticmethod
    def _sorted(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffix order, row of each suffix) by prefix doubling; only suffixes that still tie are sorted again."""
        n, width = len(words), 8
        order = np.argsort(words).astype(np.int32)
        key = words[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        row = np.empty(n, np.int32)
        row[order] = np.maximum.accumulate(np.where(first, np.arange(n, dtype=np.int32), 0))
        while True:
            tied = ~first
            tied[:-1] |= tied[1:].copy()
            rows = np.flatnonzero(tied)
            if not len(rows):
                return order, row
            at = order[rows]
            after = at.astype(np.int64) + width
            key = (row[at].astype(np.int64) << 32) + np.where(after < n, row[np.minimum(after, n - 1)] + 1, 0)
            by = np.argsort(key)
            at, key = at[by], key[by]
            order[rows] = at
            first[rows] = np.concatenate([[True], key[1:] != key[:-1]])
            row[at] = np.maximum.accumulate(np.where(first[rows], rows, 0))
            width *= 2

    def _agree(self, words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes from places ``a`` and ``b`` on are equal, up to ``depth``."""
        out, live = np.full(len(a), self.depth, np.int32), np.arange(len(a))
        for done in range(0, self.depth, 8):
            differ = words[np.minimum(a[live] + done, self.n)] ^ words[np.minimum(b[live] + done, self.n)]
            ended = differ != 0
            found, x = live[ended], differ[ended]
            same = sum((x < (np.uint64(1) << np.uint64(56 - 8 * j))).astype(np.int32) for j in range(7))
            out[found] = np.minimum(self.depth, done + same)
            live = live[~ended]
        return out

    def matching_statistics(self, block: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Stream the texts: (places, length of the match, place of the match with the neighbour in suffix order)."""
        for a in range(0, self.n, block):
            at = np.arange(a, min(self.n, a + block))
            sample = np.searchsorted(self.place, at)
            back = self.place[sample] - at
            yield at, self.agree[sample] + back, self.neighbour[sample] - back


def repeated_windows(texts: list[bytes], owner: np.ndarray, width: int) -> list[np.ndarray]:
    """For each window of each text whether a text of a smaller owner holds it."""
    by = np.argsort(owner, kind="stable")
    index = RunLengthIndex([texts[i] for i in by.tolist()], width)
    number = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[-1], index.ends])))
    root = np.arange(index.n)
    for at, length, other in index.matching_statistics():
        long = (length >= width) & (at + width <= index.ends[number[at]])  # matches do not cross a text's end
        root[at[long]] = other[long]
    while True:  # equal windows are neighbours: follow them to the first
        up = root[root]
        if np.array_equal(up, root):
            break
        root = up
    lowest = np.empty(index.n, np.int64)
    lowest[root[::-1]] = np.arange(index.n)[::-1]  # of several the last written stays: the smallest place, and owner
    own = owner[by]
    less = own[number[lowest[root]]] < own[number]
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(texts)
    begin = np.concatenate([[0], index.ends[:-1] + 1])
    for j, i in enumerate(by.tolist()):
        out[i] = less[begin[j] : begin[j] + max(0, len(texts[i]) - width + 1)]
    return out


def _collected(spark) -> None:
    """Let Spark drop the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_spans(docs: DataFrame, total_bytes: int, width: int = 50, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """Of rows ``k, r, t`` of about ``total_bytes``: ``k, r, spans``, runs (first, last) of windows that a smaller ``k`` holds too."""
    spark = docs.sparkSession

    def read(batches: Iterable[pa.RecordBatch]):
        """(ids, hashes, bytes) of documents, about half a megabyte at a time."""
        for batch in slices(batches, "t", 1 << 19):
            yield batch.column(0).to_numpy(), batch.column(1).to_numpy(), [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]

    filter_bits = min(_FILTER_BITS, max(20, int(total_bytes >> 3).bit_length()))
    bucket_bits = min(filter_bits - 3, max(4, int(total_bytes >> 22).bit_length()))
    low_bits, shift = np.uint64((1 << filter_bits) - 1), np.uint64(filter_bits - bucket_bits)
    slot_bits, high = np.uint64((1 << (filter_bits - bucket_bits)) - 1), np.uint64(32 + filter_bits - bucket_bits)

    def name_blobs(batches: Iterable[pa.RecordBatch]):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            m, k = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            part = ((m & low_bits) >> shift).astype(np.int64)
            # within a part 32 bits tell names apart; of two that they do not, both count as found twice
            m = ((m & slot_bits) | ((m >> high) << shift)).astype(np.uint32)
            by = np.lexsort((k, m, part))
            m, k, part = m[by], k[by], part[by]
            turn = (m[1:] != m[:-1]) | (part[1:] != part[:-1])
            first, last = np.concatenate([[True], turn]), np.concatenate([turn, [True]])
            on = first | last  # of one name here only its smallest and largest id matter
            m, k, part = m[on], k[on], part[on]
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            ends = np.append(cut[1:], len(part)).tolist()
            blobs = [m[a:b].tobytes() + k[a:b].tobytes() for a, b in zip(cut.tolist(), ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.array(blobs, pa.binary())], ["part", "blob"])

        for ks, rs, raws in read(batches):
            doc, m, *_ = pieces(raws, width)
            held.append((m, ks[doc]))
            if sum(len(m) for m, _ in held) > 1_000_000:
                yield flush()
        if any(len(m) for m, _ in held):
            yield flush()

    def shared_names(key: tuple, blobs: pa.Table) -> pa.Table:
        """The filter bits of names that two documents or more hold."""
        raw = [(np.frombuffer(x, np.uint32, len(x) // 12), np.frombuffer(x[len(x) // 3 :], np.int64)) for x in blobs.column("blob").to_pylist()]
        m, k = np.concatenate([x[0] for x in raw]), np.concatenate([x[1] for x in raw])
        by = np.lexsort((k, m))
        m, k = m[by], k[by]
        twice = np.flatnonzero((m[1:] == m[:-1]) & (k[1:] != k[:-1]))
        bits = np.zeros(1 << (filter_bits - bucket_bits), np.uint8)
        bits[(m[twice] & np.uint32(len(bits) - 1)).astype(np.int64)] = 1
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    def bloom(found: list) -> bytes:
        step = 1 << (filter_bits - bucket_bits - 3)
        table = np.zeros(1 << (filter_bits - 3), np.uint8)
        for r in found:
            table[r["part"] * step : (r["part"] + 1) * step] |= np.frombuffer(bytes(r["bits"]), np.uint8)
        return table.tobytes()

    # a Bloom filter of a bit for eight bytes of text, 128 MB at most: a false hit costs a piece, none is missed
    blobs = docs.mapInArrow(name_blobs, "part long, blob binary")
    sent = spark.sparkContext.broadcast(bloom(blobs.groupBy("part").applyInArrow(shared_names, "part long, bits binary").collect()))
    _collected(spark)

    def hits(table: np.ndarray, m: np.ndarray) -> np.ndarray:
        low = (m & low_bits).astype(np.int64)
        return np.flatnonzero((table[low >> 3] >> (low & 7).astype(np.uint8)) & 1)

    def piece_rows(batches: Iterable[pa.RecordBatch]):
        table = np.frombuffer(sent.value, np.uint8)
        for ks, rs, raws in read(batches):
            doc, m, th, at, n = pieces(raws, width)
            on = hits(table, m)
            yield pa.RecordBatch.from_arrays([pa.array(m[on].view(np.int64)), pa.array(th[on]), pa.array(ks[doc[on]]), pa.array(rs[doc[on]]), pa.array(at[on].astype(np.int32)), pa.array(n[on].astype(np.int32))], ["m", "th", "k", "r", "at", "n"])

    with small_batches(spark):
        cand = materialize(docs.mapInArrow(piece_rows, "m long, th long, k long, r long, at int, n int"), "pieces")
    texts_of = cand.groupBy("m", "th").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.max("n").alias("n"), F.count(F.lit(1)).alias("places"))
    distinct = materialize(texts_of, "piece-texts")
    sizes = distinct.groupBy("m").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("n") + width).alias("bytes"), F.min("first").alias("lo"), F.max("last").alias("hi")).where("lo < hi")
    sizes = materialize(sizes.select("m", "c", ((F.col("c") > hot_texts) | (F.col("bytes") > HOT_BYTES)).alias("hot"), (F.col("c") == 1).alias("single")), "names")
    named = materialize(join_heavy(distinct, sizes, ["m"], "c", whole=False).select("m", "th", "first", "places", "hot", "single"), "piece-names")
    discard(distinct, sizes)
    _collected(spark)
    # a name with one text needs no index: its first owner is the text's; of the others the texts are read again
    bit = F.col("m").bitwiseAND(F.lit((1 << filter_bits) - 1)) + 1
    several_bits = named.where("not single").groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    table = np.zeros(1 << (filter_bits - 3), np.uint8)
    for r in several_bits:
        table[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    sent2 = spark.sparkContext.broadcast(table.tobytes())
    del several_bits, table

    def text_rows(batches: Iterable[pa.RecordBatch]):
        table = np.frombuffer(sent2.value, np.uint8)
        for ks, rs, raws in read(batches):
            doc, m, th, at, n = pieces(raws, width)
            on = hits(table, m)
            if len(on):
                _, pick = np.unique(np.stack([m[on].view(np.int64), th[on]]), axis=1, return_index=True)
                on = on[pick]  # equal pieces of one task's share once
                texts = [raws[d][a : a + c + width - 1] for d, a, c in zip(doc[on].tolist(), at[on].tolist(), n[on].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(m[on].view(np.int64)), pa.array(th[on]), pa.array(texts, pa.binary())], ["m", "th", "text"])

    texts = docs.mapInArrow(text_rows, "m long, th long, text binary").groupBy("m", "th").agg(F.min("text").alias("text"))
    with small_batches(spark):
        with_text = materialize(texts.join(named.where("not single").select("m", "th", "first", "hot"), ["m", "th"]), "piece-contents")
    several = with_text.where("not hot").select("m", "th", "first", "text")
    _collected(spark)

    def index_rows(batches: Iterable[pa.RecordBatch]):
        def solve(rows: list[tuple]):
            owner = np.array([r[2] for r in rows], np.int64)
            runs = []
            for less in repeated_windows([r[3] for r in rows], owner, width):
                on = np.flatnonzero(np.diff(np.concatenate([[0], less.astype(np.int8), [0]])))
                runs.append([{"a": a, "b": b - 1} for a, b in on.reshape(-1, 2).tolist()])
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(runs, kind)], ["m", "th", "runs"])

        rows: list[tuple] = []
        total = 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if total > _INDEX_BYTES and r[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, total = [], 0
                rows.append(r)
                total += len(r[3])
        if rows:
            yield solve(rows)

    run_kind = "array<struct<a:long,b:long>>"
    marked = several.repartition("m").sortWithinPartitions("m").mapInArrow(index_rows, f"m long, th long, runs {run_kind}")
    wide = with_text.where("hot").select("m", "th", "first", "text", F.explode(F.sequence(F.lit(0), F.octet_length("text") - width)).alias("j"))
    wide = wide.select("m", "th", "first", "j", F.sha2(F.expr(f"substring(text, j + 1, {width})"), 256).alias("w"))
    least = wide.groupBy("w").agg(F.min("first").alias("least"))
    by_window = wide.join(least, "w").where("least < first").groupBy("m", "th").agg(F.array_sort(F.collect_list(F.struct(F.col("j").cast("long").alias("a"), F.col("j").cast("long").alias("b")))).alias("runs"))
    marks = materialize(marked.where(F.size("runs") > 0).unionByName(by_window), "marks")
    firsts = materialize(named.select("m", "th", "first", "places").join(marks, ["m", "th"], "left"), "firsts")
    discard(with_text, named, marks)
    _collected(spark)
    found = join_heavy(cand, firsts, ["m", "th"], "places", whole=False)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("n") - 1).cast("long").alias("b")))
    runs = F.when(F.col("k") > F.col("first"), whole).otherwise(F.col("runs"))
    spans = found.select("k", "r", "at", F.explode(runs).alias("x")).select("k", "r", F.struct((F.col("at") + F.col("x.a")).alias("a"), (F.col("at") + F.col("x.b")).alias("b")).alias("span"))
    out = materialize(spans.groupBy("k", "r").agg(F.array_sort(F.collect_list("span")).alias("spans")), "spans")
    discard(cand, firsts)
    _collected(spark)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """Remove the bytes of every ``width``-byte string that also starts in a document with a smaller id.

    Returns ``id_col, n_bytes, spans, kept`` for each row of ``docs``: removed byte runs (start, end)
    and the remaining bytes. Matches are judged on the input and do not cross documents.

    Copies of one text are joined first: all but the smallest id lose all windows. Names of windows
    are summed before they are shuffled, distinct pieces stand for all their places, and a name with
    more than ``hot_texts`` distinct texts, or more than a megabyte of them, is solved window by window without
    an index, so no group of any size is gathered in one task.

    Ids of any type that sorts; a null text is empty; rows with a null id lose nothing and hide nothing; rows that
    repeat an id do not hide each other, and each loses its own text's repeats; an empty table gives
    no rows; other columns are not read.
    """
    own = docs.select(docs[id_col].alias("id"), text_hash(docs[text_col]).alias("r"), docs[text_col].alias("t"))
    if dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint"):
        own = own.withColumn("k", F.col("id").cast("long"))
    else:  # numbers in the order of the ids
        ids = own.select(F.col("id").alias("of")).where("of is not null").distinct().repartitionByRange("of").sortWithinPartitions("of")
        ids = sent_if_small(materialize(ids.select("of", F.monotonically_increasing_id().alias("k")), "ids"))
        own = own.join(ids, own["id"] == ids["of"], "left").drop("of")
    real = own.where("k is not null and t is not null")
    hashes = materialize(real.select("k", "r", F.unhex(F.sha2("t", 256)).alias("x")), "hashes")
    reps = materialize(hashes.groupBy("x").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1"), "copies")
    later = materialize(join_heavy(hashes, reps, ["x"], "c").where("k > rep").select("k", "r", F.lit(True).alias("copy")).distinct(), "later-copies")
    few = sent_if_small(later)
    total = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    spans = repeated_spans(real.join(few, ["k", "r"], "left_anti").select("k", "r", "t"), total, width, hot_texts)
    marked = own.join(few, ["k", "r"], "left").join(spans, ["k", "r"], "left").select("id", "t", F.coalesce("copy", F.lit(False)).alias("copy"), "spans")
    kind = dict(docs.dtypes)[id_col]

    def cut(batches: Iterable[pa.RecordBatch]):
        for batch in slices(batches, "t"):
            size, gone, kept = [], [], []
            for t, copy, spans in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                runs: list[list[int]] = []
                whole = [{"a": 0, "b": len(raw) - width}] if copy and len(raw) >= width else []
                for s in whole or spans or []:
                    if runs and s["a"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s["b"] + width)
                    else:
                        runs.append([s["a"], s["b"] + width])
                size.append(len(raw))
                gone.append([{"start": a, "end": b} for a, b in runs])
                edges = [0, *(x for r in runs for x in r), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            run_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, run_kind), pa.array(kept, pa.binary())], [id_col, "n_bytes", "spans", "kept"])

    return marked.mapInArrow(cut, f"`{id_col}` {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
