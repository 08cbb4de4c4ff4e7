"""Near-duplicates: ProbMinHash sketches of word shingles, banding, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_small, join_heavy, materialize, slices, small_batches, text_hash, without_rows, words_of

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Parity bits of a shingle set.
_PARITY = 1024
#: Pairs of one text that are compared together; a text in more pairs is sent to several tasks.
_PAIRS_TOGETHER = 1000
#: Members of a bucket that one task compares with all others of the bucket.
_BLOCK = 1000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """For each text the hashes of its ``width``-word shingles, in order; a shorter text is one shingle, a word-less one has none."""
    import xxhash

    split = [words_of(t) for t in texts]
    number = {w: xxhash.xxh3_64_intdigest(w) for w in set().union(*split)} if split else {}
    out = []
    for words in split:
        h = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
        n = len(h) - width + 1
        if n < 1:
            h, n = np.pad(h, (0, width - len(h))) if len(h) else h, min(1, len(h))
        total = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(width if n else 0):
                total = mix(total + _ODD) + h[j : j + n]
        out.append(mix(total))
    return out


def occurrences(s: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles, their weights, elements compared): sets weigh each shingle one; multisets compare the j-th occurrence of a shingle with the j-th."""
    e, c = np.unique(s, return_counts=True)
    if not weighted:
        return e, np.ones(len(e)), e
    nth = np.arange(len(s)) - np.repeat(np.cumsum(c) - c, c)
    with np.errstate(over="ignore"):
        return e, c.astype(np.float64), np.sort(mix(np.repeat(e, c) + mix(nth.astype(np.uint64))))


def prob_minhash(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """ProbMinHash signatures (n_docs, k) of weighted sets; equal registers estimate the probability Jaccard.

    Each element is a Poisson process with its weight as rate: its points arrive at exponential
    distances, each at a random register, which keeps its earliest point. A process ends as soon as
    its next point comes after all registers of its set are taken by earlier ones, so most elements
    make a single point. Points depend on the element alone, so sets agree without coordination.
    """
    with np.errstate(over="ignore"):
        times = np.full(n_docs * k, np.inf)
        at, e, d, w, state = np.zeros(len(elements)), elements, doc, weights, mix(elements + _ODD)
        points = []
        while len(e):
            state = mix(state + _ODD)
            at = at - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
            slot = d * k + (mix(state ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(k)).astype(np.int64)
            better = at < times[slot]
            np.minimum.at(times, slot[better], at[better])
            points.append((slot[better], at[better], e[better]))
            on = at < times.reshape(n_docs, k).max(1)[d]
            at, e, d, w, state = at[on], e[on], d[on], w[on], state[on]
        out = np.zeros(n_docs * k, np.uint64)
        for slot, when, who in points:
            first = when == times[slot]
            out[slot[first]] = who[first]
    return out.reshape(n_docs, k)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, bands: int = 24, rows: int = 4, weighted: bool = False) -> DataFrame:
    """``id_col, n, f1, f2, bands, parity``: distinct shingles, a 128-bit fingerprint of the shingle set, band hashes, parity bits.

    A band's hash includes the band's number. Each distinct shingle flips one of 1024 parity bits, so
    two sets differ in at least as many shingles as their parity bits do.

    ``weighted``: shingles weigh as often as they occur, and everything but the signature is of the multiset; else
    each weighs one, and the probability Jaccard is the Jaccard similarity of the sets. A null or word-less
    text has n = 0; null and repeated ids pass through.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in slices(batches, "t", 1 << 20):
            each = [occurrences(s, weighted) for s in shingles(batch.column(1).to_pylist(), width)]
            distinct = np.array([len(x) for x, _, _ in each], np.int64)
            n = np.array([len(x) for _, _, x in each], np.int64)
            sig = prob_minhash(np.concatenate([x for x, _, _ in each]), np.concatenate([x for _, x, _ in each]), np.repeat(np.arange(len(n)), distinct), len(n), bands * rows).reshape(len(n), bands, rows)
            e, doc = np.concatenate([x for _, _, x in each]), np.repeat(np.arange(len(n)), n)
            with np.errstate(over="ignore"):
                band = np.arange(bands, dtype=np.uint64)[None, :] * _ODD
                for j in range(rows):
                    band = mix(band + _ODD) + sig[:, :, j]
                band = mix(band)
                ends = np.concatenate([[0], np.cumsum(n)])
                total = lambda x: np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])[ends])
                f1, f2 = total(mix(e ^ _ODD)), total(mix(e + np.uint64(99)))
                flips = doc * _PARITY + (mix(e + np.uint64(7)) % np.uint64(_PARITY)).astype(np.int64)
            parity = np.packbits((np.bincount(flips, minlength=len(n) * _PARITY) & 1).astype(np.uint8)).view(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * each), pa.array(x)) for each, x in ((bands, band.ravel().view(np.int64)), (_PARITY // 64, parity))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), *lists], [id_col, "n", "f1", "f2", "bands", "parity"])

    own = docs.select(docs[id_col].alias("k"), docs[text_col].alias("t"))
    return own.mapInArrow(run, f"`{id_col}` {kind}, n long, f1 long, f2 long, bands array<long>, parity array<long>")


def shingle_sets(docs: DataFrame, width: int = 5, weighted: bool = False) -> DataFrame:
    """``k, s``: the distinct shingle hashes of documents ``k, t``, or the hashes of all their occurrences."""
    kind = dict(docs.dtypes)["k"]

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in slices(batches, "t", 1 << 20):
            each = [occurrences(s, weighted)[2].view(np.int64) for s in shingles(batch.column(1).to_pylist(), width)]
            ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each)))], ["k", "s"])

    return docs.select("k", "t").mapInArrow(run, f"k {kind}, s array<long>")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``a, b``: ``k, label`` with the smallest vertex as label, for vertices with edges.

    Alternating large-star and small-star steps; each step's edges are written to the shared folder,
    and only a count and a checksum come to the driver. An edge from a vertex to itself is none; no edges, no rows.
    """

    def checksum(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = checksum(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = materialize(small.where("a <> b").distinct(), "edges")
        after = checksum(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("k"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("k"), F.col("b").alias("label")).distinct())


def attach_sets(pairs: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """Add ``s<side>``, the shingle set of the text named in column ``side``.

    No pair is lost: every text of ``pairs`` is in ``sets``. A text in many pairs is copied once for each ``_PAIRS_TOGETHER`` of them, so its pairs spread over tasks.
    """
    other = "b" if side == "a" else "a"
    fan = pairs.groupBy(side).agg(F.ceil(F.count(F.lit(1)) / _PAIRS_TOGETHER).cast("int").alias("fan"))
    copies = sets.join(fan, sets["k"] == fan[side]).select(side, F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"), F.col("s").alias(f"s{side}"))
    return pairs.join(fan, side).withColumn("salt", F.pmod(F.xxhash64(other), "fan").cast("int")).join(copies, [side, "salt"]).drop("salt", "fan")


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: tuple[int, int], bands: int, rows: int, weighted: bool) -> DataFrame:
    """``k, r, vertex, class`` of each row: its text's vertex and the smallest vertex linked to it; null where nothing is compared."""
    own = docs.select(docs[id_col].alias("k"), text_hash(docs[text_col]).alias("r"), docs[text_col].alias("t"))
    sketched = sketches(own.select(F.struct("k", "r").alias("row"), "t"), "row", "t", width, bands, rows, weighted)
    with small_batches(own.sparkSession):
        rows_of = materialize(sketched.select("row.k", "row.r", "n", "f1", "f2", "bands", "parity"), "sketches")
    real = rows_of.where("n > 0 and k is not null")
    first = F.min(F.struct("k", "r", "n", "bands", "parity")).alias("first")
    vertices = materialize(real.groupBy("f1", "f2").agg(first).select("f1", "f2", "first.*"), "vertices")
    # a vertex is named by its smallest id; where one id has several texts, by id and text
    plain = vertices.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()
    vertices = vertices.withColumn("v", F.col("k") if plain else F.struct("k", "r"))
    slots = vertices.select("v", F.explode("bands").alias("h"))
    shared = materialize(slots.groupBy("h").agg(F.min("v").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1"), "hubs")
    crowded = materialize(join_heavy(slots, shared, ["h"], "size"), "buckets")
    one, many = threshold

    def shape(side: str) -> DataFrame:
        return vertices.select(F.col("v").alias(side), F.col("n").alias(f"n{side}"), F.col("parity").alias(f"p{side}"))

    def may_link(na: str, nb: str, pa_: str, pb: str):
        """No text pair of the threshold's similarity fails this."""
        differing = sum((F.bit_count(F.col(pa_)[i].bitwiseXOR(F.col(pb)[i])) for i in range(1, _PARITY // 64)), F.bit_count(F.col(pa_)[0].bitwiseXOR(F.col(pb)[0])))
        return (F.least(na, nb) * many >= F.greatest(na, nb) * one) & (differing * (many + one) <= (F.col(na) + F.col(nb)) * (many - one))

    def verified(pairs: DataFrame, tag: str) -> DataFrame:
        """Of ``a, b`` those whose sets are similar enough."""
        pairs = materialize(pairs.select("a", "b").distinct(), f"{tag}-pairs")
        named = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct()
        named = materialize(named.join(vertices.select("v", F.col("k").alias("nk"), F.col("r").alias("nr")), "v"), f"{tag}-texts")
        named = F.broadcast(named) if is_small(named) else named
        texts = own.join(named, (own["k"] == named["nk"]) & (own["r"] == named["nr"])).select(F.col("v").alias("k"), "t")
        with small_batches(own.sparkSession):
            sets = materialize(shingle_sets(texts, width, weighted), f"{tag}-sets")
        sets = sets.dropDuplicates(["k"])  # rows that repeat an id and its text
        both = attach_sets(attach_sets(pairs, sets, "a"), sets, "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return materialize(both.where(common * many >= (F.size("sa") + F.size("sb") - common) * one).select("a", "b"), f"{tag}-links")

    stars = crowded.where("v <> hub").select(F.col("hub").alias("a"), F.col("v").alias("b")).distinct()
    links = verified(stars.join(shape("b"), "b").join(shape("a"), "a").where(may_link("na", "nb", "pa", "pb")), "star")
    labels = materialize(components(links), "labels")
    placed = crowded.select("h", "v").join(labels.withColumnRenamed("k", "v"), "v", "left").select("h", "v", F.coalesce("label", "v").alias("label"))
    placed = materialize(placed, "placed")
    ends = placed.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("size")).where("x < y")
    mixed = materialize(ends.select("h", "size", F.ceil(F.col("size") / _BLOCK).cast("int").alias("fan")), "mixed")
    rest = join_heavy(placed, mixed, ["h"], "size").join(vertices.select("v", "n", "parity"), "v")
    rest = materialize(rest.select("h", "v", "label", "n", "parity", "fan", F.pmod(F.xxhash64("v"), "fan").cast("int").alias("block")), "rest")
    # a large bucket's members meet block by block, in tasks of their own
    a = rest.select("h", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("block"), *[F.col(c).alias(f"{c}a") for c in ("v", "label", "n", "parity")])
    b = rest.select("h", "block", *[F.col(c).alias(f"{c}b") for c in ("v", "label", "n", "parity")])
    pairs = a.join(b, ["h", "block"]).where((F.col("labela") < F.col("labelb")) & may_link("na", "nb", "paritya", "parityb"))
    more = verified(pairs.select(F.least("va", "vb").alias("a"), F.greatest("va", "vb").alias("b")), "rest")
    labels = components(links.unionByName(more))
    classes = vertices.select("f1", "f2", "v").join(labels, F.col("v") == F.col("k"), "left").select("f1", "f2", "v", F.coalesce("label", "v").alias("class"))
    sizes = real.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("size"))
    classes = materialize(classes.join(sizes, ["f1", "f2"]), "classes")
    named = join_heavy(real.select("k", "r", "f1", "f2"), classes, ["f1", "f2"], "size")
    out = named.select("k", "r", F.col("v").alias("vertex"), "class") if plain else named.select("k", "r", F.col("v.k").alias("vertex"), F.col("class.k").alias("class"), (F.col("v") != F.col("class")).alias("other"))
    none = F.lit(None).cast(dict(own.dtypes)["k"])
    alone = rows_of.where("not (n > 0 and k is not null)").select("k", "r", none.alias("vertex"), none.alias("class"))
    out = out if not plain else out.withColumn("other", F.col("vertex") != F.col("class"))
    return out.unionByName(alone.withColumn("other", F.lit(False)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: tuple[int, int] = (4, 5), bands: int = 24, rows: int = 4, weighted: bool = False) -> DataFrame:
    """A row per row of ``docs``: ``id_col, class_id``, the smallest id among texts linked by near-duplicates.

    Two texts are linked where the Jaccard similarity of their shingle sets is at least the
    ``threshold`` fraction; links come from 24 bands of 4 registers (a pair at 0.8 is missed with
    probability below 1e-5) and every link is verified on whole shingle sets. With ``weighted`` shingles
    weigh as often as they occur, in the signatures (whose probability Jaccard is at least the weighted
    Jaccard similarity) and in the similarity, the share of occurrences in common.

    Texts with equal shingle sets are one vertex. A bucket links its members to its smallest; once
    these links are verified and joined into components, only pairs of different components in a
    bucket can still change anything, and all of those are compared too, a large bucket block by block in
    many tasks. A pair's sets are fetched only if sizes and parity bits leave room for the threshold, which
    loses no link: a similarity of p/q or more needs a symmetric difference of at most (q - p) / (q + p) of
    the two sizes, and the parity bits that differ bound that difference from below.

    Rows with a null id are not compared (class null); a text without words is a class of its own;
    texts under one id are compared like any others, so such an id may have a class for each text; an empty
    table gives no rows; other columns are not read.
    """
    found = _classes(docs, id_col, text_col, width, threshold, bands, rows, weighted)
    return found.select(F.col("k").alias(id_col), F.coalesce("class", "k").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is the first of its class, by id, all columns.

    A row goes if a near-duplicate of its text, or of one linked to it, has a smaller id; other texts
    under its id are not touched, and of near-duplicates under one id one stays. Rows with a null id and
    word-less texts stay; an empty table gives no rows.
    """
    found = _classes(docs, id_col, text_col, 5, (4, 5), 24, 4, False)
    return without_rows(docs, found.where(F.col("other") | (F.col("k") != F.col("class"))).select("k", "r"), id_col, text_col)
