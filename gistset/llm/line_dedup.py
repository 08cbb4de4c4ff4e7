"""Line deduplication: hashes in range partitions, first occurrences, compressed keep bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, text_hash

_LANE = 32


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Which lines of which documents go: ``id_col, text_hash, n_dropped, lanes`` for documents that lose any.

    ``lanes`` is the keep bitmap, compressed: (lane, bits) of 32 lines each, bit set = line stays,
    only lanes that lose a line are present. A key is a line without white space at its ends, A-Z
    lower-cased; keys of at least ``min_chars`` code points in two or more documents stay in the
    smallest id that holds them only (there all their lines stay).

    Keys travel as 128-bit hashes in ranges of (hash, id, position): a key of any frequency is spread over as
    many ranges as it fills. Each range is sorted so and streamed once; a key's first row there is its
    first occurrence within the range. Only a range's first and last key can lie in other ranges too:
    these, two rows a range, are put together and sent to all.
    Rows with a null id keep all lines and hide none; rows of one id are one document; a null text
    is one empty line; empty tables give no rows; other columns are not read.
    """
    own = docs.where(docs[id_col].isNotNull()).select(docs[id_col].alias("k"), text_hash(docs[text_col]).alias("r"), _lines(docs[text_col]).alias("lines"))
    key = ascii_lower(F.btrim("line", F.lit(" \t\n\x0b\x0c\r")))
    lines = own.select("k", "r", F.posexplode("lines").alias("pos", "line")).select("k", "r", "pos", key.alias("key")).where(F.char_length("key") >= min_chars)
    hashed = materialize(lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "k", "pos", "r"), "line-keys")
    ranged = hashed.repartitionByRange("h1", "h2", "k", "pos").withColumn("range", F.spark_partition_id())
    stream = Window.partitionBy("range", "h1", "h2").orderBy("k", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = materialize(ranged.repartition("range").withColumn("first", F.first("k").over(stream)), "lines")
    head = F.struct("h1", "h2", "first")
    edges = ranged.groupBy("range").agg(F.array(F.min(head), F.max(head)).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    edges = F.broadcast(materialize(edges.groupBy("h1", "h2").agg(F.min("first").alias("before")), "edges"))  # two rows a range at most
    drops = ranged.join(edges, ["h1", "h2"], "left").where(F.col("k") > F.least("first", "before"))
    drops = drops.select("k", "r", (F.col("pos") / _LANE).cast("int").alias("lane"), F.expr(f"shiftleft(1L, pos % {_LANE})").alias("bit"))
    lanes = drops.groupBy("k", "r", "lane").agg(F.bit_or("bit").alias("gone"))
    full = (1 << _LANE) - 1
    per_doc = lanes.groupBy("k", "r").agg(
        F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("lane", (F.lit(full) - F.col("gone")).alias("bits")))).alias("lanes"),
    )
    return per_doc.select(F.col("k").alias(id_col), F.col("r").alias("text_hash"), "n_dropped", "lanes")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_lines, n_dropped, kept_text`` of every row of ``docs``, in time that grows with the lines.

    A row without a bitmap, one with a null id among them, keeps its lines; a null text is one empty line.
    """
    own = docs.select(docs[id_col].alias("k"), text_hash(docs[text_col]).alias("r"), docs[text_col].alias("t"))
    maps = bitmaps.select(F.col(id_col).alias("bk"), F.col("text_hash").alias("br"), "n_dropped", "lanes")
    both = own.join(maps, (own["k"] == maps["bk"]) & (own["r"] == maps["br"]), "left")
    full = (1 << _LANE) - 1
    # lanes that lose nothing are filled in, so that a line's number finds its bits; as the element of an array it is made once
    dense = f"flatten(transform(lanes, (x, i) -> concat(array_repeat({full}L, x.lane - coalesce(get(lanes, i - 1).lane, -1) - 1), array(x.bits))))"
    stays = f"(shiftright(coalesce(get(d, cast(i div {_LANE} as int)), {full}L), cast(i % {_LANE} as int)) & 1L) = 1L"
    kept = F.expr(f"transform(array({dense}), d -> array_join(filter(split(coalesce(t, ''), '\n'), (x, i) -> {stays}), '\n'))[0]")
    text = F.when(F.col("n_dropped") > 0, kept).otherwise(F.coalesce("t", F.lit("")))
    return both.select(F.col("k").alias(id_col), F.size(_lines(F.col("t"))).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), text.alias("kept_text"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Bitmaps applied: see ``keep_bitmaps`` and ``apply_bitmaps``."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, min_chars), id_col, text_col)
