"""Token-id files: ORC with integer run-length encoding, row indexes and Bloom filters on document ids."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches
from .tokenizing import encoder


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 64 << 20, index_rows: int = 10_000) -> None:
    """Tokenize every whole text and write ORC files in ascending ``id_col`` order.

    Files hold ``id_col, part, local_start, n_tokens, ids``: ``part`` numbers the file's place in
    the order, ``local_start`` counts the ids before the document within it. ORC run-length-encodes
    the integer columns, keeps min/max indexes every ``index_rows`` rows and Bloom filters on the
    ids of documents, so a lookup reads few stripes, and scans split by stripe.

    One shuffle, by ranges of the id (bounds from a sample of ids, rows spread evenly; ids are
    near-unique). A null text is empty (only ``end_id``); null ids come first; rows of one id are
    ordered by text, so a task that runs again writes the same file. An empty table writes no rows.
    Other columns of ``docs`` are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    own = docs.select(docs[id_col].alias("k"), docs[text_col].alias("t"))

    def run(batches: Iterable[pa.RecordBatch]):
        part, start, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in slices(batches, "t", 1 << 20):
            raw = enc.encode(batch.column(1).to_pylist(), end_id)
            sizes = np.array([len(x) // 4 for x in raw], np.int64)
            ends = np.cumsum(sizes)
            # ids stay below 2^31 in any vocabulary, so signed 32-bit columns hold them
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(raw), part, np.int32)), pa.array(start + ends - sizes), pa.array(sizes), ids],
                [id_col, "part", "local_start", "n_tokens", "ids"],
            )
            start += int(ends[-1])

    with small_batches(docs.sparkSession):
        (
            own.repartitionByRange("k")
            .sortWithinPartitions("k", "t")
            .mapInArrow(run, f"`{id_col}` {kind}, part int, local_start long, n_tokens long, ids array<int>")
            .write.option("compression", "lz4")  # run-length-encoded ids hardly shrink further
            .option("orc.bloom.filter.columns", id_col)
            .option("orc.bloom.filter.fpp", "0.01")
            .option("orc.create.index", "true")
            .option("orc.row.index.stride", str(index_rows))
            .option("orc.stripe.size", str(stripe_bytes))
            .orc(path)
        )


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Read the files back: ``id_col, start, n_tokens, ids``; ``start`` counts the ids of all documents before.

    The starts of the parts come from their totals: one row a file is summed, without the ids.
    """
    files = spark.read.orc(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.min(id_col).alias("first")).collect()
    rows, start = [], 0
    for r in sorted(totals, key=lambda r: r["part"]):
        rows.append((r["part"], start))
        start += r["n"]
    bases = spark.createDataFrame(rows, "part int, base long")
    bases = F.broadcast(bases) if len(rows) <= 200_000 else bases  # a row a file; the ids then stay where they are read
    return files.join(bases, "part").select(id_col, (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, ids: list[int], id_col: str = "doc_id") -> DataFrame:
    """Token ids of a few documents: the filter reaches the ORC reader, which skips stripes by index and Bloom filter."""
    return spark.read.orc(path).where(F.col(id_col).isin(ids)).select(id_col, "n_tokens", "ids")


def with_crc32(tokens: DataFrame, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """``keep`` columns and ``ids_crc32``, the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    import zlib

    kinds = dict(tokens.dtypes)

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            lists = batch.column(len(keep))
            ends = lists.offsets.to_numpy().tolist()
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            raw = memoryview(values).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(crc, pa.int64())], [*keep, "ids_crc32"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", ids_crc32 long"
    return tokens.select(*keep, ids_col).mapInArrow(run, schema)
