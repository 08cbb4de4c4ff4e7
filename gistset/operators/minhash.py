"""MinHash signatures as register arrays: position i keeps the largest of (a + i*b) mod 2^32."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import MINHASH_SEED, metro64

U32 = (1 << 32) - 1


class MinHash:
    """``by, registers ARRAY<BIGINT>`` of ``n`` registers for each group."""

    def __init__(self, table: DataFrame, n: int, by: list[str]):
        if n <= 0:
            raise ValueError("n must be positive")
        self.table, self.n, self.by = table, n, list(by)

    @classmethod
    def from_iterable(cls, df: DataFrame, key: str, n: int, by: list[str] | None = None) -> MinHash:
        """Partial signatures are made batch by batch in each task and merged by an element-wise maximum.

        Groups without a usable key have all registers zero.
        """
        if n <= 0:
            raise ValueError("n must be positive")
        own_by = list(by or [])
        kinds = dict(df.dtypes)
        hashed = metro64(df.select(*own_by, F.col(key).alias("_k")), "_k", MINHASH_SEED, "_x").select(*own_by, "_x")
        schema = "".join(f"`{c}` {kinds[c]}, " for c in own_by) + "i int, v long"
        step = np.arange(n, dtype=np.uint64)

        def run(batches: Iterable[pa.RecordBatch]):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(len(own_by)).to_numpy().view(np.uint64)
                a, b = x & np.uint64(U32), x >> np.uint64(32)
                keys = pa.table(batch.columns[: len(own_by)], own_by) if own_by else None
                code = np.zeros(len(x), np.int64)
                for c in own_by:
                    code = code * (len(x) + 1) + keys.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                    code = np.unique(code, return_inverse=True)[1]
                order = np.argsort(code, kind="stable")
                starts = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0]))
                for lo in range(0, n, 64):
                    reg = (a[order, None] + step[None, lo : lo + 64] * b[order, None]) & np.uint64(U32)
                    top = np.maximum.reduceat(reg, starts, axis=0).astype(np.int64)
                    width = top.shape[1]
                    rows = np.repeat(order[starts], width)
                    cols = [batch.column(j).take(pa.array(rows)) for j in range(len(own_by))]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(np.tile(np.arange(lo, lo + width, dtype=np.int32), len(starts))), pa.array(top.ravel())], [*own_by, "i", "v"])

        top = hashed.mapInArrow(run, schema).groupBy(*own_by, "i").agg(F.max("v").alias("v"))
        packed = top.groupBy(*own_by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("registers"))
        empty = F.array_repeat(F.lit(0).cast("long"), n)
        if own_by:
            packed = df.select(*own_by).distinct().join(packed, own_by, "left").select(*own_by, F.coalesce("registers", empty).alias("registers"))
        else:
            packed = df.sparkSession.range(1).join(packed, F.lit(True), "left").select(F.coalesce("registers", empty).alias("registers"))
        return cls(packed, n, own_by)

    build = from_iterable

    def add(self, df: DataFrame, key: str) -> MinHash:
        return self | MinHash.from_iterable(df, key, self.n, self.by)

    def copy(self) -> MinHash:
        return MinHash(self.table, self.n, self.by)

    clone = copy

    def __or__(self, other: MinHash) -> MinHash:
        """Sketch of the union: element-wise maximum."""
        if self.n != other.n or self.by != other.by:
            raise ValueError("sketches differ in registers or groups")
        return MinHash(merged(self.table.unionByName(other.table), self.by), self.n, self.by)

    merge = __or__

    def rollup(self, by: list[str]) -> MinHash:
        return MinHash(merged(self.table, by), self.n, by)

    def estimate(self, pairs: DataFrame, left: str, right: str, out: str = "jaccard") -> DataFrame:
        """Add the similarity of the groups that columns ``left`` and ``right`` name (one ``by`` column)."""
        (by,) = self.by
        a = self.table.select(F.col(by).alias(left), F.col("registers").alias("_a"))
        b = self.table.select(F.col(by).alias(right), F.col("registers").alias("_b"))
        equal = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
        both = pairs.join(a, left).join(b, right)
        return both.withColumn(out, (equal.cast("float") / F.lit(float(self.n)).cast("float")).cast("float")).drop("_a", "_b")

    def equal(self, other: MinHash) -> DataFrame:
        o = other.table.withColumnRenamed("registers", "_o")
        both = self.table.join(o, self.by, "full") if self.by else self.table.crossJoin(o)  # a row each
        return both.select(*self.by, F.coalesce(F.col("registers") == F.col("_o"), F.lit(False)).alias("equal"))

    def candidate_pairs(self, rows: int) -> DataFrame:
        """Pairs of groups that agree in a band of ``rows`` registers, as (a, b) with a < b, linked through each bucket's smallest member."""
        (by,) = self.by
        bands = self.table.select(F.col(by).alias("b"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(self.n // rows - 1)), lambda j: F.xxhash64(F.slice("registers", j * rows + 1, rows)))).alias("band", "h"))
        least = bands.groupBy("band", "h").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1")
        return bands.join(least, ["band", "h"]).where("a < b").select("a", "b").distinct()


def merged(table: DataFrame, by: list[str]) -> DataFrame:
    each = table.select(*by, F.posexplode("registers").alias("i", "v")).groupBy(*by, "i").agg(F.max("v").alias("v"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("registers"))
