"""Bloom filters over lane tables: one 128-bit hash a key gives k positions; union is a lane OR."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import BLOOM_SEED, metro128, projection_mul_64, wrapping
from .bitmap import Bitmap


def optimal_m(n: float, p: float) -> float:
    """Bits for ``n`` keys at false-positive rate ``p``."""
    return -n * math.log(p) / math.log(2) ** 2


def optimal_k(n: int, m: int) -> int:
    """Hash functions for ``n`` keys in ``m`` bits; bits a key are a whole number, as both arguments are."""
    return int((m // n) * math.log(2))


def bit_positions(df: DataFrame, key: str, size: int, k: int, out: str = "bit") -> DataFrame:
    """A row per usable key and hash function, the hash computed once a key."""
    hashed = metro128(df, key, BLOOM_SEED, "_h", "_l")
    with wrapping(df.sparkSession):
        each = hashed.withColumn("_i", F.explode(F.array(*[F.lit(i).cast("long") for i in range(k)]))).withColumn("_x", F.expr("_h + _i * _l"))
        return each.withColumn(out, F.expr(projection_mul_64("_x", size))).drop("_h", "_l", "_i", "_x")


class BloomFilter:
    """Membership sketch for each group ``by``: no false negatives; null and empty keys are ignored."""

    def __init__(self, bits: Bitmap, k: int):
        if not 0 < k < 1 << 16:
            raise ValueError("k must be in 1..65535")
        self.bits, self.k = bits, k

    @classmethod
    def from_iterable(cls, df: DataFrame, key: str, size: int, k: int, by: list[str] | None = None) -> BloomFilter:
        if not 0 < k < 1 << 16:
            raise ValueError("k must be in 1..65535")
        effective = -(-size // 512) * 512 if size > 0 else 0
        slim = df.select(*(by or []), F.col(key).alias("_k"))
        bits = Bitmap.from_positions(bit_positions(slim, "_k", effective, k), "bit", size, by)
        if by:
            bits.ids = df.select(*by).distinct()
        return cls(bits, k)

    build = from_iterable

    @property
    def size(self) -> int:
        return self.bits.size

    @property
    def by(self) -> list[str]:
        return self.bits.by

    def set(self, df: DataFrame, key: str) -> BloomFilter:
        return self | BloomFilter.from_iterable(df, key, self.bits.requested, self.k, self.by)

    def copy(self) -> BloomFilter:
        return BloomFilter(self.bits.copy(), self.k)

    clone = copy

    def packed(self) -> DataFrame:
        """One row a group with its lanes as a map; for filters of a few thousand lanes."""
        return self.bits.lanes.groupBy(*self.by).agg(F.map_from_entries(F.collect_list(F.struct("lane", "bits"))).alias("lanes"))

    def test(self, df: DataFrame, key: str, out: str = "found") -> DataFrame:
        """Add a boolean column; distinct keys are probed, then joined back, so repeated keys hash once."""
        keys = df.select(*self.by, key).distinct()
        probes = bit_positions(keys, key, self.size, self.k).withColumn("lane", F.shiftright("bit", 5))
        hit = probes.join(self.bits.lanes, [*self.by, "lane"], "left")
        bit = F.coalesce(F.expr("(shiftrightunsigned(bits, cast(bit & 31 as int)) & 1L) = 1L"), F.lit(False))
        found = hit.groupBy(*self.by, key).agg(F.every(bit).alias(out))
        found = found.select(*[F.col(c).alias(f"_p_{c}") for c in (*self.by, key)], F.col(out).alias("_p_found"))
        cond = [F.col(c) == F.col(f"_p_{c}") for c in (*self.by, key)]
        return df.join(found, cond, "left").select(*df.columns, F.coalesce("_p_found", F.lit(False)).alias(out))

    def semi_join(self, df: DataFrame, key: str) -> DataFrame:
        """Approximate semi-join: rows whose key may be in the set."""
        return self.test(df, key, "_found").where("_found").drop("_found")

    def anti_join(self, df: DataFrame, key: str) -> DataFrame:
        """Rows whose key is certainly not in the set."""
        return self.test(df, key, "_found").where("not _found").drop("_found")

    def count(self) -> DataFrame:
        """Set bits, density, empty and full of each group."""
        return self.bits.count()

    def zero(self) -> BloomFilter:
        return BloomFilter(self.bits.zero(), self.k)

    def fill(self) -> BloomFilter:
        return BloomFilter(self.bits.fill(), self.k)

    def __neg__(self) -> BloomFilter:
        return BloomFilter(-self.bits, self.k)

    __invert__ = __neg__

    def _same(self, other: BloomFilter) -> None:
        if self.k != other.k:
            raise ValueError("filters differ in k")

    def __or__(self, other: BloomFilter) -> BloomFilter:
        self._same(other)
        return BloomFilter(self.bits | other.bits, self.k)

    def __and__(self, other: BloomFilter) -> BloomFilter:
        self._same(other)
        return BloomFilter(self.bits & other.bits, self.k)

    def __xor__(self, other: BloomFilter) -> BloomFilter:
        self._same(other)
        return BloomFilter(self.bits ^ other.bits, self.k)

    def equal(self, other: BloomFilter) -> DataFrame:
        out = self.bits.equal(other.bits)
        return out if self.k == other.k else out.withColumn("equal", F.lit(False))


def unique(df: DataFrame, key: str, seq: str, size: int, k: int, window: Column | None = None) -> DataFrame:
    """Approximate distinct rows in ``seq`` order, as inserting each key after testing it would give.

    A row passes if one of its bits is not set by any earlier row, that is, if it is the first of
    some bit: a suppressed row sets no new bit, so the bit's first row over all rows decides.
    ``window`` (an event-time window or any expression) starts the filter anew for each value.
    """
    effective = -(-size // 512) * 512
    at = window if window is not None else F.lit(0)
    slim = df.select(at.alias("_w"), F.col(key).alias("_k"), F.col(seq).alias("_s"))
    firsts = bit_positions(slim, "_k", effective, k).groupBy("_w", "bit").agg(F.min("_s").alias("_s"))
    passed = firsts.select("_w", "_s").distinct()
    return df.withColumn("_at", at).join(passed, F.col("_at").eqNullSafe(F.col("_w")) & (F.col(seq) == F.col("_s")), "left_semi").drop("_at")
