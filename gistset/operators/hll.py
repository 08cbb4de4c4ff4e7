"""HyperLogLog as register tables: (by..., reg, rho), zero registers omitted; merging is a maximum."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import HLL_SEED, metro128

# Estimates up to which linear counting is used, for precisions 4 to 18 (fixed values).
THRESHOLDS = (10, 20, 40, 80, 220, 400, 900, 1800, 3100, 6500, 11500, 20000, 50000, 120000, 350000)
MIN_PRECISION, MAX_PRECISION = 6, 18


def error_for_registers(m: int) -> float:
    return 1.04 / math.sqrt(m)


def registers_for_error(e: float) -> float:
    return 1.0816 / e**2


def alpha(precision: int) -> float:
    m = 1 << precision
    return 0.709 if m == 64 else 0.7213 / (1 + 1.079 / m)


def raw_expected(n: float, precision: int) -> float:
    """Raw estimate to expect of ``n`` distinct keys: registers fill as Poisson counts of n/m keys each."""
    m = 1 << precision
    load, mean, k = n / m, math.exp(-n / m), 1
    while k <= 64:
        mean += 2.0**-k * (math.exp(-load / 2.0**k) - math.exp(-load / 2.0 ** (k - 1)))
        k += 1
    return alpha(precision) * m / mean


@lru_cache
def bias_table(precision: int, points: int = 200) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """(raw estimates, their bias) at evenly spaced counts up to raw estimates of 5m, from ``raw_expected``."""
    m = 1 << precision
    at = [5.2 * m * i / (points - 1) for i in range(points)]
    raw = [raw_expected(n, precision) for n in at]
    return tuple(raw), tuple(r - n for r, n in zip(raw, at, strict=True))


def estimate(zeros: Column, inverse_sum: Column, precision: int, mode: str = "corrected", table: tuple | None = None) -> Column:
    """Distinct count from the number of zero registers and the sum of 2^-rho (rounded to single precision).

    Up to 5m the raw estimate is corrected by a bias looked up in ``table`` (raw estimates, biases);
    up to the precision's threshold linear counting wins if any register is zero. "corrected" takes
    the mean of the neighbouring biases; "compat" half their difference, which corrects next to
    nothing and is kept for parity only. Give published measurements as ``table`` to reproduce
    estimates that were made with them.
    """
    if not MIN_PRECISION <= precision <= MAX_PRECISION:
        raise ValueError("precision must be in 6..18")
    if mode not in ("corrected", "compat"):
        raise ValueError("mode must be corrected or compat")
    m = 1 << precision
    raws, biases = table or bias_table(precision)
    raw = F.lit(alpha(precision) * m * m) / inverse_sum.cast("float").cast("double")
    between = [biases[0]] + [(b + a) / 2 if mode == "corrected" else (b - a) / 2 for a, b in zip(biases, biases[1:], strict=False)] + [biases[-1]]
    below = F.size(F.filter(F.array(*map(F.lit, raws)), lambda x: x < raw))
    bias = F.element_at(F.array(*map(F.lit, between)), below + 1)
    corrected = raw - F.when(raw <= 5 * m, bias).otherwise(0.0)
    linear = F.when(zeros > 0, m * F.log(F.lit(float(m)) / zeros)).otherwise(corrected)
    return F.when(linear <= THRESHOLDS[precision - 4], linear).otherwise(corrected)


def registers(df: DataFrame, key: str, precision: int, out: tuple[str, str] = ("reg", "rho")) -> DataFrame:
    """Rows with usable keys, their register and rank: leading zeros of the hash plus one (65 for a zero hash)."""
    hashed = metro128(df, key, HLL_SEED, "_h", "_l")
    rho = F.when(F.col("_h") == 0, 65).otherwise(65 - F.length(F.bin("_h")))
    return hashed.withColumns({out[0]: F.shiftrightunsigned("_l", 64 - precision).cast("int"), out[1]: rho.cast("int")}).drop("_h", "_l")


class HyperLogLog:
    def __init__(self, table: DataFrame, precision: int, by: list[str] | None = None, ids: DataFrame | None = None):
        if not MIN_PRECISION <= precision <= MAX_PRECISION:
            raise ValueError("precision must be in 6..18")
        self.registers, self.precision, self.by = table, precision, list(by or [])
        self.ids = ids if ids is not None else table.select(*self.by).distinct() if self.by else None

    @classmethod
    def from_iterable(cls, df: DataFrame, key: str, precision: int, by: list[str] | None = None) -> HyperLogLog:
        if not MIN_PRECISION <= precision <= MAX_PRECISION:
            raise ValueError("precision must be in 6..18")
        by = list(by or [])
        own = registers(df.select(*by, F.col(key).alias("_k")), "_k", precision)
        return cls(own.groupBy(*by, "reg").agg(F.max("rho").alias("rho")), precision, by, df.select(*by).distinct() if by else None)

    build = from_iterable

    def add(self, df: DataFrame, key: str) -> HyperLogLog:
        return self | HyperLogLog.from_iterable(df, key, self.precision, self.by)

    def copy(self) -> HyperLogLog:
        return HyperLogLog(self.registers, self.precision, self.by, self.ids)

    clone = copy

    def __or__(self, other: HyperLogLog) -> HyperLogLog:
        if self.precision != other.precision or self.by != other.by:
            raise ValueError("sketches differ in precision or groups")
        both = self.registers.unionByName(other.registers).groupBy(*self.by, "reg").agg(F.max("rho").alias("rho"))
        return HyperLogLog(both, self.precision, self.by, self.ids.unionByName(other.ids).distinct() if self.by else None)

    merge = __or__

    def rollup(self, by: list[str]) -> HyperLogLog:
        """Merge groups down to fewer columns."""
        return HyperLogLog(self.registers.groupBy(*by, "reg").agg(F.max("rho").alias("rho")), self.precision, by, self.ids.select(*by).distinct() if by else None)

    def count(self, mode: str = "corrected", table: tuple | None = None) -> DataFrame:
        """``by, zeros, estimate``."""
        m = 1 << self.precision
        sums = (F.count(F.lit(1)).alias("_n"), F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("_s"))
        flat = self.ids.join(self.registers.groupBy(*self.by).agg(*sums), self.by, "left") if self.by else self.registers.agg(*sums)
        zeros = F.lit(m) - F.coalesce("_n", F.lit(0))
        return flat.select(*self.by, zeros.cast("long").alias("zeros"), estimate(zeros, zeros + F.coalesce("_s", F.lit(0.0)), self.precision, mode, table).alias("estimate"))

    def equal(self, other: HyperLogLog) -> DataFrame:
        alike = self.precision == other.precision
        odd = self.registers.withColumn("_d", F.lit(1)).unionByName(other.registers.withColumn("_d", F.lit(-1))).groupBy(*self.by, "reg", "rho").agg(F.sum("_d").alias("_d")).where("_d <> 0")
        if not self.by:
            return odd.agg((F.count(F.lit(1)) == 0).alias("equal")).select((F.col("equal") & F.lit(alike)).alias("equal"))
        ids = self.ids.unionByName(other.ids).distinct()
        return ids.join(odd.groupBy(*self.by).agg(F.count(F.lit(1)).alias("_n")), self.by, "left").select(*self.by, (F.col("_n").isNull() & F.lit(alike)).alias("equal"))


#: Types of ``seq`` that are cut into ranges, and about how many rows of a stream a range holds.
_RANGED, _RANGE_ROWS = ("tinyint", "smallint", "int", "bigint", "float", "double", "timestamp"), 1_000_000


def running_count(df: DataFrame, key: str, seq: str, precision: int, mode: str = "corrected") -> DataFrame:
    """``seq, estimate`` after each row in ``seq`` order.

    Only rows that raise a register change the estimate: these are found register by register, then
    summed in order, at most about 2^precision * 65 rows however long the stream is. The other rows
    take the last estimate before them: ``seq`` (a number or a time; anything else is one range) is cut
    into equal ranges, each is streamed in order, and the ranges' last estimates, a row each, are carried on.
    """
    m = 1 << precision
    own = registers(df.select(F.col(seq).alias("_s"), F.col(key).alias("_k")), "_k", precision)
    per = Window.partitionBy("reg").orderBy("_s")
    prev = F.max("rho").over(per.rowsBetween(Window.unboundedPreceding, -1))
    raised = own.withColumn("_p", F.coalesce(prev, F.lit(0))).where("rho > _p")
    two = lambda c: F.pow(F.lit(2.0), -c)
    deltas = raised.groupBy("_s").agg(F.sum(F.when(F.col("_p") == 0, 1).otherwise(0)).alias("_z"), F.sum(two(F.col("rho")) - two(F.col("_p"))).alias("_d"))
    so_far = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    zeros, total = F.lit(m) - F.sum("_z").over(so_far), F.lit(float(m)) + F.sum("_d").over(so_far)
    changes = deltas.select("_s", estimate(zeros, total, precision, mode).alias("_e"))
    rows = df.select(F.col(seq).alias(seq)).distinct()
    rows = rows.join(changes, rows[seq] == changes["_s"], "left").drop("_s")
    ranges, at = F.lit(0), F.col(seq).cast("double") if dict(df.dtypes)[seq] in _RANGED else None
    if at is not None:
        low, high, n = df.agg(F.min(at), F.max(at), F.count(F.lit(1))).first()
        if n and high > low:
            ranges = F.floor((at - low) / (high - low) * max(1, n // _RANGE_ROWS)).cast("int")
    rows = rows.withColumn("_r", ranges)
    streamed = Window.partitionBy("_r").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("_e", F.last("_e", ignorenulls=True).over(streamed))
    ends = rows.where("_e is not null").groupBy("_r").agg(F.max_by("_e", seq).alias("_last"))
    ends = rows.select("_r").distinct().join(ends, "_r", "left")  # a row a range
    carried = ends.select("_r", F.last("_last", ignorenulls=True).over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    return filled.join(carried, "_r").select(seq, F.coalesce("_e", "_before", F.lit(0.0)).alias("estimate"))


def builtin_count(df: DataFrame, key: str, precision: int, by: list[str] | None = None) -> DataFrame:
    """The engine's own sketch, fast and mergeable, with other registers."""
    return df.groupBy(*(by or [])).agg(F.hll_sketch_estimate(F.hll_sketch_agg(key, F.lit(precision))).alias("estimate"))
