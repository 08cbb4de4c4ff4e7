"""Dense bitmaps as lane tables: (by..., lane, bits), 32 positions a lane; absent lanes are zero.

Every operator is a join, aggregate or projection, so bitmaps of any number of groups are built,
combined and read in parallel, and lane aggregates are summed before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANE = 32
FULL = (1 << LANE) - 1
MAX_BITS = 1 << 48
#: Lanes that ``fill`` and ``not`` may make for one bitmap; larger universes belong in run-length bitmaps.
MAX_DENSE_LANES = 1 << 26


def effective_size(size: int) -> int:
    """Sizes round up to 512 bits, and density, fullness and complement go by the rounded size."""
    if not 0 < size <= MAX_BITS:
        raise ValueError("size must be in 1..2^48")
    return -(-size // 512) * 512


def position_lane(pos: Column) -> tuple[Column, Column]:
    return F.shiftright(pos, 5).alias("lane"), F.expr("1L").alias("one")


class Bitmap:
    """A set of integers below ``size`` for each group ``by``; ``ids`` lists the groups, also empty ones."""

    def __init__(self, lanes: DataFrame, size: int, by: list[str] | None = None, ids: DataFrame | None = None):
        self.requested, self.size, self.by = size, effective_size(size), list(by or [])
        self.lanes, self.ids = lanes, ids if ids is not None else lanes.select(*self.by).distinct() if self.by else None

    # building
    @classmethod
    def from_positions(cls, df: DataFrame, pos: str, size: int, by: list[str] | None = None) -> Bitmap:
        """Positions out of range or null are ignored."""
        by, limit = list(by or []), effective_size(size)
        p = F.col(pos).cast("long")
        inside = df.where((p >= 0) & (p < limit)).select(*by, F.shiftright(p, 5).alias("lane"), F.expr(f"shiftleft(1L, cast(cast(`{pos}` as bigint) & 31 as int))").alias("bit"))
        return cls(inside.groupBy(*by, "lane").agg(F.bit_or("bit").alias("bits")), size, by, df.select(*by).distinct() if by else None)

    from_indices = from_positions

    def _with(self, lanes: DataFrame) -> Bitmap:
        return Bitmap(lanes, self.requested, self.by, self.ids)

    def copy(self) -> Bitmap:
        return self._with(self.lanes)

    clone = copy

    def __len__(self) -> int:
        return self.requested

    def set(self, df: DataFrame, pos: str) -> Bitmap:
        return self | Bitmap.from_positions(df, pos, self.requested, self.by)

    def clear(self, df: DataFrame, pos: str) -> Bitmap:
        return self.andnot(Bitmap.from_positions(df, pos, self.requested, self.by))

    # probing
    def test(self, df: DataFrame, pos: str, out: str = "found") -> DataFrame:
        """Add a boolean column: is the position set; false out of range or null."""
        own = self.lanes.withColumnRenamed("lane", "_lane").withColumnRenamed("bits", "_bits")
        probe = df.withColumn("_lane", F.shiftright(F.col(pos).cast("long"), 5))
        hit = probe.join(own, [*self.by, "_lane"], "left")
        inside = (F.col(pos) >= 0) & (F.col(pos) < self.size)
        bit = F.expr(f"shiftrightunsigned(_bits, cast(`{pos}` & 31 as int)) & 1L") == 1
        return hit.withColumn(out, F.coalesce(inside & bit, F.lit(False))).drop("_lane", "_bits")

    def test_and_set(self, df: DataFrame, pos: str, seq: str, out: str = "previous") -> DataFrame:
        """For arrivals in ``seq`` order: was the bit set before this row; rows out of range get false."""
        before = F.row_number().over(Window.partitionBy(*self.by, pos).orderBy(seq)) > 1
        inside = (F.col(pos) >= 0) & (F.col(pos) < self.size)
        return self.test(df, pos, "_was").withColumn(out, F.coalesce(inside & (F.col("_was") | before), F.lit(False))).drop("_was")

    def test_and_clear(self, df: DataFrame, pos: str, seq: str, out: str = "previous") -> DataFrame:
        first = F.row_number().over(Window.partitionBy(*self.by, pos).orderBy(seq)) == 1
        return self.test(df, pos, "_was").withColumn(out, F.col("_was") & first).drop("_was")

    # reading
    def _per_id(self, *aggs: Column) -> DataFrame:
        if not self.by:
            return self.lanes.agg(*aggs)
        return self.ids.join(self.lanes.groupBy(*self.by).agg(*aggs), self.by, "left")

    def summary(self) -> DataFrame:
        """``by, size, count, density, empty, full, first_bit, first_zero``; -1 where there is none."""
        return self.count().join(self.find_first_bit(), self.by).join(self.find_first_zero(), self.by) if self.by else self.count().crossJoin(self.find_first_bit()).crossJoin(self.find_first_zero())

    def count(self) -> DataFrame:
        n = F.coalesce(F.col("_n"), F.lit(0)).cast("long")
        flat = self._per_id(F.sum(F.bit_count("bits")).alias("_n"))
        return flat.select(*self.by, F.lit(self.size).cast("long").alias("size"), n.alias("count"), density(n, self.size).alias("density"), (n == 0).alias("empty"), (n == self.size).alias("full"))

    def find_first_bit(self) -> DataFrame:
        first = F.min(F.expr("lane * 32 + bit_count((bits & -bits) - 1)")).alias("_f")
        return self._per_id(first).select(*self.by, F.coalesce("_f", F.lit(-1)).cast("long").alias("first_bit"))

    def find_first_zero(self) -> DataFrame:
        """The first gap inside a lane, or the first missing lane: where a lane's rank falls behind its number."""
        w = Window.partitionBy(*self.by).orderBy("lane")
        leading = self.lanes.where(F.col("bits") != 0).withColumn("_r", F.row_number().over(w) - 1) if self.by else _ranked(self.lanes.where(F.col("bits") != 0))
        hole = F.min(F.when(F.col("bits") != FULL, F.expr(f"lane * 32 + bit_count((~bits & (bits + 1)) - 1)"))).alias("_h")
        run = F.max(F.when(F.col("lane") == F.col("_r"), F.col("lane"))).alias("_l")
        flat = leading.groupBy(*self.by).agg(hole, run) if self.by else leading.agg(hole, run)
        flat = self.ids.join(flat, self.by, "left") if self.by else flat
        first = F.least(F.coalesce("_h", F.lit(MAX_BITS)), (F.coalesce("_l", F.lit(-1)) + 1) * LANE)
        return flat.select(*self.by, F.when(first >= self.size, F.lit(-1)).otherwise(first).cast("long").alias("first_zero"))

    # whole-set operators
    def zero(self) -> Bitmap:
        return self._with(self.lanes.where("false"))

    def _domain(self) -> DataFrame:
        n = self.size // LANE
        if n > MAX_DENSE_LANES:
            raise ValueError("too many lanes for a dense complement; use a run-length bitmap")
        spark = self.lanes.sparkSession
        lanes = spark.range(n).select(F.col("id").alias("lane"))
        return self.ids.crossJoin(F.broadcast(lanes) if n <= 1 << 16 else lanes) if self.by else lanes  # every lane of every group is the result

    def fill(self) -> Bitmap:
        return self._with(self._domain().withColumn("bits", F.lit(FULL).cast("long")))

    def __neg__(self) -> Bitmap:
        """Complement within the rounded size."""
        whole = self._domain().join(self.lanes, [*self.by, "lane"], "left")
        return self._with(whole.select(*self.by, "lane", F.expr(f"coalesce(bits, 0L) ^ {FULL}L").alias("bits")).where("bits <> 0"))

    __invert__ = __neg__

    def _same(self, other: Bitmap) -> None:
        if self.size != other.size or self.by != other.by:
            raise ValueError("bitmaps differ in size or groups")

    def _ids(self, other: Bitmap) -> DataFrame | None:
        return self.ids.unionByName(other.ids).distinct() if self.by else None

    def _merge(self, other: Bitmap, agg) -> Bitmap:
        self._same(other)
        both = self.lanes.select(*self.by, "lane", "bits").unionByName(other.lanes.select(*self.by, "lane", "bits"))
        return Bitmap(both.groupBy(*self.by, "lane").agg(agg("bits").alias("bits")).where("bits <> 0"), self.requested, self.by, self._ids(other))

    def __or__(self, other: Bitmap) -> Bitmap:
        return self._merge(other, F.bit_or)

    def __xor__(self, other: Bitmap) -> Bitmap:
        return self._merge(other, F.bit_xor)

    def _joined(self, other: Bitmap, how: str, sql: str) -> Bitmap:
        self._same(other)
        both = self.lanes.join(other.lanes.withColumnRenamed("bits", "_o"), [*self.by, "lane"], how)
        return Bitmap(both.select(*self.by, "lane", F.expr(sql).alias("bits")).where("bits <> 0"), self.requested, self.by, self._ids(other))

    def __and__(self, other: Bitmap) -> Bitmap:
        return self._joined(other, "inner", "bits & _o")

    def andnot(self, other: Bitmap) -> Bitmap:
        return self._joined(other, "left", f"bits & (coalesce(_o, 0L) ^ {FULL}L)")

    def equal(self, other: Bitmap) -> DataFrame:
        """``by, equal``: same rounded size and same positions."""
        if self.size != other.size:
            ids = self._ids(other) if self.by else self.lanes.sparkSession.range(1).select()
            return ids.withColumn("equal", F.lit(False))
        odd = (self ^ other).lanes
        if not self.by:
            return odd.agg((F.count(F.lit(1)) == 0).alias("equal"))
        return self._ids(other).join(odd.groupBy(*self.by).agg(F.count(F.lit(1)).alias("_n")), self.by, "left").select(*self.by, F.col("_n").isNull().alias("equal"))

    def positions(self) -> DataFrame:
        lifted = self.lanes.select(*self.by, "lane", "bits", F.explode(F.sequence(F.lit(0), F.lit(LANE - 1))).alias("_i"))
        return lifted.where(F.expr("(shiftrightunsigned(bits, _i) & 1L) = 1L")).select(*self.by, (F.col("lane") * LANE + F.col("_i")).alias("pos"))


def density(count: Column, size: int) -> Column:
    """Single-precision share of set bits."""
    return (count.cast("float") / F.lit(float(size)).cast("float")).cast("float")


def _ranked(lanes: DataFrame) -> DataFrame:
    """Global rank of lanes without one big sort task: ranks within blocks of lanes plus the blocks' offsets."""
    blocks = lanes.withColumn("_b", F.shiftright("lane", 16))
    counts = blocks.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row per 2^21 positions
    return blocks.join(before, "_b").withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("lane")) - 1 + F.col("_p")).drop("_b", "_p")
