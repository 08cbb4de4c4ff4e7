"""Run-length bitmaps as run tables: (by..., pos, count), sorted disjoint runs that never touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitmap import MAX_BITS, density


def coalesced(runs: DataFrame, by: list[str]) -> DataFrame:
    """Merge overlapping and touching runs of each group into canonical ones."""
    w = Window.partitionBy(*by).orderBy("pos")
    reach = F.max(F.col("pos") + F.col("count")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = runs.withColumn("_new", F.when(F.col("pos") > reach, 1).when(reach.isNull(), 1).otherwise(0))
    island = flagged.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "_i").agg(F.min("pos").alias("pos"), (F.max(F.col("pos") + F.col("count")) - F.min("pos")).alias("count")).drop("_i")


class RleBitmap:
    """Like ``Bitmap``, but its size is exact and ``set`` order matters only for ``from_arrivals``."""

    def __init__(self, runs: DataFrame, size: int, by: list[str] | None = None, ids: DataFrame | None = None):
        if not 0 < size <= MAX_BITS:
            raise ValueError("size must be in 1..2^48")
        self.runs, self.size, self.by = runs, size, list(by or [])
        self.ids = ids if ids is not None else runs.select(*self.by).distinct() if self.by else None

    @classmethod
    def from_positions(cls, df: DataFrame, pos: str, size: int, by: list[str] | None = None) -> RleBitmap:
        """Gaps and islands over distinct positions inside the size."""
        by = list(by or [])
        p = df.where((F.col(pos) >= 0) & (F.col(pos) < size)).select(*by, F.col(pos).cast("long").alias("pos")).distinct()
        island = p.withColumn("_i", F.col("pos") - F.row_number().over(Window.partitionBy(*by).orderBy("pos")))
        runs = island.groupBy(*by, "_i").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("count")).drop("_i")
        return cls(runs, size, by, df.select(*by).distinct() if by else None)

    from_indices = from_positions

    @classmethod
    def from_ranges(cls, df: DataFrame, start: str, end: str, size: int, by: list[str] | None = None) -> RleBitmap:
        """Inclusive ranges in any order; empty ones are dropped, ends are cut to the size."""
        by = list(by or [])
        last = F.least(F.col(end), F.lit(size - 1))
        runs = df.where((F.col(end) >= F.col(start)) & (F.col(start) >= 0) & (F.col(start) < size)).select(*by, F.col(start).cast("long").alias("pos"), (last - F.col(start) + 1).cast("long").alias("count"))
        return cls(coalesced(runs, by), size, by, df.select(*by).distinct() if by else None)

    @classmethod
    def from_arrivals(cls, df: DataFrame, pos: str, seq: str, size: int, by: list[str] | None = None, count: str | None = None) -> RleBitmap:
        """Append in ``seq`` order; a run that starts at or before the last position is dropped, as an append-only set does."""
        by = list(by or [])
        n = F.col(count).cast("long") if count else F.lit(1).cast("long")
        given = df.where((F.col(pos) >= 0) & (F.col(pos) < size) & (n > 0)).select(*by, F.struct(F.col(seq).alias("s"), F.col(pos).cast("long").alias("p"), F.least(n, F.lit(size) - F.col(pos)).alias("n")).alias("x"))
        if count is None:  # single positions: an arrival stays if it exceeds all before it
            w = Window.partitionBy(*by).orderBy("x.s").rowsBetween(Window.unboundedPreceding, -1)
            kept = given.withColumn("_m", F.max("x.p").over(w)).where("_m is null or x.p > _m").select(*by, F.col("x.p").alias("pos"), F.lit(1).cast("long").alias("count"))
        else:  # a rejected run may end past the last position, so the fold goes run by run
            fold = "aggregate(array_sort(collect_list(x)), struct(-1L as last, cast(array() as array<struct<p:bigint,n:bigint>>) as kept), (a, r) -> if(r.p > a.last, struct(r.p + r.n - 1 as last, concat(a.kept, array(struct(r.p as p, r.n as n))) as kept), a)).kept"
            kept = given.groupBy(*by).agg(F.expr(fold).alias("_k")) if by else given.agg(F.expr(fold).alias("_k"))
            kept = kept.select(*by, F.explode("_k").alias("_x")).select(*by, F.col("_x.p").alias("pos"), F.col("_x.n").alias("count"))
        return cls(coalesced(kept, by), size, by, df.select(*by).distinct() if by else None)

    def _with(self, runs: DataFrame, ids: DataFrame | None = None) -> RleBitmap:
        return RleBitmap(runs, self.size, self.by, self.ids if ids is None else ids)

    def copy(self) -> RleBitmap:
        return self._with(self.runs)

    clone = copy

    def __len__(self) -> int:
        return self.size

    def test(self, df: DataFrame, pos: str, out: str = "found", block_bits: int = 16) -> DataFrame:
        """Point in interval, as equality joins: a point meets the runs that begin or end in its block of 2^16 positions.

        Blocks that a run covers whole are a run of block numbers, met in the same way one level up, so a run
        of any length makes two rows a level and three levels reach 2^48.
        """
        key = F.col(pos).cast("long")
        runs = self.runs.select(*[F.col(c).alias(f"_{c}") for c in self.by], F.col("pos").alias("_p"), (F.col("pos") + F.col("count") - 1).alias("_e"))
        found, hits = df, F.lit(False)
        for level in range(-(-48 // block_bits)):
            block = lambda c: F.shiftright(c, block_bits)
            edges = runs.select("*", F.explode(F.array_distinct(F.array(block(F.col("_p")), block(F.col("_e"))))).alias("_rb"))
            edges = edges.select(*[F.col(f"_{c}").alias(f"_{c}{level}") for c in self.by], F.col("_p").alias(f"_p{level}"), F.col("_e").alias(f"_e{level}"), F.col("_rb").alias(f"_b{level}"))
            at = F.shiftright(key, block_bits * level)
            cond = (block(at) == F.col(f"_b{level}")) & (at >= F.col(f"_p{level}")) & (at <= F.col(f"_e{level}"))
            for c in self.by:
                cond = cond & (F.col(c) == F.col(f"_{c}{level}"))
            found = found.join(edges, cond, "left")
            hits = hits | F.col(f"_p{level}").isNotNull()
            runs = runs.withColumns({"_p": block(F.col("_p")) + 1, "_e": block(F.col("_e")) - 1}).where("_p <= _e")
        return found.select(*df.columns, F.coalesce(hits & (F.col(pos) < self.size), F.lit(False)).alias(out))

    def _per_id(self, *aggs: Column) -> DataFrame:
        flat = self.runs.groupBy(*self.by).agg(*aggs) if self.by else self.runs.agg(*aggs)
        return self.ids.join(flat, self.by, "left") if self.by else flat

    def count(self, of: int | None = None) -> DataFrame:
        """All set positions; ``of`` names the universe that size, density and full refer to, so density may exceed 1."""
        size = self.size if of is None else of
        if not 0 < size <= MAX_BITS:
            raise ValueError("size must be in 1..2^48")
        n, inside = (F.coalesce(c, F.lit(0)).cast("long") for c in ("_n", "_in"))
        cut = F.greatest(F.least(F.col("pos") + F.col("count"), F.lit(size)) - F.col("pos"), F.lit(0))
        return self._per_id(F.sum("count").alias("_n"), F.sum(cut).alias("_in")).select(*self.by, F.lit(size).cast("long").alias("size"), n.alias("count"), density(n, size).alias("density"), (n == 0).alias("empty"), (inside == size).alias("full"))

    def find_first_bit(self) -> DataFrame:
        return self._per_id(F.min("pos").alias("_p")).select(*self.by, F.coalesce("_p", F.lit(-1)).cast("long").alias("first_bit"))

    def find_first_zero(self) -> DataFrame:
        first = F.when(F.col("_r.p").isNull() | (F.col("_r.p") > 0), F.lit(0)).when(F.col("_r.n") >= self.size, F.lit(-1)).otherwise(F.col("_r.n"))
        return self._per_id(F.min(F.struct(F.col("pos").alias("p"), F.col("count").alias("n"))).alias("_r")).select(*self.by, first.cast("long").alias("first_zero"))

    def zero(self) -> RleBitmap:
        return self._with(self.runs.where("false"))

    def fill(self) -> RleBitmap:
        ids = self.ids if self.by else self.runs.sparkSession.range(1).select()
        return self._with(ids.select(*self.by, F.lit(0).cast("long").alias("pos"), F.lit(self.size).cast("long").alias("count")))

    def __neg__(self) -> RleBitmap:
        """Gaps between runs, with the head and the tail; an empty set becomes one full run."""
        w = Window.partitionBy(*self.by).orderBy("pos")
        end = F.col("pos") + F.col("count")
        inner = self.runs.select(*self.by, end.alias("_a"), F.coalesce(F.lead("pos").over(w), F.lit(self.size)).alias("_b"))
        head = self._per_id(F.min("pos").alias("_f")).select(*self.by, F.lit(0).cast("long").alias("_a"), F.coalesce("_f", F.lit(self.size)).cast("long").alias("_b"))
        return self._with(inner.unionByName(head).where("_b > _a").select(*self.by, F.col("_a").alias("pos"), (F.col("_b") - F.col("_a")).alias("count")))

    __invert__ = __neg__

    def _same(self, other: RleBitmap) -> DataFrame | None:
        if self.size != other.size or self.by != other.by:
            raise ValueError("bitmaps differ in size or groups")
        return self.ids.unionByName(other.ids).distinct() if self.by else None

    def __or__(self, other: RleBitmap) -> RleBitmap:
        ids = self._same(other)
        return self._with(coalesced(self.runs.unionByName(other.runs), self.by), ids)

    def __and__(self, other: RleBitmap) -> RleBitmap:
        """Stretches covered twice: a sweep over starts and ends, so no pair of runs is compared."""
        ids = self._same(other)
        both = self.runs.unionByName(other.runs)
        events = both.select(*self.by, F.explode(F.array(F.struct(F.col("pos").alias("at"), F.lit(1).alias("d")), F.struct((F.col("pos") + F.col("count")).alias("at"), F.lit(-1).alias("d")))).alias("_x"))
        events = events.select(*self.by, "_x.at", "_x.d").groupBy(*self.by, "at").agg(F.sum("d").alias("d"))
        w = Window.partitionBy(*self.by).orderBy("at")
        swept = events.withColumn("_c", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.lead("at").over(w)).where("_c = 2")
        return self._with(coalesced(swept.select(*self.by, F.col("at").alias("pos"), (F.col("_n") - F.col("at")).alias("count")), self.by), ids)

    def equal(self, other: RleBitmap) -> DataFrame:
        ids = self._same(other)
        odd = self.runs.select(*self.by, "pos", "count").withColumn("_s", F.lit(1)).unionByName(other.runs.select(*self.by, "pos", "count").withColumn("_s", F.lit(-1)))
        odd = odd.groupBy(*self.by, "pos", "count").agg(F.sum("_s").alias("_s")).where("_s <> 0")
        if not self.by:
            return odd.agg((F.count(F.lit(1)) == 0).alias("equal"))
        return ids.join(odd.groupBy(*self.by).agg(F.count(F.lit(1)).alias("_n")), self.by, "left").select(*self.by, F.col("_n").isNull().alias("equal"))
