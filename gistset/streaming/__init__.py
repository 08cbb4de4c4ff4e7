"""Structured Streaming versions: de-duplication with expiry, running distinct counts, aging filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import BLOOM_SEED, metro128
from ..operators.aging import Fold
from ..operators.bitmap import effective_size
from ..operators.hll import estimate, registers


def deduplicate(stream: DataFrame, key: str, ts: str, duration: str) -> DataFrame:
    """Rows whose key was not seen in the current event-time window of ``duration``; state goes with the watermark."""
    windowed = stream.withColumn("_w", F.window(ts, duration)["start"]).withWatermark("_w", duration)
    return windowed.dropDuplicates(["_w", key]).drop("_w")


def deduplicate_within(stream: DataFrame, key: str, ts: str, duration: str) -> DataFrame:
    """Rows whose key was not seen within ``duration`` before."""
    return stream.withWatermark(ts, duration).dropDuplicatesWithinWatermark([key])


def running_registers(stream: DataFrame, key: str, precision: int) -> DataFrame:
    """Register maxima of a stream (update or complete mode)."""
    return registers(stream.select(F.col(key).alias("_k")), "_k", precision).groupBy("reg").agg(F.max("rho").alias("rho"))


def distinct_count(registers_so_far: DataFrame, precision: int, mode: str = "corrected") -> DataFrame:
    """Estimate of a (micro-batch's complete) register table; for use in foreachBatch."""
    m = 1 << precision
    zeros = F.lit(m) - F.count(F.lit(1))
    return registers_so_far.agg(zeros.alias("z"), F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("s")).select(estimate(F.col("z"), F.col("z") + F.coalesce("s", F.lit(0.0)), precision, mode).alias("estimate"))


def aging_filter(stream: DataFrame, key: str, group: str, seq: str, size: int, k: int, density: float) -> DataFrame:
    """``group, seq, seen`` for each arrival of each group's aging filter, state kept between micro-batches."""
    whole = effective_size(size)
    kinds = dict(stream.dtypes)
    hashed = metro128(stream.select(group, seq, F.col(key).alias("_k")), "_k", BLOOM_SEED, "_h", "_l").drop("_k")

    def run(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fold = Fold(whole, k, density)
        if state.exists:
            active, passive, fold.count, fold.generation = state.get
            fold.active = np.unpackbits(np.frombuffer(active, np.uint8)).astype(bool)
            fold.passive = np.unpackbits(np.frombuffer(passive, np.uint8)).astype(bool)
        rows = pd.concat(list(batches)).sort_values(seq)
        seen = []
        for h, low in zip(rows["_h"].tolist(), rows["_l"].tolist(), strict=True):
            at = fold.positions(h, low)
            seen.append(fold.test(at))
            fold.insert(at)
        state.update((np.packbits(fold.active).tobytes(), np.packbits(fold.passive).tobytes(), fold.count, fold.generation))
        yield pd.DataFrame({group: [name[0]] * len(rows), seq: rows[seq].to_numpy(), "seen": seen})

    return hashed.groupBy(group).applyInPandasWithState(run, f"`{group}` {kinds[group]}, `{seq}` {kinds[seq]}, seen boolean", "active binary, passive binary, count long, generation long", "append", "NoTimeout")
