"""Key hashes: MetroHash 64/128 and MurmurHash3, as Column expressions for 64-bit keys, as Arrow functions for bytes.

Unsigned 64-bit values travel as BIGINT bit containers. Integral keys are their 8 little-endian
bytes, strings their UTF-8; null and empty keys hash to null, and every builder ignores them.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Multipliers of the published hash definitions (fixed values).
METRO64 = (0xD6D018F5, 0xA2AA033B, 0x62992FC1, 0x30BC5B29)
METRO128 = (0xC83A91E1, 0x8648DBDB, 0x7BDEC03B, 0x2F5870A5)
MURMUR = (0x87C37B91114253D5, 0x4CF5AD432745937F)
FOLD = 0x9DDFEA08EB392D69
# Seeds of the structures (fixed values).
BLOOM_SEED, HLL_SEED, MINHASH_SEED = 3781869495, 646086642, 18014475172444421775

_M = (1 << 64) - 1


def signed(x: int) -> int:
    """An unsigned 64-bit number as the BIGINT with its bits."""
    x &= _M
    return x - (1 << 64) if x >> 63 else x


@contextlib.contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Arithmetic in frames built inside wraps at 64 bits; the mode is fixed when a frame is analysed."""
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def _ror(x: str, n: int) -> str:
    return f"(shiftrightunsigned({x}, {n}) | shiftleft({x}, {64 - n}))"


def _steps(df: DataFrame, steps: list[tuple[str, str]], drop: tuple[str, ...]) -> DataFrame:
    """One projection a step, so that no step's expression is written into the next one twice."""
    for name, sql in steps:
        df = df.withColumn(name, F.expr(sql))
    return df.drop(*drop)


def metro64_long(df: DataFrame, key: str, seed: int, out: str) -> DataFrame:
    """MetroHash64 of a BIGINT column, inside code generation."""
    k0, k1, _, k3 = METRO64
    start = signed((seed + METRO64[2]) * k0)
    with wrapping(df.sparkSession):
        return _steps(
            df,
            [("_a", f"cast(`{key}` as bigint) * {k3}L + {start}L"), ("_b", f"_a ^ ({_ror('_a', 55)} * {k1}L)"), ("_c", f"(_b ^ {_ror('_b', 28)}) * {k0}L"), (out, f"_c ^ {_ror('_c', 29)}")],
            ("_a", "_b", "_c"),
        )


def metro128_long(df: DataFrame, key: str, seed: int, h: str = "h", low: str = "l") -> DataFrame:
    """MetroHash128 of a BIGINT column as two BIGINT columns, inside code generation."""
    k0, k1, k2, k3 = METRO128
    v0, v1 = signed((seed - k0) * k3), signed((seed + k1) * k2)
    with wrapping(df.sparkSession):
        return _steps(
            df,
            [
                ("_a", f"cast(`{key}` as bigint) * {k2}L + {v0}L"), ("_b", f"{_ror('_a', 33)} * {k3}L"), ("_c", f"_b * {k2}L + {v1}L"), ("_d", f"_b ^ ({_ror('_c', 27)} * {k1}L)"),
                ("_e", f"_d * {k0}L + {v1}L"), ("_f", f"_d + {_ror('_e', 13)}"), ("_g", f"{v1}L * {k1}L + _f"), ("_i", f"{v1}L + {_ror('_g', 37)}"),
                ("_j", f"_f * {k2}L + _i"), (h, f"_f + {_ror('_j', 13)}"), ("_n", f"_i * {k3}L + `{h}`"), (low, f"_i + {_ror('_n', 37)}"),
            ],
            tuple("_a _b _c _d _e _f _g _i _j _n".split()),
        )


def hash_128_64(df: DataFrame, h: str, low: str, out: str) -> DataFrame:
    """Fold a 128-bit hash to 64 bits."""
    k = signed(FOLD)
    with wrapping(df.sparkSession):
        return _steps(df, [("_a", f"(`{low}` ^ `{h}`) * {k}L"), ("_a", "_a ^ shiftrightunsigned(_a, 47)"), ("_b", f"(`{h}` ^ _a) * {k}L"), ("_b", "_b ^ shiftrightunsigned(_b, 47)"), (out, f"_b * {k}L")], ("_a", "_b"))


def projection_mod(a: Column, b: Column | int) -> Column:
    return F.pmod(a, F.lit(b) if isinstance(b, int) else b)


def projection_mul_32(a: Column, b: Column) -> Column:
    """Upper half of the product of two unsigned 32-bit numbers; halves of ``a`` keep every product below 2^48."""
    a, b = a.cast("long"), b.cast("long")
    return F.shiftright(F.shiftright(a, 16) * b + F.shiftright(a.bitwiseAND(F.lit(0xFFFF)) * b, 16), 16)


def projection_mul_64(h: str, size: int) -> str:
    """SQL for the upper half of ``h`` times ``size``, both unsigned; exact for sizes up to 2^31."""
    if not 0 < size <= 1 << 31:
        raise ValueError("projections are exact for sizes up to 2^31")
    return f"shiftrightunsigned(shiftrightunsigned({h}, 32) * {size}L + shiftrightunsigned(({h} & 4294967295L) * {size}L, 32), 32)"


# --- byte strings, by numpy over all keys of one length at a time ---


def _r(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint64(n)) | (x << np.uint64(64 - n))


def _fields(rows: np.ndarray, start: int) -> Iterator[np.ndarray]:
    """The tail of each row as fields of 8, 4, 2 and 1 bytes, where its length has them."""
    length = rows.shape[1]
    for width in (8, 4, 2, 1):
        if (length - start) & width if width < 8 else length - start >= 8:
            yield width, _word(rows, start, width)
            start += width


def _word(rows: np.ndarray, start: int, width: int) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for i in range(width):
        out |= rows[:, start + i].astype(np.uint64) << np.uint64(8 * i)
    return out


def _bulk(rows: np.ndarray, v: list[np.ndarray], k: list[np.uint64], turns: int) -> int:
    """The four-lane loop over 32-byte blocks, and its closing mix; returns where the tail starts."""
    start = 0
    while rows.shape[1] - start >= 32:
        for lane in range(4):
            v[lane] = _r(v[lane] + _word(rows, start, 8) * k[lane], 29) + v[lane ^ 2]
            start += 8
    for to, x, y, plus, out, by in ((2, 0, 3, 1, 1, 0), (3, 1, 2, 0, 0, 1), (0, 0, 2, 3, 1, 0), (1, 1, 3, 2, 0, 1)):
        v[to] = v[to] ^ (_r((v[x] + v[y]) * k[by] + v[plus], turns) * k[out])
    return start


def _metro64(rows: np.ndarray, seed: int) -> np.ndarray:
    k = [np.uint64(x) for x in METRO64]
    h = np.full(len(rows), signed((seed + METRO64[2]) * METRO64[0]), np.int64).view(np.uint64)
    start = 0
    if rows.shape[1] >= 32:
        v = [h.copy() for _ in range(4)]
        start = _bulk(rows, v, k, 37)
        h = h + (v[0] ^ v[1])
    if rows.shape[1] - start >= 16:
        a, b = (_r(h + _word(rows, start + 8 * i, 8) * k[2], 29) * k[3] for i in (0, 1))
        a = a ^ (_r(a * k[0], 21) + b)
        h = h + (b ^ (_r(b * k[3], 21) + a))
        start += 16
    for width, x in _fields(rows, start):
        h = h + x * k[3]
        h = h ^ (_r(h, {8: 55, 4: 26, 2: 48, 1: 37}[width]) * k[1])
    h = (h ^ _r(h, 28)) * k[0]
    return h ^ _r(h, 29)


def _metro128(rows: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    c, k = METRO128, [np.uint64(x) for x in METRO128]
    v = [np.full(len(rows), signed(x), np.int64).view(np.uint64) for x in ((seed - c[0]) * c[3], (seed + c[1]) * c[2], (seed + c[0]) * c[2], (seed - c[1]) * c[3])]
    start = _bulk(rows, v, k, 21) if rows.shape[1] >= 32 else 0

    def take(i: int, x: np.ndarray) -> None:
        v[i] = _r(v[i] + x * k[2], 33) * k[3]

    def stir(i: int, turns: int) -> None:
        v[i] = v[i] ^ (_r(v[i] * k[2 + i] + v[1 - i], turns) * k[1 - i])

    if rows.shape[1] - start >= 16:
        take(0, _word(rows, start, 8))
        take(1, _word(rows, start + 8, 8))
        stir(0, 45)
        stir(1, 45)
        start += 16
    for width, x in _fields(rows, start):
        side = 0 if width in (8, 2) else 1
        take(side, x)
        stir(side, {8: 27, 4: 46, 2: 22, 1: 58}[width])
    for i in range(4):
        v[i & 1] = v[i & 1] + _r(v[i & 1] * k[i] + v[1 - (i & 1)], 37 if i & 1 else 13)
    return v[0], v[1]


def _murmur(rows: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    c, n = [np.uint64(x) for x in MURMUR], rows.shape[1]
    h = [np.full(len(rows), signed(seed), np.int64).view(np.uint64) for _ in (0, 1)]

    def blend(side: int, x: np.ndarray) -> None:
        h[side] = h[side] ^ (_r(x * c[side], 33 if side == 0 else 31) * c[1 - side])

    for at in range(0, n - n % 16, 16):
        for side, (turns, plus) in enumerate(((37, 0x52DCE729), (33, 0x38495AB5))):
            blend(side, _word(rows, at + 8 * side, 8))
            h[side] = (_r(h[side], turns) + h[1 - side]) * np.uint64(5) + np.uint64(plus)
    at, rest = n - n % 16, n % 16
    if rest > 8:
        blend(1, _word(rows, at + 8, rest - 8))
    if rest:
        blend(0, _word(rows, at, min(8, rest)))
    a, b = h[0] ^ np.uint64(n), h[1] ^ np.uint64(n)
    a = a + b
    b = b + a

    def final(x: np.ndarray) -> np.ndarray:
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> np.uint64(33))) * np.uint64(m)
        return x ^ (x >> np.uint64(33))

    a, b = final(a), final(b)
    a = a + b
    return a, b + a


def hash_bytes(keys: list[bytes | None], of: Callable, seed: int, parts: int) -> list[np.ndarray]:
    """Hash byte keys, all keys of one length at once; null and empty keys give 0."""
    out = [np.zeros(len(keys), np.uint64) for _ in range(parts)]
    sizes = np.array([len(k) if k else 0 for k in keys], np.int64)
    with np.errstate(over="ignore"):
        for n in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(sizes == n)
            rows = np.frombuffer(b"".join(keys[i] for i in at), np.uint8).reshape(-1, n)
            got = of(rows, seed)
            for o, g in zip(out, got if parts == 2 else [got], strict=True):
                o[at] = g
    return out


def _raw(keys: pd.Series) -> list[bytes | None]:
    return [None if k is None else (k.encode() if isinstance(k, str) else bytes(k)) for k in keys]


def _arrow(of: Callable, seed: int, parts: int):
    if parts == 2:

        @F.pandas_udf("h long, l long")
        def run(keys: pd.Series) -> pd.DataFrame:
            h, low = (x.view(np.int64) for x in hash_bytes(_raw(keys), of, seed, 2))
            return pd.DataFrame({"h": h, "l": low})
    else:

        @F.pandas_udf("long")
        def run(keys: pd.Series) -> pd.Series:
            return pd.Series(hash_bytes(_raw(keys), of, seed, 1)[0].view(np.int64))

    return run


def integral(df: DataFrame, key: str) -> bool:
    return dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")


def usable(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key is neither null nor empty."""
    return df.where(F.col(key).isNotNull() if integral(df, key) else F.octet_length(key) > 0)


def metro128(df: DataFrame, key: str, seed: int, h: str = "h", low: str = "l") -> DataFrame:
    """Rows with usable keys and their MetroHash128 in columns ``h`` and ``low``."""
    df = usable(df, key)
    if integral(df, key):
        return metro128_long(df, key, seed, h, low)
    return df.withColumn("_m", _arrow(_metro128, seed, 2)(key)).withColumns({h: F.col("_m.h"), low: F.col("_m.l")}).drop("_m")


def metro64(df: DataFrame, key: str, seed: int, out: str = "hash") -> DataFrame:
    df = usable(df, key)
    return metro64_long(df, key, seed, out) if integral(df, key) else df.withColumn(out, _arrow(_metro64, seed, 1)(key))


def murmur3_128(df: DataFrame, key: str, seed: int, h: str = "h", low: str = "l") -> DataFrame:
    df = usable(df, key)
    if integral(df, key):  # the eight bytes of the key, little end first
        as_bytes = F.reverse(F.array(*[F.substring(F.lpad(F.hex(F.col(key).cast("long")), 16, "0"), i, 2) for i in range(1, 17, 2)]))
        df = df.withColumn("_k", F.unhex(F.array_join(as_bytes, "")))
        key = "_k"
    return df.withColumn("_m", _arrow(_murmur, seed, 2)(key)).withColumns({h: F.col("_m.h"), low: F.col("_m.l")}).drop("_m", "_k")


def murmur3_64(df: DataFrame, key: str, seed: int, out: str = "hash") -> DataFrame:
    return hash_128_64(murmur3_128(df, key, seed, "_h", "_l"), "_h", "_l", out).drop("_h", "_l")
