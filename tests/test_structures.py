"""Golden vectors, set laws and error cases of the set-summary structures."""

import random

import pytest
from pyspark.sql import functions as F

from gistset.functions import hashing as H
from gistset.operators import aging, bloom, hll
from gistset.operators.bitmap import Bitmap
from gistset.operators.bloom import BloomFilter
from gistset.operators.hll import HyperLogLog
from gistset.operators.minhash import MinHash
from gistset.operators.rle import RleBitmap


def numbers(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "pos long")


def runs(spark, ranges):
    return spark.createDataFrame(ranges, "a long, b long")


def spans(r):
    return sorted((x["pos"], x["pos"] + x["count"] - 1) for x in r.runs.collect())


def positions(b):
    return {r["pos"] for r in b.positions().collect()}


def test_hash_vectors(spark):
    keys = spark.createDataFrame([(0,), (1,), (42,), (-(1 << 63),)], "k long")
    u = lambda x: f"{x & (1 << 64) - 1:016x}"
    got = [(u(r["h"]), u(r["l"])) for r in H.metro128(keys, "k", H.BLOOM_SEED).collect()]
    assert got == [("563fd9a9ccfb65eb", "1669cf248dd46248"), ("27dd476ae824f3a2", "7ee3356daf4acd36"), ("248bf4820fcacf6d", "6e8ed29535a1b2f3"), ("1503425f81a090d4", "9a94a841e9570528")]
    got = [u(r["h"]) for r in H.metro128(keys, "k", H.HLL_SEED).collect()]
    assert got == ["d04de48bdafc41aa", "aaa8d0373e94f115", "5df36d467c96e169", "3bc258f74f50ff96"]
    got = [u(r["hash"]) for r in H.metro64(keys, "k", H.MINHASH_SEED).collect()]
    assert got == ["8531e41a172c9330", "a21673fe39ac392d", "a81406f20cf95234", "84cc927a8e943447"]


def test_hash_bytes_vectors():
    key = [b"012345678901234567890123456789012345678901234567890123456789012", None, b""]
    assert int(H.hash_bytes(key, H._metro64, 0, 1)[0][0]).to_bytes(8, "little").hex() == "6b753dae06704bad"
    assert [int(x[0]).to_bytes(8, "little").hex() for x in H.hash_bytes(key, H._metro128, 0, 2)] == ["c77ce2bfa4ed9f9b", "0548b2ac5074a297"]


def test_bloom_positions(spark):
    words = spark.createDataFrame([("herp",), ("derp",), ("oups!",)], "w string")
    got = {}
    for r in bloom.bit_positions(words, "w", 1024, 7).collect():
        got.setdefault(r["w"], []).append(r["bit"])
    assert got["herp"] == [558, 887, 193, 522, 852, 157, 487]
    assert got["derp"] == [338, 978, 595, 211, 852, 469, 85]
    assert got["oups!"] == [5, 1005, 980, 955, 930, 905, 881]


def test_bitmap_laws(spark):
    rnd = random.Random(3)
    xs, ys = ({rnd.randrange(1000) for _ in range(200)} for _ in range(2))
    a, b = (Bitmap.from_positions(numbers(spark, s), "pos", 1000) for s in (xs, ys))
    assert len(a) == 1000 and a.size == 1024
    assert positions(a | b) == xs | ys and positions(a & b) == xs & ys and positions(a ^ b) == xs ^ ys and positions(a.andnot(b)) == xs - ys
    assert positions(-a) == set(range(1024)) - xs
    assert (-(-a)).equal(a).first()[0] and not a.equal(b).first()[0]
    assert a.fill().count().first()["full"] and a.zero().count().first()["empty"]
    assert a.fill().find_first_zero().first()[0] == -1 and a.zero().find_first_bit().first()[0] == -1
    assert a.find_first_bit().first()[0] == min(xs) and a.find_first_zero().first()[0] == min(set(range(1024)) - xs)
    probe = spark.createDataFrame([(0,), (999,), (5000,), (-1,), (None,)], "p long")
    assert [r["found"] for r in a.test(probe, "p").orderBy("p").collect()] == [False, False, 0 in xs, 999 in xs, False]


@pytest.mark.parametrize("make", [lambda s: Bitmap.from_positions(numbers(s, [1]), "pos", 0), lambda s: RleBitmap.from_positions(numbers(s, [1]), "pos", (1 << 48) + 1), lambda s: BloomFilter.from_iterable(numbers(s, [1]), "pos", 64, 0), lambda s: HyperLogLog.from_iterable(numbers(s, [1]), "pos", 5), lambda s: HyperLogLog.from_iterable(numbers(s, [1]), "pos", 19), lambda s: MinHash.from_iterable(numbers(s, [1]), "pos", 0), lambda s: aging.AgingBloom.from_iterable(numbers(s, [1]), "pos", "pos", 64, 1, 1.5)])
def test_invalid_parameters(spark, make):
    with pytest.raises(ValueError):
        make(spark)


def test_rle_golden(spark):
    make = lambda r: RleBitmap.from_ranges(runs(spark, r), "a", "b", 512)
    a, b = make([(0, 255), (327, 410), (510, 511)]), make([(0, 7), (9, 15), (17, 31), (255, 325), (409, 500)])
    assert spans(a | b) == [(0, 325), (327, 500), (510, 511)]
    a, b = make([(0, 127), (255, 325), (409, 511)]), make([(0, 8), (10, 15), (17, 128), (255, 500)])
    assert spans(a & b) == [(0, 8), (10, 15), (17, 127), (255, 325), (409, 500)]
    for r, want in (([], [(0, 511)]), ([(0, 511)], []), ([(1, 510)], [(0, 0), (511, 511)]), ([(0, 0), (511, 511)], [(1, 510)])):
        assert spans(-make(r)) == want
    assert make([(0, 511)]).find_first_zero().first()[0] == -1 and make([(3, 4)]).find_first_zero().first()[0] == 0


def test_rle_arrivals(spark):
    df = spark.createDataFrame([(1, 5, 3), (2, 6, 4), (3, 8, 1), (4, 7, 9), (5, 20, 2)], "s long, p long, n long")
    assert spans(RleBitmap.from_arrivals(df, "p", "s", 512, count="n")) == [(5, 8), (20, 21)]
    assert spans(RleBitmap.from_arrivals(df, "p", "s", 512)) == [(5, 6), (8, 8), (20, 20)]


def test_bloom_membership(spark):
    words = spark.createDataFrame([("herp",), ("derp",), ("ferp",), (None,), ("",)], "w string")
    other = spark.createDataFrame([("derp",), ("ferp",), ("merp",)], "w string")
    a, b = (BloomFilter.from_iterable(d, "w", 1 << 12, 7) for d in (words, other))
    probe = spark.createDataFrame([(w,) for w in ("herp", "derp", "ferp", "merp", "oups!", "", None)], "w string")
    found = lambda f: {r["w"] for r in f.test(probe, "w").where("found").collect()}
    assert found(a) == {"herp", "derp", "ferp"} and found(a & b) == {"derp", "ferp"} and found(a | b) == {"herp", "derp", "ferp", "merp"}
    with pytest.raises(ValueError):
        a | BloomFilter.from_iterable(other, "w", 1 << 12, 3)


def test_unique_is_the_sequential_loop(spark):
    rnd = random.Random(5)
    keys = [rnd.randrange(300) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(keys)), "s long, k long")
    got = {r["s"] for r in bloom.unique(df, "k", "s", 512, 3).collect()}
    bits = {}
    for r in bloom.bit_positions(df, "k", 512, 3).collect():
        bits.setdefault(r["s"], []).append(r["bit"])
    seen, want = set(), set()
    for s in range(len(keys)):
        if not set(bits[s]) <= seen:
            want.add(s)
        seen |= set(bits[s])
    assert got == want


@pytest.mark.parametrize("p, n", [(10, 200), (10, 2500), (12, 3200), (12, 20000)])
def test_hll_accuracy(spark, p, n):
    e = HyperLogLog.from_iterable(spark.range(n), "id", p).count().first()["estimate"]
    assert abs(e - n) <= 4 * hll.error_for_registers(1 << p) * n


def test_hll_linear_golden(spark):
    r = HyperLogLog.from_iterable(spark.range(512), "id", 10).count().first()
    assert r["zeros"] == 611 and abs(r["estimate"] - 528.7678) < 1e-3
    assert HyperLogLog.from_iterable(spark.range(8000), "id", 12).count().first()["zeros"] == 568


def test_hll_running(spark):
    df = spark.createDataFrame([(i, f"{x}\n") for i, x in enumerate([1, 2, 3, 1, 2, 3])], "s long, line string")
    assert [int(r["estimate"]) for r in hll.running_count(df, "line", "s", 16).orderBy("s").collect()] == [1, 2, 3, 3, 3, 3]


def test_minhash(spark):
    a = spark.range(0, 10240, 3).select(F.lit("a").alias("g"), "id")
    b = spark.range(0, 10240, 5).select(F.lit("b").alias("g"), "id")
    m = MinHash.from_iterable(a.unionByName(b), "id", 1024, ["g"])
    pairs = spark.createDataFrame([("a", "b")], "x string, y string")
    assert m.estimate(pairs, "x", "y").first()["jaccard"] == 0.125
    both = MinHash.from_iterable(a.unionByName(b), "id", 64)
    parts = MinHash.from_iterable(a, "id", 64) | MinHash.from_iterable(b, "id", 64)
    assert both.equal(parts).first()["equal"]


def test_aging(spark):
    df = spark.range(2000).select("id")
    a = aging.AgingBloom.from_iterable(df, "id", "id", 1 << 12, 5, 0.25)
    assert a.test(df.where("id >= 1900"), "id").where("not found").count() == 0
    assert a.count().first()["density"] < 0.5 and a.copy().density_limit == 0.25


def test_streaming_dedup(spark, tmp_path):
    from gistset.streaming import deduplicate

    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (2, "2024-01-01 00:00:02")], "k long, t string").select("k", F.to_timestamp("t").alias("t")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k long, t timestamp").parquet(str(tmp_path / "in"))
    q = deduplicate(s, "k", "t", "1 minute").writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("dedup").count() == 2


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_universe_grows_with_the_table(spark, tmp_path):
    """Positions beyond the least universes count in every bitmap and run query whose SQL has no bound."""
    import duckdb

    from gistset.plans import queries as plans

    ids = [1, 2, 5, (1 << 17) - 3, (1 << 17) - 2, (1 << 17) - 1, 1 << 17, (1 << 17) + 600, (1 << 18) - 1]
    events = spark.createDataFrame([(i, ("a", "b")[i % 2], u) for i, u in enumerate(ids * 2)], "event_id long, event_type string, user_id long")
    keys = [1, 3, 4, (1 << 22) - 2, (1 << 22) - 1, 1 << 22, (1 << 22) + 900, (1 << 23) - 1]
    orders = spark.createDataFrame([(k, ("F", "O")[k % 2], k % 7, ("1-URGENT", "5-LOW")[i % 2]) for i, k in enumerate(keys)], "o_orderkey long, o_orderstatus string, o_custkey long, o_orderpriority string")
    lineitem = spark.createDataFrame([(k + d, 1) for k in keys for d in (0, 5)], "l_orderkey long, l_linenumber int")
    con = duckdb.connect()
    for name, df in (("events", events), ("orders", orders), ("lineitem", lineitem)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    bound = {"bitmap_cardinality", "bitmap_not", "rle_not", "rle_density"}  # their SQL names the least universe
    names = [n for n in plans._Q if n.startswith(("bitmap_", "rle_")) and n in plans._SQL and n not in bound]
    assert len(names) > 15
    key = lambda rows: sorted(map(repr, rows))
    for n in names:
        df = plans._Q[n](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({plans._SQL[n]})").fetchall()
        assert key(tuple(r) for r in df.collect()) == key(want), n
    assert {r["event_type"]: r["count"] for r in plans._Q["bitmap_cardinality"](spark, str(tmp_path)).collect()} == {"a": 9, "b": 9}


@pytest.mark.parametrize("keys", [[0, 1, 5, (1 << 22) - 2], [1, 3, (1 << 22) - 1], [2, 1 << 22], [0, 3, (1 << 22) - 1, 1 << 22, (1 << 22) + 901, (1 << 23) + 4]])
def test_rle_not_ends_with_the_universe_or_the_last_key(spark, tmp_path, keys):
    import duckdb

    from gistset.plans import queries as plans

    rows = [(k, ("O", "P")[i % 2], 1) for i, k in enumerate(keys)] + [(4, "F", 1), ((1 << 22) + 40, "F", 1), ((1 << 24) + 9, "F", 1)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(f"SELECT pos, count FROM ({plans._SQL['rle_not']})").fetchall()
    assert sorted((r["pos"], r["count"]) for r in plans._Q["rle_not"](spark, str(tmp_path)).collect()) == sorted(want)


def test_rle_density_refers_to_the_named_universe(spark, tmp_path):
    import duckdb

    from gistset.plans import queries as plans

    rows = [(0, "F"), (3, "F"), ((1 << 22) - 1, "F"), (1 << 22, "F"), (5, "O"), ((1 << 22) + 900, "O"), ((1 << 23) + 4, "O"), ((1 << 24) + 1, "P"), (7, "P"), (7, "P")]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    df = plans._Q["rle_density"](spark, str(tmp_path))
    cols = ", ".join(f'"{c}"' for c in df.columns)
    assert sorted(tuple(r) for r in df.collect()) == sorted(con.execute(f"SELECT {cols} FROM ({plans._SQL['rle_density']})").fetchall())


def test_rle_count_against_a_named_universe(spark):
    df = spark.createDataFrame([("a", 0, 9), ("a", 12, 31), ("b", 0, 15), ("b", 20, 20), ("c", 16, 40), ("d", 5, 4)], "g string, a long, b long")
    r = RleBitmap.from_ranges(df, "a", "b", 64, ["g"])
    got = {x["g"]: tuple(x)[1:] for x in r.count(16).collect()}
    assert got == {"a": (16, 30, 30 / 16, False, False), "b": (16, 17, 17 / 16, False, True), "c": (16, 25, 25 / 16, False, False), "d": (16, 0, 0.0, True, False)}
    assert {x["g"]: (x["size"], x["count"], x["full"]) for x in r.count().collect()} == {"a": (64, 30, False), "b": (64, 17, False), "c": (64, 25, False), "d": (64, 0, False)}
    assert all(x["full"] for x in r.fill().count().collect())
    with pytest.raises(ValueError):
        r.count(0)


def test_projection_mul_32_is_exact(spark):
    rnd = random.Random(1)
    pairs = [(1, 2**32 - 1), (3, 1431655765), (7, 613566756), (2**32 - 1, 2**32 - 1), (0, 5), *[(rnd.randrange(2**32), rnd.randrange(2**32)) for _ in range(500)]]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = df.select("a", "b", H.projection_mul_32(F.col("a"), F.col("b")).alias("p")).collect()
    assert all(r["p"] == (r["a"] * r["b"]) >> 32 for r in got) and len(got) == len(pairs)


def test_murmur3_published_vectors(spark):
    given = {"hello": 0xCBD8A7B341BD9B025B1E906A48AE1D19, "The quick brown fox jumps over the lazy dog": 0xE34BBC7BBC071B6C7A433CA9C49A9347}
    for r in H.murmur3_128(spark.createDataFrame([(t,) for t in given], "t string"), "t", 0).collect():
        assert ((r["h"] % 2**64) << 64) | (r["l"] % 2**64) == given[r["t"]]


def test_unique_in_windows_that_repeat_seq(spark):
    rows = [("x", 1, 10), ("x", 3, 10), ("y", 1, 11), ("y", 3, 12), (None, 1, 13), (None, 2, 13)]
    df = spark.createDataFrame(rows, "w string, seq long, key long")
    got = bloom.unique(df, "key", "seq", 1 << 12, 4, window=F.col("w")).collect()
    assert sorted(((r["w"], r["seq"]) for r in got), key=repr) == sorted([("x", 1), ("y", 1), ("y", 3), (None, 1)], key=repr)


def test_rle_test_on_long_runs(spark):
    rnd = random.Random(2)
    runs = [(0, 70_000), (200_000, 200_000), (10**9, 10**13), (2**47, 2**48 - 5)]
    points = [p + d for r in runs for p in r for d in (-1, 0, 1)] + [rnd.randrange(2**48) for _ in range(300)]
    bits = RleBitmap.from_ranges(spark.createDataFrame(runs, "a long, b long"), "a", "b", 1 << 48)
    got = bits.test(spark.createDataFrame([(p,) for p in points], "p long"), "p").collect()
    assert len(got) == len(points) and all(r["found"] == any(a <= r["p"] <= b for a, b in runs) for r in got)
    whole = RleBitmap.from_ranges(spark.createDataFrame([("g", 0, 2**48 - 1)], "g string, a long, b long"), "a", "b", 1 << 48, ["g"])
    got = whole.test(spark.createDataFrame([("g", 2**40), ("h", 5)], "g string, p long"), "p").collect()
    assert {r["g"]: r["found"] for r in got} == {"g": True, "h": False}


def test_running_count_in_many_ranges(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(i * 3, rnd.randrange(400)) for i in range(900)]
    df = spark.createDataFrame(rows, "seq long, key long").repartition(5)
    one = {r["seq"]: r["estimate"] for r in hll.running_count(df, "key", "seq", 8).collect()}
    monkeypatch.setattr(hll, "_RANGE_ROWS", 7)
    assert {r["seq"]: r["estimate"] for r in hll.running_count(df, "key", "seq", 8).collect()} == one and len(one) == 900
    at = 3 * 640
    plain = HyperLogLog.from_iterable(df.where(F.col("seq") <= at), "key", 8).count().first()["estimate"]
    assert abs(one[at] - plain) < 1e-6
