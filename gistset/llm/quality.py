"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_heavy, materialize, slices, text_hash, without_rows

#: Model rows up to which scoring sends the model to all executors (12 bytes each); a larger model is joined by shuffle.
BROADCAST_ROWS = 4_000_000
#: Trusted-id rows up to which they are sent to all executors.
SMALL_ROWS = 1_000_000
#: Bytes of one text that are scored at a time.
_PIECE = 1 << 20


def gram_keys(raw: np.ndarray, order: int) -> np.ndarray:
    """For each byte from ``order - 1`` on the number that the ``order`` bytes up to it spell."""
    n = len(raw) - order + 1
    key = np.zeros(max(n, 0), np.int64)
    for j in range(order if n > 0 else 0):
        key = (key << 8) | raw[j : j + n]
    return key


def _padded(texts: list[str | None], order: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, bytes) pieces of texts; each starts with the ``order - 1`` bytes before it, zeros at a text's start."""
    for i, t in enumerate(texts):
        raw = np.frombuffer(bytes(order - 1) + (t or "").encode("utf-8", "surrogatepass"), np.uint8)
        for a in range(0, max(1, len(raw) - order + 1), _PIECE):
            yield i, raw[a : a + _PIECE + order - 1]


def count_grams(docs: DataFrame, order: int) -> DataFrame:
    """``lang, key, c``: how often each byte ``order``-gram occurs in the texts ``t`` of each language; summed in tasks, then by key."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in slices(batches, "t", 8 << 20):
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for lang in set(langs.tolist()):
                keys = [gram_keys(raw, order) for _, raw in _padded([texts[i] for i in np.flatnonzero(langs == lang)], order)]
                key, c = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array(c.astype(np.int64))], ["lang", "key", "c"])

    return docs.select("lang", "t").mapInArrow(run, "lang string, key long, c long").groupBy("lang", "key").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """Interpolated modified Kneser-Ney model of ``lang, key, c`` counts: rows ``lang, n, kind, key, value``.

    ``kind`` "p": log2 probability of a seen n-gram, already interpolated with all lower orders;
    ``kind`` "b": log2 weight of the lower orders after a seen context. Lower orders count distinct
    left neighbours. Each order takes its discounts for counts 1, 2, 3 and more from its own counts
    of counts, language by language. Counts, context sums and lower orders meet in joins sharded
    by (language, key).
    """
    grams = {order: counts}
    for n in range(order - 1, 0, -1):
        grams[n] = materialize(grams[n + 1].groupBy("lang", F.col("key").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("key")).agg(F.count(F.lit(1)).alias("c")), f"grams{n}")
    many = lambda x: F.sum(F.when(F.col("c") == x, 1).otherwise(0)).cast("double")
    lower, out = None, []
    for n in range(1, order + 1):
        of = grams[n].groupBy("lang").agg(*[many(i).alias(f"t{i}") for i in (1, 2, 3, 4)])
        y = F.when(F.col("t1") > 0, F.col("t1") / (F.col("t1") + 2 * F.col("t2"))).otherwise(0.5)
        rate = lambda i: F.when(F.col(f"t{i}") > 0, i - (i + 1) * y * F.col(f"t{i + 1}") / F.col(f"t{i}")).otherwise(0.5 * i)
        of = of.select("lang", *[F.least(F.greatest(rate(i), F.lit(0.1)), F.lit(0.95 * i)).alias(f"d{i}") for i in (1, 2, 3)])
        own = grams[n].withColumn("ctx", F.shiftright("key", 8))
        sums = own.groupBy("lang", "ctx").agg(F.sum("c").cast("double").alias("total"), many(1).alias("n1"), many(2).alias("n2"), F.sum(F.when(F.col("c") >= 3, 1).otherwise(0)).cast("double").alias("n3"))
        sums = sums.join(of, "lang").withColumn("weight", (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total"))
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        p = own.join(sums, ["lang", "ctx"]).withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)))
        if lower is None:
            p = p.withColumn("below", F.lit(1.0 / 256))
        else:
            p = p.join(lower.select("lang", F.col("key").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
        lower = materialize(p.select("lang", "key", ((F.col("c") - cut) / F.col("total") + F.col("weight") * F.col("below")).alias("p")), f"model{n}")
        out.append(lower.select("lang", F.lit(n).alias("n"), F.lit("p").alias("kind"), "key", F.log2("p").alias("value")))
        out.append(sums.select("lang", F.lit(n).alias("n"), F.lit("b").alias("kind"), F.col("ctx").alias("key"), F.log2("weight").alias("value")))
    model = out[0]
    for x in out[1:]:
        model = model.unionByName(x)
    return model


class Lookup:
    """Read-only hash table from 64-bit keys to 32-bit floats, probed for whole arrays at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.float32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == -1
            go = left[free]
            self.keys[slot[go]] = keys[go]  # of several for one slot the last one stays
            won = self.keys[slot[left]] == keys[left]
            self.values[slot[left[won]]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found); 0 where a key is missing."""
        slot = self._slot(keys)
        at = self.keys[slot]
        found = at == keys
        values = np.where(found, self.values[slot], np.float32(0))
        left = np.flatnonzero(~found & (at != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slot[left]]
            hit = at == keys[left]
            values[left[hit]] = self.values[slot[left[hit]]]
            found[left[hit]] = True
            left = left[~hit & (at != -1)]
        return values, found


def _tag(lang: np.ndarray | int, n: int, kind: str) -> np.ndarray | int:
    return (lang << 48) | ((2 * n + (kind == "b")) << 42)


class Scorer:
    """Sums log2 probabilities of texts with a whole model in memory."""

    def __init__(self, langs: list[str], order: int, keys: np.ndarray, values: np.ndarray):
        self.langs, self.order, self.table = {x: i for i, x in enumerate(langs)}, order, Lookup(keys, values)

    def bits(self, keys: np.ndarray, lang: int) -> np.ndarray:
        total = np.zeros(len(keys), np.float32)
        left = np.arange(len(keys))
        for n in range(self.order, 0, -1):
            key = keys[left] & ((1 << 8 * n) - 1)
            p, found = self.table.get(key | _tag(lang, n, "p"))
            total[left] -= p
            left, key = left[~found], key[~found]
            weight, _ = self.table.get((key >> 8) | _tag(lang, n, "b"))
            total[left] -= weight
        total[left] += 8
        return total

    def score(self, langs: list[str | None], texts: list[str | None]) -> tuple[list[int], list[float | None]]:
        n, out = [0] * len(texts), [0.0] * len(texts)
        by: dict[int, tuple[list[int], list[np.ndarray]]] = {}
        for i, raw in _padded(texts, self.order):
            n[i] += len(raw) - self.order + 1
            if (lang := self.langs.get(langs[i])) is None:
                out[i] = None
            elif len(raw) >= self.order:
                by.setdefault(lang, ([], []))
                by[lang][0].append(i)
                by[lang][1].append(gram_keys(raw, self.order))
        for lang, (rows, keys) in by.items():
            ends = np.cumsum([0, *map(len, keys)])
            bits = np.concatenate([[0.0], np.cumsum(self.bits(np.concatenate(keys), lang), dtype=np.float64)])
            for i, x in zip(rows, np.diff(bits[ends]).tolist(), strict=True):
                out[i] += x
        return n, out


def score_in_memory(docs: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """``k, lang, n, bits`` of documents ``k, lang, t``; the model goes to every executor."""
    langs = sorted(r["lang"] for r in model.select("lang").distinct().collect())  # a row a model
    number = F.element_at(F.create_map(*[x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i).cast("long"))]), F.col("lang")) if langs else F.lit(0).cast("long")
    tag = F.shiftleft(number, 48).bitwiseOR(F.shiftleft((2 * F.col("n") + F.when(F.col("kind") == "b", 1).otherwise(0)).cast("long"), 42))
    rows = model.select(F.col("key").bitwiseOR(tag).alias("key"), F.col("value").cast("float").alias("value")).toArrow()
    sent = docs.sparkSession.sparkContext.broadcast((langs, order, rows.column("key").to_numpy(), rows.column("value").to_numpy()))
    del rows
    made: list[Scorer] = []
    kinds = dict(docs.dtypes)["k"]

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in slices(batches, "t", 1 << 20):
            if not made:
                made.append(Scorer(*sent.value))
            n, bits = made[0].score(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(bits, pa.float64())], ["k", "lang", "n", "bits"])

    return docs.select("k", "lang", "t").mapInArrow(run, f"k {kinds}, lang string, n long, bits double")


def score_by_join(docs: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """The same scores by joins sharded by n-gram, for models too large to send.

    Each document's n-grams are counted first. A distinct n-gram is scored once: what an order knows leaves
    with its score, the others go on to the next lower one. Scores then meet the documents' counts; n-grams
    that many documents hold are sent to these instead of being gathered.
    """
    kinds = dict(docs.dtypes)["k"]

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in slices(batches, "t"):
            ks, langs, texts = batch.column(0), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            hashes = batch.column(2).to_pylist()
            for i, raw in _padded(texts, order):
                key, c = np.unique(gram_keys(raw, order), return_counts=True)
                m = max(1, len(key))  # a text without n-grams is a row without a key
                yield pa.RecordBatch.from_arrays(
                    [ks.take(pa.array([i] * m)), pa.array([langs[i]] * m, pa.string()), pa.array([hashes[i]] * m, pa.int64()), pa.array(key if len(key) else [None], pa.int64()), pa.array(c if len(key) else [0], pa.int64())],
                    ["k", "lang", "row", "key", "c"],
                )

    rows = docs.select("k", "lang", F.monotonically_increasing_id().alias("row"), "t").mapInArrow(run, f"k {kinds}, lang string, row long, key long, c long")
    rows = materialize(rows, "document-grams")
    langs = materialize(model.select("lang").distinct().withColumn("known", F.lit(True)), "known-languages")
    real = rows.where("key is not null and lang is not null").join(F.broadcast(langs.select("lang")), "lang", "left_semi")  # a row a model
    grams = materialize(real.groupBy("lang", "key").agg(F.count(F.lit(1)).alias("size")), "grams")
    open_, done = grams.withColumn("value", F.lit(0.0)), None
    for n in range(order, 0, -1):
        p = model.where((F.col("n") == n) & (F.col("kind") == "p")).select("lang", F.col("key").alias("g"), F.col("value").alias("pv"))
        b = model.where((F.col("n") == n) & (F.col("kind") == "b")).select("lang", F.col("key").alias("ctx"), F.col("value").alias("bv"))
        step = open_.withColumn("g", F.col("key").bitwiseAND(F.lit((1 << 8 * n) - 1))).withColumn("ctx", F.shiftright("g", 8))
        step = materialize(step.join(p, ["lang", "g"], "left"), f"order{n}")
        known = step.where("pv is not null").select("lang", "key", "size", (F.col("value") - F.col("pv")).alias("value"))
        done = known if done is None else done.unionByName(known)
        open_ = step.where("pv is null").join(b, ["lang", "ctx"], "left").select("lang", "key", "size", (F.col("value") - F.coalesce("bv", F.lit(0.0))).alias("value"))
    scored = materialize(done.unionByName(open_.withColumn("value", F.col("value") + 8.0)), "gram-scores")
    bits = join_heavy(real, scored, ["lang", "key"], "size").groupBy("row").agg(F.sum(F.col("c") * F.col("value")).alias("bits"))
    out = rows.groupBy("row").agg(F.first("k").alias("k"), F.first("lang").alias("lang"), F.sum("c").alias("n")).join(bits, "row", "left").join(F.broadcast(langs), "lang", "left")
    return out.select("k", "lang", "n", F.when(F.col("known"), F.coalesce("bits", F.lit(0.0))).alias("bits"))


def _fold(k: Column, folds: int, salt: int) -> Column:
    return F.pmod(F.xxhash64(k, F.lit(salt)), F.lit(folds)).cast("string")


#: The pooled model's name; a language's own is "l" and the language.
POOLED = "p"


def cross_models(texts: DataFrame, folds: int, pooled: bool, order: int) -> DataFrame:
    """Models of trusted texts ``fold, home, t``: rows as of ``kneser_ney``, ``lang`` being "fold:home".

    The model "all:home" counts all texts of a home, "3:home" all but those in fold 3. The pooled home
    takes the texts of every home. Each text is read and counted once, whatever the number of folds.
    """
    counts = count_grams(texts.select(F.concat_ws(":", "fold", "home").alias("lang"), "t"), order)
    at = F.split("lang", ":", 2)
    counts = counts.select(at[0].alias("fold"), F.explode(_homes(at[1], pooled)).alias("home"), "key", "c")
    models = F.array_remove(F.array(*[F.lit(str(m)) for m in ("all", *range(folds))]), F.col("fold"))
    counts = counts.select(F.explode(models).alias("m"), "home", "key", "c").groupBy(F.concat_ws(":", "m", "home").alias("lang"), "key").agg(F.sum("c").alias("c"))
    return materialize(kneser_ney(materialize(counts, "counts"), order), "model")


def _homes(home: Column, pooled: bool) -> Column:
    return F.when(F.lit(pooled) & (home != POOLED), F.array(home, F.lit(POOLED))).otherwise(F.array(home))


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 5, folds: int = 2, quantile: float = 0.999, margin: float = 1.1, prior_bytes: int = 100, broadcast_rows: int = BROADCAST_ROWS, least: int = 20) -> DataFrame:
    """``id_col, lang, n_bytes, perplexity, threshold, kept, text_hash`` for each row of ``docs``.

    ``trusted`` holds the ids of trusted documents (column ``id_col``). All their text trains a byte
    n-gram model for each language, by which all other documents are scored. Trusted documents are
    dealt into ``folds`` parts; each part is scored by models of the other parts, so every one of them
    counts in its language's threshold: ``margin`` times the ``quantile`` of their bits a byte. Bits a
    byte are drawn to the language's mean with the weight of ``prior_bytes`` bytes, so a short text is
    rejected only if it is very odd. ``perplexity`` is 2 to the bits a byte.

    A language with fewer than ``least`` trusted texts, and texts of null language, are judged by one
    model of all trusted texts. Their threshold is that of the languages with ``least`` or more (of all,
    where there are none) under this model, or of the language's own trusted texts if that is higher. Counts, discounts and thresholds cover all documents. A model is
    sent to the executors while it has at most ``broadcast_rows`` rows, and joined by shuffle beyond,
    with the same scores. A text of a language without any trusted text has no perplexity and is kept;
    so is an empty or null text. With a single trusted text in all there is nothing to hold out, and all
    is kept. Null and repeated ids pass through; empty tables give no rows; other columns are not read.
    """
    own = docs.select(docs[id_col].alias("k"), docs[lang_col].alias("lang"), text_hash(docs[text_col]).alias("r"), docs[text_col].alias("t"))
    good = trusted.select(F.col(id_col).alias("g")).where("g is not null").distinct()
    good = materialize(good, "trusted")
    few = F.broadcast(good) if good.count() <= SMALL_ROWS else good
    texts = materialize(own.join(few, own["k"] == few["g"], "left_semi").withColumn("some", F.octet_length("t") > 0), "trusted-texts")
    ids, salt = texts.where("some").select("lang", "k").distinct(), 0
    while True:
        seen = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.collect_set(_fold(F.col("k"), folds, salt)).alias("in"))
        seen = seen.collect()  # a row a language
        if len({f for r in seen for f in r["in"]}) != 1 or sum(r["n"] for r in seen) < 2 or salt > 99:
            break
        salt += 1  # all in one part: deal the few there are again
    whole = [r["lang"] for r in seen if r["lang"] is not None and r["n"] >= least and len(r["in"]) > 1]
    small = [r["lang"] for r in seen if r["lang"] is not None and r["lang"] not in whole]
    pooled = bool(small) or not own.where("lang is null").isEmpty()
    home = F.when(F.col("lang").isNull() | F.col("lang").isin(small), POOLED).when(F.col("lang").isin(whole), F.concat(F.lit("l"), "lang"))

    texts = texts.withColumns({"fold": _fold(F.col("k"), folds, salt), "home": home})
    models = cross_models(texts.where("home is not null"), folds, pooled, order)
    row = F.struct("k", "lang", "r").alias("k")
    rest = own.join(few, own["k"] == few["g"], "left_anti").select(row, F.concat(F.lit("all:"), home).alias("lang"), "t")
    held = texts.select(row, "fold", F.explode(_homes(F.col("home"), pooled)).alias("home"), "t")
    scores = None
    for m in ("all", *map(str, range(folds))):
        part = rest if m == "all" else held.where(F.col("fold") == m).select("k", F.concat("fold", F.lit(":"), "home").alias("lang"), "t")
        model = models.where(F.col("lang").startswith(f"{m}:"))
        scorer = score_in_memory if model.count() <= broadcast_rows else score_by_join
        part = materialize(scorer(part, model, order), f"scores-{m}").select("k.k", "k.lang", "k.r", F.split("lang", ":", 2)[1].alias("home"), F.lit(m != "all").alias("held"), "n", "bits")
        scores = part if scores is None else scores.unionByName(part)

    held = scores.where(F.col("held") & (F.col("n") > 0) & F.col("bits").isNotNull())
    means = F.broadcast(materialize(held.groupBy("home").agg((F.sum("bits") / F.sum("n")).alias("mean")), "means"))  # a row a model
    drawn = (F.col("bits") + prior_bytes * F.col("mean")) / (F.col("n") + prior_bytes)
    high = F.percentile_approx("rate", F.lit(quantile), F.lit(10_000)) * margin
    rates = held.join(means, "home").withColumn("rate", drawn)
    # the odd texts of small languages must not loosen the pooled threshold for the others
    base = rates.where((F.col("home") != POOLED) | F.col("lang").isin(whole)) if whole else rates
    limits = F.broadcast(materialize(base.groupBy("home", "mean").agg(high.alias("limit")), "limits"))  # a row a model
    of = F.broadcast(materialize(rates.where(F.col("home") == home).groupBy(F.col("lang").alias("of")).agg(high.alias("least")), "own-limits"))  # a row a language
    all_rows = scores.where(F.col("home").eqNullSafe(home)).join(limits, "home", "left").join(of, F.col("lang").eqNullSafe(F.col("of")), "left")
    all_rows = all_rows.withColumns({"rate": drawn, "limit": F.when(F.col("limit").isNotNull(), F.greatest("limit", "least"))})
    return all_rows.select(
        F.col("k").alias(id_col), "lang", F.col("n").alias("n_bytes"), F.pow(F.lit(2.0), F.col("bits") / F.when(F.col("n") > 0, F.col("n"))).alias("perplexity"),
        F.pow(F.lit(2.0), "limit").alias("threshold"), (F.col("rate").isNull() | (F.col("n") == 0) | (F.col("rate") <= F.col("limit"))).alias("kept"), F.col("r").alias("text_hash"),
    )


def drop_low_quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns.

    Rows are judged by their own texts, also where an id repeats; rows with a null id, or a null or empty
    text, stay; without trusted texts, and with an empty table, nothing goes.
    """
    bad = classify(docs, trusted, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias("k"), F.col("text_hash").alias("r"))
    return without_rows(docs, bad, id_col, text_col)
