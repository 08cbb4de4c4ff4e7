"""The document operators against brute force, on small fixtures with nulls, empty texts, ties and odd columns."""

import functools
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gistset.llm import common, decontamination, exact_dedup, license_scan, line_dedup, near_dedup, packing, quality, substring_dedup, token_counts, token_files, tokenizing

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n long"
ODD = ["", " ", "  a  b\n\n c\t d ", "x <|endoftext|> y<|endoftext|>", "a\x1cb \x1f c", "É é ́a ẞ Σας İ", "a​b　c", "don't they'll 'S I'm 12345", "a\r\n\r\nb", "🙂🙂 🙂", "<|startoftext|>hi", "z" * 5000]


def docs(spark):
    rnd = random.Random(7)
    words = ["alpha", "beta", "Gamma", "delta", "über", "omega", "the", "of", "kappa", "sigma"]
    make = lambda n: " ".join(rnd.choice(words) + str(rnd.randrange(50)) for _ in range(n))
    long = make(3000)
    shared = make(40)
    texts = [*ODD, long, long, long + " tail", shared, "head " + shared + " one", "two\n" + shared, "cc by CC  by", "All rights reserved. general public license", None, None]
    texts += ["same line of text here\nown %d\n  SAME line of text here " % i for i in range(4)] + [make(60) for _ in range(20)]
    rows = [(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.fixture(scope="module")
def fixture(spark):
    df, rows = docs(spark)
    return df.repartition(3).cache(), {r[0]: r[1] for r in rows}


@functools.cache
def loaded(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def library(path, text):
    return loaded(path).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_library_on_odd_signs(path):
    rnd = random.Random(2)
    signs = list("abS'tsT re1!?\n \t\x1cİΣ\u0301 \u3000\xad\xe9\xdf\u2013\u4e2d\u3042\u0436") + ["<|endoftext|>", "  <|startoftext|>"]
    texts = ["".join(rnd.choices(signs, k=rnd.randint(0, 14))) for _ in range(2000)]
    want = [library(path, t) for t in texts]
    got = tokenizing.ChunkEncoder(path, most=50).encode(texts)
    counter = token_counts.TokenCounter(path)
    for t, w, g in zip(texts, want, got, strict=True):
        assert g == b"".join(i.to_bytes(4, "little") for i in w), ascii(t)
        assert counter.count(t) == len(w), ascii(t)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_library_on_words_and_blanks(path):
    rnd = random.Random(5)
    parts = [" "] * 6 + ["  ", "\n", " \n", "\n ", "\r\n", "\xa0", "\u3000", "foo", "Bar", "don't", "'ll", ",", ".", "?!", "12", "é", "naïve", "Привет", "漢字", "İ", "e\u0301", "٣", "x" * 70, "<|endof", "<|endoftext|>"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(4000)]
    got = tokenizing.ChunkEncoder(path, most=50, longest=8).encode(texts)
    for t, g in zip(texts, got, strict=True):
        assert g == b"".join(i.to_bytes(4, "little") for i in library(path, t)), ascii(t)


def test_token_files(spark, fixture):
    df, texts = fixture
    path = common.new_path(spark, "t")
    token_files.write_tokens(df, path, BYTE)
    got = {r["doc_id"]: r for r in token_files.with_crc32(token_files.read_tokens(spark, path), ["doc_id", "start", "n_tokens"]).collect()}
    start = 0
    for k in sorted(texts):
        ids = [*library(BYTE, texts[k]), 0]
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    assert token_files.lookup(spark, path, [3]).first()["ids"][:-1] == library(BYTE, texts[3])


def test_token_counts(fixture):
    df, texts = fixture
    got = {r["doc_id"]: r for r in token_counts.count_tokens(df, WORD).collect()}
    for k, t in texts.items():
        n = len(library(WORD, t))
        assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len((t or "").encode()), n, n > 2048)


def test_packing(fixture):
    df, texts = fixture
    packed = packing.pack(df, WORD, size=256)
    rows = packed.collect()
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    for k, t in texts.items():
        ids = [i for r in sorted(by[k], key=lambda r: r["start"]) for i in r["ids"]]
        assert ids == [*library(WORD, t), 1] and {r["doc_tokens"] for r in by[k]} == {len(ids)}
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    total = sum(r["length"] for r in rows)
    assert len(seqs) <= total / 256 * 1.1 + 2
    for r in packing.sequences(packed, 256).collect():
        assert len(r["ids"]) == 256 or r["n_tokens"] & (r["n_tokens"] - 1) == 0


def test_best_fit_plan():
    rnd = random.Random(2)
    for _ in range(50):
        size = rnd.choice([16, 31, 64])
        counts = {n: rnd.randrange(1, 9) for n in rnd.sample(range(1, size), 8)}
        used = {}
        for length, a, b, first, each, off in packing.plan(counts, size):
            for r in range(a, b):
                used.setdefault(first + (r - a) // each, []).append((off + (r - a) % each * length, length))
        assert sorted(n for w in used.values() for _, n in w) == sorted(n for n, c in counts.items() for _ in range(c))
        plain = []  # one piece at a time
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fit = [w for w in plain if w[0] >= n]
            w = min(fit, key=lambda w: w[0]) if fit else [size]
            if not fit:
                plain.append(w)
            w[0] -= n
        assert len(plain) == len(used) and sorted(size - w[0] for w in plain) == sorted(sum(n for _, n in w) for w in used.values())
        for w in used.values():
            assert [o for o, _ in sorted(w)] == [sum(n for _, n in sorted(w)[:i]) for i in range(len(w))]


def test_exact_dedup_both_ways(fixture):
    import re

    df, texts = fixture
    norm = {k: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for k, t in texts.items()}
    groups = {}
    for k in sorted(norm):
        groups.setdefault(norm[k], []).append(k)
    for digest in ("all", "survivors"):
        for r in exact_dedup.exact_groups(df, digest=digest).collect():
            g = groups[norm[r["doc_id"]]]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (g[0], len(g), r["doc_id"] == g[0])
            if digest == "all":
                assert r["text_sha256"] == hashlib.sha256(norm[r["doc_id"]].encode()).hexdigest()
    assert {r["doc_id"] for r in exact_dedup.drop_exact_duplicates(df).collect()} == {g[0] for g in groups.values()}


def test_line_dedup(fixture):
    df, texts = fixture
    strip, lower = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(strip).translate(lower)
    first = {}
    for k in sorted(texts):
        for x in (texts[k] or "").split("\n"):
            first.setdefault(key(x), k)
    for r in line_dedup.dedup_lines(df).collect():
        own = (texts[r["doc_id"]] or "").split("\n")
        kept = [x for x in own if len(key(x)) < 10 or first[key(x)] == r["doc_id"]]
        assert (r["n_lines"], r["n_dropped"], r["kept_text"]) == (len(own), len(own) - len(kept), "\n".join(kept))


def test_decontamination(spark, fixture):
    df, texts = fixture
    words = {k: [w.decode() for w in common.words_of(t)] for k, t in texts.items()}
    pick = [k for k in texts if len(words[k]) > 30][:3]
    items = [(1, " ".join(words[pick[0]][3:20])), (2, "alpha1 nowhere"), (3, None), (4, "CC by"), (10, " ".join(words[pick[1]][5:18])), (5, "by")]
    found = decontamination.judge(decontamination.phrase_matches(df, spark.createDataFrame(items, "item_id long, text string")))
    for r in found.collect():
        w, hit, own = words[r["doc_id"]], set(), set()
        for i, t in items:
            q = [x.decode() for x in common.words_of(t)]
            m = min(13, len(q))
            for j in range(max(1, len(q) - 12) if q else 0):
                for s in range(len(w) - m + 1):
                    if w[s : s + m] == q[j : j + m]:
                        hit |= set(range(s, s + m))
                        own.add(str(i))
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (len(w), len(hit), sorted(own), bool(hit) and 20 * len(hit) >= len(w))


def test_proximity(spark):
    """Places of all words within the slop, some missing, against brute force over every start."""
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(6)]
    items = [(1, "rare1 w0 w1 w1 w2 rare2 w3"), (2, "w4 unseen w5 rare1"), (3, "w0 w0 w0")]
    texts = ["rare1 x x x x rare2", "rare1 w0 w1 w1 w2 other w3", "rare1 w0 w1 w2 rare2 w3", None, "", "w4 w5 rare1", "w0"]
    texts += [" ".join(rnd.choices([*words, "rare1", "rare2"], k=25)) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given = spark.createDataFrame(items, "item_id long, text string")

    def most(w, q, s, slop):  # largest number of window words with a place of their own
        return sum(match(w, [j for j in range(len(q)) if q[j] == x], x, s, slop) for x in set(q))

    def match(w, js, x, s, slop, used=frozenset()):
        if not js:
            return 0
        free = [p for p in range(max(0, s + js[0] - slop), min(len(w), s + js[0] + slop + 1)) if w[p] == x and p not in used]
        return max([match(w, js[1:], x, s, slop, used), *(1 + match(w, js[1:], x, s, slop, used | {p}) for p in free)])

    for slop, missing in ((0, 0), (2, 0), (1, 1), (2, 3)):
        want = set()
        for k, t in enumerate(texts):
            w = (t or "").split()
            for _, item in items:
                q = item.split()
                lens = [q[j : j + 5] for j in range(max(1, len(q) - 4))]
                for win in lens:
                    for s in range(-12, len(w) + 12):
                        n = most(w, win, s, slop)
                        if n and len(win) - n <= missing:
                            want.add((k, s, len(win) - n, tuple(win)))
        rows = decontamination.proximity_matches(df, given, slop, size=5, missing=missing).collect()
        got = {(r["doc_id"], r["start"], r["n_missing"], tuple(r["window"])) for r in rows}
        assert got == want and len(rows) == len(want) and (missing == 0 or want)


def test_substring_dedup(fixture):
    df, texts = fixture
    width, first, want = 50, {}, {}
    for k in sorted(texts):
        raw = (texts[k] or "").encode()
        for j in range(len(raw) - width + 1):
            first.setdefault(raw[j : j + width], k)
    for k, t in texts.items():
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for j in range(len(raw) - width + 1):
            if first[raw[j : j + width]] < k:
                gone[j : j + width] = b"\1" * width
        want[k] = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
    for hot in (1, 50_000):
        got = {r["doc_id"]: bytes(r["kept"]) for r in substring_dedup.remove_repeats(df, hot_texts=hot).collect()}
        assert got == want


def linked(rows):
    """Brute force: each id's smallest linked id over all pairs."""
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := common.words_of(t)) else set() for i, t in rows}
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in label}


def test_near_dedup(spark):
    rnd = random.Random(11)
    base = [[f"w{rnd.randrange(10**6)}" for _ in range(120)] for _ in range(6)]
    rows, k = [], 0
    for b in base:
        for j in range(12):
            w = list(b)
            for _ in range(j % 4):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
            rows.append((k, " ".join(w)))
            k += 1
    rows += [(k, None), (k + 1, "!!"), (k + 2, "??"), (k + 3, "one two"), (k + 4, "One, two.")]
    want = linked(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_near_dedup_of_one_large_group(spark, monkeypatch):
    """Copies of one text, most of them too far from each other, in the same buckets."""
    monkeypatch.setattr(near_dedup, "_PAIRS_TOGETHER", 2)
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(k % 9):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        rows.append((k if k else 1000, " ".join(w)))
    want = linked(rows)
    assert 5 < len(set(want.values())) < 80
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_prob_minhash_estimates_probability_jaccard():
    import numpy as np

    a = {i: 1.0 + i % 3 for i in range(300)}
    b = {i: 1.0 + (i + i // 150) % 3 for i in range(100, 400)}
    e = np.array([*a, *b], np.uint64)
    sig = near_dedup.prob_minhash(near_dedup.mix(e + np.uint64(1)), np.array([*a.values(), *b.values()]), np.repeat([0, 1], 300), 2, 4096)
    want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in {*a, *b}) for i in {*a} & {*b})
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / 4096) ** 0.5


def test_licenses(fixture):
    df, texts = fixture
    phrases = {p: [w.encode() for w in p.split()] for p in license_scan.PHRASES}
    for r in license_scan.scan_licenses(df).collect():
        w = common.words_of(texts[r["doc_id"]])
        at = [(i, p) for p, q in phrases.items() for i in range(len(w)) if w[i : i + len(q)] == q]
        places = [i for i, _ in at]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted({license_scan.PHRASES[p] for _, p in at})) and 0 <= r["score"] <= 1
    found = license_scan.LicenseScanner(license_scan.PHRASES, license_scan.TEMPLATES).scan("x " + license_scan.TEMPLATES["mit"].replace("and associated", "and all associated") + " y")
    assert found["labels"] == ["mit"] and found["score"] > 0.9


def test_license_chains_equal_brute_force():
    """Templates broken into many spans, with words replaced, added, dropped and repeated, against all chains of all spans."""
    rnd = random.Random(3)
    mit = license_scan.TEMPLATES["mit"].split()
    scan = license_scan.LicenseScanner({}, {"mit": " ".join(mit)}).scan
    broken = scan(" ".join(f"x{i}" if i % 5 == 4 else w for i, w in enumerate(mit)))
    assert (broken["labels"], broken["spans"], broken["score"]) == (["mit"], [("mit", 0, 29, 24 / 29)], 24 / 29)
    many = 0
    for _ in range(200):
        text = []
        for _ in range(rnd.randint(1, 12)):
            a = rnd.randrange(len(mit))
            text += mit[a : a + rnd.randint(2, 9)] + [f"x{rnd.randrange(9)}"] * rnd.choice([0, 1, 3, 11, 12, 13])
        runs = [(i, j, n) for i in range(len(text)) for j in range(len(mit)) for n in range(4, len(mit) + 1) if text[i : i + n] == mit[j : j + n] and i + n <= len(text) and j + n <= len(mit)]
        # maximal in the text: no longer run covers it
        runs = [(i, j, n) for i, j, n in runs if not any(a <= i and i + n <= a + m and m > n for a, _, m in runs)]
        best, ends = (0, 0, 0), []
        for i, j, n in sorted(runs, key=lambda x: x[0] + x[2]):
            all_chains = {(n, i)}
            for a, b, m, chains in ends:
                if 0 <= i - a - m <= 12 and b + m <= j:
                    all_chains |= {(c + n, first) for c, first in chains}
            ends.append((i, j, n, all_chains))
            best = max(best, *((c, first, i + n) for c, first in all_chains))
        many += best[0] >= 16
        got = scan(" ".join(text))
        assert got["score"] == best[0] / len(mit)
        assert got["spans"] == ([("mit", best[1], best[2], best[0] / len(mit))] if best[0] / len(mit) >= 0.5 else [])
    assert many > 10


def test_quality(spark):
    rnd = random.Random(4)
    good = lambda: " ".join(rnd.choice(["river", "stone", "walks", "under", "green", "light"]) for _ in range(60))
    rows = [(i, good(), "en", "s", 1) for i in range(120)] + [(200, "QX!!ZV## JJ%%" * 20, "en", "s", 1), (201, None, "en", "s", 1), (202, "bonjour", "fr", "s", 1), (203, good(), None, "s", 1), (None, good(), "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    trusted = spark.createDataFrame([(i,) for i in range(100)], "doc_id long")
    one = {r["doc_id"]: r for r in quality.classify(df, trusted, order=3).collect()}
    assert {k for k, r in one.items() if not r["kept"]} == {200} and one[202]["perplexity"] is None and one[201]["perplexity"] is None
    two = {r["doc_id"]: r for r in quality.classify(df, trusted, order=3, broadcast_rows=0).collect()}
    assert all((r["perplexity"] is None and one[k]["perplexity"] is None) or abs(r["perplexity"] - one[k]["perplexity"]) < 1e-3 for k, r in two.items())


def test_quality_of_languages_with_few_trusted_texts(spark):
    """Junk goes in languages with 4 and 8 trusted texts and in none; each trusted text counts and stays."""
    rnd = random.Random(9)
    words = {"en": ["river", "stone", "walks", "under"], "de": ["fluss", "stein", "unter", "gr\u00fcn"], "ja": ["\u5ddd\u306f", "\u77f3\u3068", "\u6b69\u304f", "\u7dd1"]}
    text = lambda x: " ".join(rnd.choice(words[x]) for _ in range(60))
    junk = lambda: "".join(chr(rnd.randrange(33, 127)) for _ in range(400))
    rows = [(i, text("en" if i < 100 else "de" if i < 200 else "ja"), "en" if i < 100 else "de" if i < 200 else "ja", "s", 1) for i in (*range(60), *range(100, 110), *range(200, 210))]
    rows += [(300, junk(), "en", "s", 1), (301, junk(), "de", "s", 1), (302, junk(), None, "s", 1), (303, text("en"), None, "s", 1), (304, junk(), "ja", "s", 1)]
    trusted = spark.createDataFrame([(i,) for i in (*range(50), *range(100, 104), *range(200, 208))], "doc_id long")
    got = {r["doc_id"]: r for r in quality.classify(spark.createDataFrame(rows, SCHEMA).repartition(3), trusted, order=3).collect()}
    assert len(got) == len(rows) and {k for k, r in got.items() if not r["kept"]} == {300, 301, 302, 304}
    assert all(r["threshold"] is not None for r in got.values())
    only = spark.createDataFrame([r for r in rows if r[2] == "de"], SCHEMA)
    two = spark.createDataFrame([(100,), (101,)], "doc_id long")  # two trusted texts in all, in one part unless dealt again
    one = next(n for n in range(2, 99) if len({r[0] for r in spark.range(100, 102).select(quality._fold(F.col("id"), n, 0)).collect()}) == 1)
    got = {r["doc_id"]: r for r in quality.classify(only, two, order=3, folds=one).collect()}
    assert {k for k, r in got.items() if not r["kept"]} == {301} and got[100]["threshold"] is not None


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup.exact_groups(df).count() == line_dedup.dedup_lines(df).count() == near_dedup.near_duplicates(df).count() == substring_dedup.remove_repeats(df).count() == packing.pack(df, WORD).count() == 0
    assert decontamination.phrase_matches(df, items).count() == quality.classify(df, df.select("doc_id")).count() == token_counts.count_tokens(df, WORD).count() == license_scan.scan_licenses(df).count() == 0
    path = common.new_path(spark, "t")
    token_files.write_tokens(df, path, BYTE)
    assert token_files.read_tokens(spark, path).count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f g " * 9), (1, "a b c d e f g " * 9), (1, "a b c d e f g " * 9), (2, "a b c d e f g " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert exact_dedup.exact_groups(df).count() == line_dedup.dedup_lines(df).count() == near_dedup.near_duplicates(df).count() == substring_dedup.remove_repeats(df).count() == packing.pack(df, WORD).count() == 4
    assert decontamination.phrase_matches(df, spark.createDataFrame([(1, "a b c d e f g a b c d e f g")], "item_id long, text string")).where(F.size("matches") > 0).count() == 4


@pytest.fixture
def large_paths(monkeypatch):
    """Every table counts as large, every key as heavy."""
    monkeypatch.setattr(common, "SENT_BYTES", 0)
    monkeypatch.setattr(common, "HEAVY_ROWS", 2)
    monkeypatch.setattr(near_dedup, "_BLOCK", 3)


LINES = ["the first of several lines that recur", "another line which is long enough", "short", "some line found here only %d"]


def repeated(spark):
    """Ids on two texts, one of which has a smaller twin; null ids; a column of each name that the operators use."""
    rnd = random.Random(3)
    make = lambda n: " ".join(f"w{rnd.randrange(10**5)}" for _ in range(n))
    a, b, c = make(80), make(80), make(80)
    rows = [(1, a), (5, a), (5, b), (None, a), (None, None), (7, None), (7, c), (7, c), (9, c + " tail"), (9, make(90)), (11, ""), (11, "  ")]
    rows += [(20 + i, "\n".join([LINES[0], LINES[1], LINES[2], LINES[3] % i, make(60)])) for i in range(3)] + [(20, LINES[1] + "\n" + make(60) + " " + " ".join(a.split()[:30]))]
    names = "doc_id long, text string, lang string, source string, k long, t string, r long, n long, h long, v long, ids string, length long, start long, pos long, term string, size long, part int, word string, gone_k long"
    return spark.createDataFrame([(k, t, "en", "s", 1, "t", 2, 3, 4, 5, "ids", 6, 7, 8, "x", 9, 0, "w", 1) for k, t in rows], names), rows


def kept_rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_drops_go_by_id_and_text(spark):
    df, rows = repeated(spark)
    c = rows[6][1]
    gone = [(5, rows[0][1])]
    without = lambda gone: sorted([r for r in rows if r not in gone], key=repr)
    assert kept_rows(exact_dedup.drop_exact_duplicates(df)) == without([*gone, (11, "")])  # the empty text is also (7, null)'s
    assert kept_rows(near_dedup.drop_near_duplicates(df)) == without([*gone, (9, c + " tail")])
    items = spark.createDataFrame([(1, " ".join(rows[0][1].split()[:13]))], "item_id long, text string")
    assert kept_rows(decontamination.drop_contaminated(df, items)) == without([(1, rows[0][1]), (5, rows[0][1]), (20, rows[-1][1])])
    junk = spark.createDataFrame([(5, "#!%&" * 200, "en"), *[(k, t, "en") for k, t in rows]], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(1,), (7,), (9,), (20,), (21,)], "doc_id long")
    assert kept_rows(quality.drop_low_quality(junk, trusted)) == sorted(rows, key=repr)


def test_large_paths_equal_small_ones(spark, large_paths, fixture):
    test_drops_go_by_id_and_text(spark)
    test_exact_dedup_both_ways(fixture)
    test_line_dedup(fixture)
    test_decontamination(spark, fixture)
    test_near_dedup(spark)


def test_near_dedup_by_weighted_shingles(spark):
    """Multisets against brute force; texts with equal sets and other counts are not alike."""
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(30)]
    rows = [(k, " ".join(base * rnd.randint(1, 6) + [f"x{rnd.randrange(4)}"] * rnd.randrange(5))) for k in range(30)]
    bags = {}
    for k, t in rows:
        w = common.words_of(t)
        for j in range(max(1, len(w) - 4)):
            bags.setdefault(k, {}).setdefault(tuple(w[j : j + 5]), []).append(j)
    size = {k: {s: len(v) for s, v in b.items()} for k, b in bags.items()}
    label = {k: k for k in size}
    pairs = [(a, b) for a in size for b in size if a < b and 5 * sum(min(size[a].get(s, 0), size[b].get(s, 0)) for s in {*size[a], *size[b]}) >= 4 * sum(max(size[a].get(s, 0), size[b].get(s, 0)) for s in {*size[a], *size[b]})]
    for _ in rows:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), weighted=True).collect()}
    assert got == label and 2 < len(set(label.values())) < 30


def test_perplexity_equals_plain_kneser_ney(spark):
    """Interpolated modified Kneser-Ney over bytes, written out in dictionaries, against both ways of scoring."""
    import math
    from collections import Counter

    rnd, order = random.Random(12), 3
    good = lambda: " ".join(rnd.choice(["river", "stone", "walks", "under", "green"]) for _ in range(12))
    train, other = [good() for _ in range(12)], [good(), "stone of a river", "xyz!", "stöne"]
    counts = {order: Counter()}
    for t in train:
        raw = bytes(order - 1) + t.encode()
        counts[order].update(raw[i : i + order] for i in range(len(raw) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    model = {}
    for n in counts:
        t = {i: sum(c == i for c in counts[n].values()) for i in (1, 2, 3, 4)}
        y = t[1] / (t[1] + 2 * t[2]) if t[1] else 0.5
        cut = {i: min(max(i - (i + 1) * y * t[i + 1] / t[i] if t[i] else 0.5 * i, 0.1), 0.95 * i) for i in (1, 2, 3)}
        after = {}
        for g, c in counts[n].items():
            after.setdefault(g[:-1], []).append(c)
        model[n] = (cut, after)

    def prob(g):
        if not g:
            return 1 / 256
        cut, after = model[len(g)]
        if g[:-1] not in after:
            return prob(g[1:])
        cs, c = after[g[:-1]], counts[len(g)].get(g, 0)
        return ((c - cut[min(c, 3)] if c else 0) + sum(cut[min(x, 3)] for x in cs) * prob(g[1:])) / sum(cs)

    def bits(t):
        raw = bytes(order - 1) + t.encode()
        return sum(-math.log2(prob(raw[i : i + order])) for i in range(len(raw) - order + 1))

    texts = spark.createDataFrame([("en", t) for t in train], "lang string, t string")
    built = common.materialize(quality.kneser_ney(quality.count_grams(texts, order), order), "m")
    df = spark.createDataFrame([(i, "en", t) for i, t in enumerate([*train, *other, ""])] + [(99, "fr", "a")], "k long, lang string, t string")
    for way in (quality.score_in_memory, quality.score_by_join):
        got = {r["k"]: (r["n"], r["bits"]) for r in way(df, built, order).collect()}
        assert got.pop(99)[1] is None and len(got) == len(train) + len(other) + 1
        for i, t in enumerate([*train, *other, ""]):
            assert got[i][0] == len(t.encode()) and math.isclose(got[i][1], bits(t), rel_tol=1e-6, abs_tol=1e-9)


def without_repeats(rows, width=50):
    """Brute force: what of each text stays."""
    first = {}
    for k, t in rows:
        raw = (t or "").encode()
        for j in range(len(raw) - width + 1 if k is not None else 0):
            first[raw[j : j + width]] = min(first.get(raw[j : j + width], k), k)
    out = []
    for k, t in rows:
        raw, gone = (t or "").encode(), set()
        for j in range(len(raw) - width + 1 if k is not None else 0):
            if first[raw[j : j + width]] < k:
                gone |= set(range(j, j + width))
        out.append((k, bytes(c for i, c in enumerate(raw) if i not in gone)))
    return sorted(out, key=repr)


def test_substrings_of_repeated_null_and_string_ids(spark, monkeypatch):
    _, rows = repeated(spark)
    text = lambda k: None if k is None else f"id{k:04d}"
    for given, kind in ((rows, "long"), ([(text(k), t) for k, t in rows], "string")):
        got = substring_dedup.remove_repeats(spark.createDataFrame(given, f"doc_id {kind}, text string")).collect()
        assert sorted(((r["doc_id"], bytes(r["kept"])) for r in got), key=repr) == without_repeats(given)
    monkeypatch.setattr(common, "SENT_BYTES", 0)
    monkeypatch.setattr(substring_dedup, "HOT_BYTES", 200)
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], bytes(r["kept"])) for r in got), key=repr) == without_repeats(rows)


def test_run_length_index_against_brute_force():
    import numpy as np

    rnd = random.Random(1)
    for size in (1, 3, 7, 40):
        seeds = ["".join(rnd.choices("ab\0", k=rnd.randint(0, 30))) for _ in range(4)]
        texts = list({"".join(rnd.choices([*seeds, "x", "y"], k=rnd.randint(0, 6))).encode() for _ in range(size)})
        owner = np.array([rnd.randrange(6) for _ in texts])
        got = substring_dedup.repeated_windows(texts, owner, 9)
        for t, o, g in zip(texts, owner, got, strict=True):
            windows = [t[j : j + 9] for j in range(len(t) - 8)]
            assert g.tolist() == [any(w in u and p < o for u, p in zip(texts, owner, strict=True)) for w in windows]
    periodic = [b"ab" * 400, b"ab" * 300 + b"c", b"a" * 500]
    assert substring_dedup.RunLengthIndex(periodic, 50).n_runs < 100  # far fewer than the 1,900 bytes


def test_lines_of_repeated_and_null_ids_and_of_a_long_text(spark, large_paths):
    """A key that fills several ranges, ids on two texts, and a text of 40,000 lines, every third of which goes."""
    _, rows = repeated(spark)
    long = [f"a line that is long enough {i % 3 and i}" for i in range(40_000)]
    rows = [*rows, (30, "\n".join(long)), (29, long[0]), *[(100 + i, long[0] + "\n" + LINES[0].upper()) for i in range(300)]]
    first = {}
    for k, t in rows:
        for x in (t or "").split("\n") if k is not None else ():
            key = x.strip(" \t").lower()
            first[key] = min(first.get(key, k), k)
    want = []
    for k, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if k is None or len(x.strip(" \t")) < 10 or first[x.strip(" \t").lower()] == k]
        want.append((k, len(own), len(own) - len(kept), "\n".join(kept)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_whole_licences(spark):
    """Whole texts, and texts with lines lost and words added, get their labels; a warranty clause alone gets none of them."""
    scan = license_scan.LicenseScanner(license_scan.PHRASES, license_scan.TEMPLATES).scan
    for name, text in license_scan.WHOLE.items():
        found = scan("intro words here " + text + " and more")
        assert name in found["labels"] and found["score"] == 1.0
        words = text.split()
        edited = scan(" ".join(w if i % 23 else w + " inserted" for i, w in enumerate(words[: len(words) * 3 // 4])))
        assert name in edited["labels"] and edited["score"] >= 0.5
    assert scan("the software is provided as is without warranty of any kind")["labels"] == []


def test_orc_files_have_indexes_and_bloom_filters(spark, fixture):
    """Files carry run-length encoding of integers, row indexes and Bloom filters on ids."""
    from pyarrow import orc

    path = common.new_path(spark, "t")
    token_files.write_tokens(fixture[0], path, BYTE)
    import glob

    files = [orc.ORCFile(f) for f in glob.glob(path.removeprefix("file://") + "/*.orc")]
    assert files and sum(f.nrows for f in files) == len(fixture[1])
    assert all(f.row_index_stride == 10_000 and f.nstripes >= 1 for f in files if f.nrows)
    assert all(f.stripe_statistics_length > 0 for f in files if f.nrows)


def test_pipeline_equals_its_steps_by_brute_force(spark, tmp_path):
    """Exact and near copies, contaminated and junk documents go; every other one is packed whole."""
    import corpus_pipeline

    rnd = random.Random(21)
    make = lambda n: " ".join(rnd.choice(["river", "stone", "walks", "under", "green", "light"]) + rnd.choice("abcdef") for _ in range(n))
    rows = [(i, make(80)) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[4][1] + " tail"), (102, "#!%&" * 300), (103, None), (104, ""), (5, make(90)), (106, rows[7][1].replace(" ", "  "))]
    items = [(1, " ".join(rows[10][1].split()[5:30]))]
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    gone = {100, 101, 102, 104, 106, 10}  # 104 is empty like 103
    want = sorted((k, len(library(WORD, t)) + 1) for k, t in rows if k not in gone)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["doc_tokens"]) for r in got) == want
    texts = {(k, len(library(WORD, t)) + 1): t for k, t in rows}
    for r in got:
        ids = [*library(WORD, texts[r["doc_id"], r["doc_tokens"]]), 1][r["start"] : r["start"] + r["length"]]
        assert bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in ids)
