"""Benchmark decontamination over a positional inverted index of the training documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_JVM, ascii_lower, is_small, materialize, same_row, sent_if_small, text_hash, without_rows

#: Stands behind a document's last word in the index; no word of a text reads so.
END = "\x00"


def word_list(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD_JVM), F.lit(0))


def windows_of(items: DataFrame, size: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of ``size`` consecutive item words: ``window, m, items``.

    A shorter item, but not one without words, is one window. ``items`` lists, as sorted strings,
    the ids of all items that hold the window. An item without an id, or with a null text, has no windows;
    texts under one id are one item.
    """
    words = items.where(items[id_col].isNotNull()).select(items[id_col].cast("string").alias("item"), word_list(items[text_col]).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window"))
    return each.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items")).select("window", F.size("window").alias("m"), "items")


def build_index(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Positional inverted index of the training documents over the words that ``windows`` ask for.

    One scan: each document's words are numbered, and those of the test vocabulary go as postings
    ``term, k, r, pos`` into lists sorted by term, which are written once and serve every search. Behind
    each document's last word the index holds ``END``, so that its length is a posting too.
    Returns (postings, terms, lengths): terms ``word, term, c`` with the number of occurrences in all
    documents (0 where there are none), lengths ``k, r, n``, a row per row of ``docs``.
    """
    found = windows.select(F.explode("window").alias("word")).distinct()
    vocabulary = materialize(found.select("word", F.xxhash64("word").alias("term")), "vocabulary")
    asked = vocabulary.unionByName(docs.sparkSession.range(1).select(F.lit(END).alias("word"), F.lit(0).cast("long").alias("term")))
    own = docs.select(docs[id_col].alias("k"), text_hash(docs[text_col]).alias("r"), F.array_append(word_list(docs[text_col]), F.lit(END)).alias("w"))
    words = own.select("k", "r", F.posexplode("w").alias("pos", "word"))
    hits = words.join(F.broadcast(asked) if is_small(vocabulary) else asked, "word").select("term", "k", "r", "pos")
    written = materialize(hits.sortWithinPartitions("term"), "postings")
    postings = written.where("term <> 0")
    counts = materialize(postings.groupBy("term").agg(F.count(F.lit(1)).alias("c")), "term-counts")
    terms = vocabulary.join(counts, "term", "left").select("word", "term", F.coalesce("c", F.lit(0)).alias("c"))
    return postings, materialize(terms, "terms"), written.where("term = 0").select("k", "r", F.col("pos").alias("n"))


def _offsets(windows: DataFrame, terms: DataFrame) -> DataFrame:
    """``window, m, items, by`` where ``by`` lists (c, o, term), the window's words from the rarest on with their offsets."""
    placed = windows.select("window", "m", "items", F.posexplode("window").alias("o", "word")).join(sent_if_small(terms), "word")
    return placed.groupBy("window", "m", "items").agg(F.array_sort(F.collect_list(F.struct("c", "o", "term"))).alias("by"))


def _found_at(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """The distinct places ``ak, ar, term_asked, want`` of a written table at which the index has a posting.

    Few places are sent to the index. Else only lists that are asked for, and documents of which a place is
    asked where these are few, go into the join.
    """
    asked = materialize(asked.select("ak", "ar", "term_asked", "want").distinct(), "asked-places")
    if is_small(asked):  # one number a place is probed faster than four
        keyed = F.broadcast(asked.withColumn("place", F.xxhash64("ak", "ar", "term_asked", "want")))
        found = postings.join(keyed, (F.xxhash64("k", "r", "term", "pos") == F.col("place")) & (F.col("term_asked") == F.col("term")) & F.col("ak").eqNullSafe(F.col("k")) & (F.col("ar") == F.col("r")) & (F.col("want") == F.col("pos")))
        return found.select("ak", "ar", "term_asked", "want").distinct()
    lists = materialize(asked.select("term_asked").distinct(), "asked-lists")
    own = materialize(asked.select("ak", "ar").distinct(), "asked-documents")
    near = postings.join(sent_if_small(lists), F.col("term") == F.col("term_asked"), "left_semi")
    if is_small(own):
        near = near.join(F.broadcast(own), F.col("ak").eqNullSafe(F.col("k")) & (F.col("ar") == F.col("r")), "left_semi")
    here = (asked["term_asked"] == near["term"]) & asked["ak"].eqNullSafe(near["k"]) & (asked["ar"] == near["r"]) & (asked["want"] == near["pos"])
    return asked.join(near, here, "left_semi")


def phrase_places(postings: DataFrame, terms: DataFrame, windows: DataFrame) -> DataFrame:
    """Exact occurrences of windows, ``k, r, start, m, items``, from the index alone.

    A window starts from the list of its rarest word. Each list is adjusted by its word's offset, so
    all name the window's start; the second rarest word's list is intersected by an equality join on
    (document, place), and where both agree the lists of all further words are asked for the places
    that the window needs. A window with a word that no document holds occurs nowhere.
    """
    plan = _offsets(windows, terms).where(~F.exists("by", lambda x: x["c"] == 0)).withColumn("id", F.xxhash64("window", "m"))
    word = lambda i: F.get("by", F.lit(i))
    plan = materialize(plan.select("id", "m", "items", word(0)["term"].alias("t1"), word(0)["o"].alias("o1"), word(1)["term"].alias("t2"), word(1)["o"].alias("o2"), F.slice("by", 3, 1 << 20).alias("others")), "windows")
    small = is_small(plan)
    part = lambda *columns: F.broadcast(plan.select(*columns)) if small else plan.select(*columns)
    first = postings.join(part("id", "t1", "o1", "t2", "o2"), F.col("term") == F.col("t1")).where("pos >= o1").select("id", F.col("k").alias("ak"), F.col("r").alias("ar"), (F.col("pos") - F.col("o1")).alias("start"), F.col("t2").alias("term_asked"), (F.col("pos") - F.col("o1") + F.col("o2")).alias("want"))
    first = materialize(first.distinct(), "first-places")
    place = ["ak", "ar", "term_asked", "want"]

    def standing(wanted: DataFrame) -> DataFrame:
        """Rows whose place the index holds."""
        there = materialize(_found_at(postings, wanted.where("term_asked is not null")), "found-places")
        there = there.select(*[F.col(c).alias(f"f_{c}") for c in place])
        return wanted.join(sent_if_small(there), [F.col(c).eqNullSafe(F.col(f"f_{c}")) if c == "ak" else F.col(c) == F.col(f"f_{c}") for c in place], "left_semi")

    two = standing(first).unionByName(first.where("term_asked is null"))
    two = materialize(two.select("id", "ak", "ar", "start"), "candidates")
    wanted = two.join(part("id", "others"), "id").select("id", "ak", "ar", "start", F.size("others").alias("left"), F.explode("others").alias("x"))
    wanted = materialize(wanted.select("id", "ak", "ar", "start", "left", F.col("x.term").alias("term_asked"), (F.col("start") + F.col("x.o")).alias("want")), "wanted-places")
    full = standing(wanted).groupBy("id", "ak", "ar", "start", "left").agg(F.count(F.lit(1)).alias("n")).where("n = left").select("id", "ak", "ar", "start")
    short = two.join(part("id", F.size("others").alias("left")).where("left = 0"), "id", "left_semi")
    return full.unionByName(short).join(part("id", "m", "items"), "id").select(F.col("ak").alias("k"), F.col("ar").alias("r"), "start", "m", "items")


def phrase_matches(docs: DataFrame, items: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Exact occurrences of item windows in each row of ``docs``: ``id_col, n_words, text_hash, matches``.

    ``matches`` holds (start, m, items), one for each place where a window's words stand; it is
    empty for clean documents, and every row of ``docs`` comes back. Places come from the index alone,
    and so do the numbers of words: texts are split once and never moved.

    Null ids and repeated rows come back as they are, each with the places of its own text; null or
    word-less texts have 0 words and no match; with no items nothing matches; columns other than the
    named are not read.
    """
    windows = materialize(windows_of(items, size, item_id, item_text), "item-windows")
    postings, terms, lengths = build_index(docs, windows, id_col, text_col)
    places = phrase_places(postings, terms, windows).groupBy("k", "r").agg(F.collect_list(F.struct("start", "m", "items")).alias("matches"))
    places = sent_if_small(materialize(places, "matches"))
    none = F.expr("cast(array() as array<struct<start:int,m:int,items:array<string>>>)")
    both = lengths.join(places, same_row(lengths, places), "left")
    return both.select(lengths["k"].alias(id_col), F.col("n").cast("long").alias("n_words"), lengths["r"].alias("text_hash"), F.coalesce("matches", none).alias("matches"))


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int, size: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", missing: int = 0) -> DataFrame:
    """Windows whose words, all but ``missing``, stand within ``slop`` words of their places: ``id_col, start, n_missing, window, items``.

    A row for each ``start`` (it may lie up to ``slop`` and the missing words before the text) at which
    that holds; a word of the text stands for one word of the window only, and one word at least must
    stand. Of any ``missing + 1`` words one is there, so the postings of the window's ``missing + 1``
    rarest words, words in no document first, give all starts; each is held against all words of the
    window. Equal rows of ``docs`` give their places once.
    """
    windows = materialize(windows_of(items, size, item_id, item_text), "item-windows")
    postings, terms, _ = build_index(docs, windows, id_col, text_col)
    by = materialize(_offsets(windows, terms), "windows")
    starts = by.select("window", "m", "items", F.explode(F.slice("by", 1, missing + 1)).alias("x")).where("x.c > 0").select("window", "m", "items", "x.o", "x.term")
    shifts = F.explode(F.array(*[F.col("pos") - F.col("o") + d for d in range(-slop, slop + 1)]))
    found = postings.join(sent_if_small(materialize(starts, "starts")), "term").select("k", "r", shifts.alias("start"), "window", "m", "items").distinct()
    found = materialize(found, "candidates")
    # each word's list within the slop of its place; equal words take the first free place each: their ranges have one length, so none is lost
    asked = found.select(F.col("k").alias("ak"), F.col("r").alias("ar"), "start", "m", "window", "items", F.posexplode("window").alias("o", "word")).join(sent_if_small(terms), "word")
    asked = asked.withColumn("at", F.explode(F.array(*[F.col("start") + F.col("o") + d for d in range(-slop, slop + 1)])))
    p = postings.distinct()
    there = p.join(asked.withColumnRenamed("term", "want_term"), (F.col("want_term") == p["term"]) & F.col("ak").eqNullSafe(p["k"]) & (F.col("ar") == p["r"]) & (F.col("at") == p["pos"]))
    spots = there.groupBy("k", "r", "start", "m", "window", "items", "o").agg(F.array_sort(F.collect_list("at")).alias("spots"))
    lists = spots.groupBy("k", "r", "start", "m", "window", "items").agg(F.array_sort(F.collect_list(F.struct("o", "spots"))).alias("lists"))
    taken = F.aggregate("lists", F.expr("cast(array() as array<int>)"), lambda x, y: F.concat(x, F.slice(F.array_except(y["spots"], x), 1, 1)))
    real = lists.withColumn("n_missing", F.col("m") - F.size(taken)).where((F.col("n_missing") <= missing) & (F.col("n_missing") < F.col("m")))
    return real.select(F.col("k").alias(id_col), "start", "n_missing", "window", "items").distinct()


def judge(matches: DataFrame, id_col: str = "doc_id", share: int = 20) -> DataFrame:
    """Contamination of each document: covered words, items, and whether 1/``share`` of the words or more are covered.

    A row per row of ``matches``; without a match nothing is covered, and no words are no contamination.
    """
    hit = F.size(F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["start"] + m["m"] - 1)))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("matches", lambda m: m["items"]))))
    out = matches.select(id_col, "n_words", hit.cast("long").alias("n_hit"), items.alias("items"))
    return out.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns.

    Rows are judged by their own texts, also where an id repeats; rows with a null id stay; with no
    items, or no documents, nothing goes.
    """
    found = phrase_matches(docs, items, id_col=id_col, text_col=text_col).where(F.size("matches") > 0)
    bad = judge(found.select(F.struct(F.col(id_col).alias("k"), F.col("text_hash").alias("r")).alias("row"), "n_words", "matches"), "row").where("contaminated")
    return without_rows(docs, bad.select("row.k", "row.r"), id_col, text_col)
