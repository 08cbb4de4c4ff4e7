"""Exact duplicates by progressive refinement: length, then a prefix hash, then the full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, join_heavy, materialize, text_hash, without_rows


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " ")


def _grouped(docs: DataFrame, id_col: str, text_col: str, digest: str, prefix: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``k, r, sha, least, size`` whose length and prefix hash recur; and ``k, r, sha`` of all others, which are alone."""
    text = normalised(docs[text_col])
    key = [docs[id_col].alias("k"), text_hash(docs[text_col]).alias("r"), F.octet_length(text).alias("n"), F.xxhash64(F.substring(text, 1, prefix)).alias("p")]
    sha = F.unhex(F.sha2(text, 256)) if digest == "all" else F.lit(None).cast("binary")
    rows = materialize(docs.select(*key, sha.alias("sha")), "dedup-keys")
    count = F.count(F.lit(1)).alias("c")
    lengths = materialize(rows.groupBy("n").agg(count).where("c > 1"), "dedup-lengths")
    again = join_heavy(rows.select("n", "p"), lengths, ["n"], "c", "left_semi")
    prefixes = materialize(again.groupBy("n", "p").agg(count).where("c > 1"), "dedup-prefixes")
    if digest == "all":
        survivors = join_heavy(rows, prefixes, ["n", "p"], "c", "left_semi").select("k", "r", "sha")
    else:  # whole texts are read again, and hashed, for these only
        content = join_heavy(docs.select(*key, text.alias("t")), prefixes, ["n", "p"], "c", "left_semi")
        survivors = materialize(content.select("k", "r", F.unhex(F.sha2("t", 256)).alias("sha")), "dedup-hashes")
    groups = materialize(survivors.groupBy("sha").agg(F.min("k").alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1"), "dedup-groups")
    alone = join_heavy(rows, prefixes, ["n", "p"], "c", "left_anti").select("k", "r", "sha")
    return join_heavy(survivors, groups, ["sha"], "size", "left").select("k", "r", "sha", "least", "size"), alone


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: str = "survivors", prefix: int = 64) -> DataFrame:
    """Group equal normalised texts; return a row per row of ``docs``.

    Columns: ``id_col, keep_id`` (smallest id of the group), ``group_size, kept, text_sha256``.
    ``digest="survivors"`` reads again and hashes whole texts only where length and prefix hash
    recur (elsewhere ``text_sha256`` is null); ``"all"`` hashes every text in the first scan, for
    callers that need each digest anyway, and still groups survivors only.

    Groups are summed before they are shuffled, and rows of large groups meet their group without a
    shuffle, so a group of any size is spread over all tasks; rows that survive no step pass the joins by.
    A null text counts as empty. Null ids rank after all others (a group of null ids only keeps them
    all); rows that repeat an id count as members, each by its own text. An empty table gives no rows;
    other columns are not read.
    """
    survivors, alone = _grouped(docs, id_col, text_col, digest, prefix)
    none = alone.select("*", F.lit(None).cast(dict(survivors.dtypes)["least"]).alias("least"), F.lit(None).cast("long").alias("size"))
    keep = F.when(F.col("size").isNull(), F.col("k")).otherwise(F.col("least"))
    return survivors.unionByName(none).select(F.col("k").alias(id_col), keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("k")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns.

    A row goes if a smaller id holds its normalised text; other texts under its id are not touched. Rows
    with a null id stay; of rows of one id with one text all stay or go; an empty table gives no rows.
    """
    survivors, _ = _grouped(docs, id_col, text_col, "survivors", 64)
    return without_rows(docs, survivors.where("size is not null and k > least"), id_col, text_col)
