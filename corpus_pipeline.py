"""From raw documents to packed training windows: five stages, each written as Parquet and read by the next.

Part of the ``llm`` subpackage. Stages take (spark, docs, sf_dir) and return a DataFrame; all but the
last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gistset.llm import decontamination, exact_dedup, near_dedup, packing, quality
from gistset.llm.common import cleanup, new_path, table, written
from gistset.llm.queries import tokenizer_file


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose perplexity under the model of trusted text exceeds their language's threshold; see ``drop_low_quality``."""
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of equal normalised texts; see ``drop_exact_duplicates``."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near-duplicates (five-word shingles, similarity 0.8 or more); see ``drop_near_duplicates``."""
    return near_dedup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of whose words one in twenty or more is covered by benchmark windows; see ``drop_contaminated``."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows of 2048 tokens: a row a piece, with its token ids (little-endian, 4 bytes each); see ``pack``."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), size=2048, end_id=1, as_bytes=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Perplexity, sketches and tokenization are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again.

    A stage's intermediate tables, and the rows it read, are deleted once its own rows are written. Nulls,
    repeated ids and empty tables: as the stages' operators say.
    """
    docs = table(spark, sf_dir, "documents")
    mark = written(spark)
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        cleanup(spark, mark, keep=(path,))
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
