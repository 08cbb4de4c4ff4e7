"""Reading lines and tables, and storing sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str, with_newline: bool = True) -> DataFrame:
    """``seq, line`` of text files; keys of the command-line filters include the line's newline."""
    text = spark.read.text(path).select(F.col("value").alias("line"))
    key = F.concat("line", F.lit("\n")) if with_newline else F.col("line")
    return text.select(F.monotonically_increasing_id().alias("seq"), key.alias("line"))


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of files."""
    return spark.readStream.text(path).select(F.concat("value", F.lit("\n")).alias("line"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(sketch: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Store a sketch table (lanes, runs or registers); Parquet run-length-encodes it again."""
    writer = sketch.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
