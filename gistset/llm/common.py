"""What the document operators share: word splitting, written intermediate tables, batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word after lower-casing A-Z: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_BYTES = re.compile(WORD.encode())
#: The same as the JVM reads it fastest.
WORD_JVM = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: What counts as white space inside normalised texts and around line keys.
BLANK = r"[\x20\x09-\x0D]+"

_OWN_DIRS: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that is unset on a single machine a temporary folder of our own is used; on a cluster
    the setting is required.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="gistset-")
        spark.sparkContext.setCheckpointDir(_OWN_DIRS[app])
    return _OWN_DIRS[app]


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, tag: str, row_group: int = 64 << 20) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").option("parquet.block.size", row_group).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables from ``materialize`` that no frame in use reads any more."""
    for df in tables:
        spark = df.sparkSession
        _delete(spark, df._written_at)
        _WRITTEN[spark.sparkContext.applicationId].remove(df._written_at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within, writes hand Python at most ``rows`` texts at once, so that long texts do not fill a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(spark: SparkSession) -> int:
    """How many intermediate tables this session has written so far: a mark for ``cleanup``."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def cleanup(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the intermediate tables that this session wrote after the mark ``since``, but for ``keep``."""
    all_ = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for path in all_[since:]:
        if path not in keep:
            _delete(spark, path)
            all_.remove(path)


#: Bytes of a table's rows up to which it is sent to all executors; beyond, it is joined by shuffle.
SENT_BYTES = 32 << 20
#: Rows of one key from which on, if they are also a thousandth of all rows, the key is joined apart.
HEAVY_ROWS = 1000


def is_small(df: DataFrame, most: int | None = None) -> bool:
    """Whether the rows of a written table take ``most`` bytes or less: 8 for a number, the length of what is spelt out for all else."""
    most = SENT_BYTES if most is None else most
    wide = [c for c, kind in df.dtypes if kind not in ("bigint", "int", "smallint", "tinyint", "double", "float", "boolean")]
    fixed = df.count() * 8 * (len(df.columns) - len(wide) + 1)
    if fixed > most or not wide:
        return fixed <= most
    return fixed + (df.agg(F.sum(F.octet_length(F.to_json(F.struct(*wide))))).first()[0] or 0) <= most


def sent_if_small(df: DataFrame, most: int | None = None) -> DataFrame:
    """A written table, marked to be sent to all executors if it is small."""
    return F.broadcast(df) if is_small(df, most) else df


def join_heavy(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner", whole: bool = True) -> DataFrame:
    """Join ``rows`` with a written table of one row a key, whose column ``size`` counts the key's rows.

    A small table is sent to all executors (not so without ``whole``). Of a larger one only the keys of a thousandth of all rows or
    more are, a thousand at most, so their rows stay where they are; the others are joined by shuffle.
    ``how``: inner, left, left_semi or left_anti.
    """
    if whole and is_small(groups):
        return rows.join(F.broadcast(groups), keys, how)
    least = max(HEAVY_ROWS, (groups.agg(F.sum(size)).first()[0] or 0) // 1000)
    heavy = F.broadcast(groups.where(F.col(size) >= least))
    rest = rows.join(heavy, keys, "left_anti").join(groups.where(F.col(size) < least), keys, how)
    return rest if how == "left_anti" else rows.join(heavy, keys, "inner" if how == "left" else how).unionByName(rest)


def text_hash(text: Column) -> Column:
    """Tells rows of one id apart by their texts; a null text has a hash of its own kind."""
    return F.xxhash64(text)


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs``, all columns, whose id and text are not among ``k, r`` of ``gone``; rows with a null id stay.

    Few rows that go are sent to the scan of ``docs``, which is then not shuffled; many are joined.
    """
    gone = gone.where("k is not null").select(F.col("k").alias("gone_k"), F.col("r").alias("gone_r")).distinct()
    gone = sent_if_small(materialize(gone, "gone"))
    return docs.join(gone, (docs[id_col] == gone["gone_k"]) & (text_hash(docs[text_col]) == gone["gone_r"]), "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; the built-in ``lower`` is used where it does the same (pure ASCII)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, lower))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; a null text has none."""
    return WORD_BYTES.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most_bytes`` of text, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
        begin = total = 0
        for i, n in enumerate(sizes):
            if i > begin and total + n > most_bytes:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        yield batch.slice(begin)
    _release()


def _release() -> None:
    """Give freed memory back to the machine at a task's end, since idle workers keep theirs beside the JVM's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def same_row(a: DataFrame, b: DataFrame, id_col: str = "k", hash_col: str = "r") -> Column:
    """Join condition: the same id (null equals null) and the same text hash."""
    return a[id_col].eqNullSafe(b[id_col]) & (a[hash_col] == b[hash_col])
