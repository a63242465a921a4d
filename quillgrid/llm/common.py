"""What several operators share: reading tables, Arrow batches, storage that all executors see."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file (a parameter of the operators that tokenize)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) alone, so that other columns, of any name, can't clash."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


#: Where spark.checkpoint.dir is unset and all executors are on this machine, as in tests.
LOCAL_DIR = "file:///tmp/checkpoints/quillgrid"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; an error where it is unset and the master isn't local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or LOCAL_DIR).rstrip('/')}/{uuid.uuid4().hex}"


def fresh(df: DataFrame, name: str) -> str:
    """A column's name that a table doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Folders that `stored` has written, by application, oldest first.
_WRITTEN: dict[str, list[str]] = {}


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """Folders that this application has stored tables in so far."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, ()))


def discard(spark: SparkSession, folders: list[str]) -> None:
    """Deletes stored tables that nothing reads any more."""
    context = spark.sparkContext
    for folder in folders:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN[context.applicationId].remove(folder)


#: Rows that are numbered together, about.
TOGETHER = 100_000


def numbered(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """The rows with their place, from 0, in an order that should tell all apart. Ranges of rows are numbered apart; only their sizes meet."""
    parts, part = max(1, -(-df.count() // TOGETHER)), fresh(df, "part")
    ranged = stored(df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()))
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    first = ranged.groupBy(F.col(part).alias("of")).agg(F.count("*").alias("n")).select(F.col("of").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    of, at = (fresh(df, n) for n in ("of", "first"))
    within = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    placed = ranged.withColumn(name, within).join(first.toDF(of, at), F.col(part) == F.col(of))
    return placed.withColumn(name, (F.col(name) + F.col(at)).cast("long")).drop(part, of, at)


def slices(batch: pa.RecordBatch, column: int, rows: int, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with so many rows at most, and so many bytes of a text column or else one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, to - at)
        at = to


_STATE: dict[tuple, object] = {}
#: Bytes of an entry of a dictionary of strings besides its characters, about.
ENTRY = 160


def worker_state(key: tuple, make: Callable[[], object]):
    """What a Python worker keeps between tasks: one operator's state at a time, so that those of several never pile up. key begins with the operator's name."""
    if key not in _STATE:
        _evict(None)
        _STATE[key] = make()
    return _STATE[key]


def _evict(owner: str | None) -> None:
    """State of other operators goes, and its memory back to the system."""
    if any(key[0] != owner for key in _STATE):
        _STATE.clear()
        release()


def release() -> None:
    """Returns freed memory to the system, as far as the system's library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def in_workers(df: DataFrame, owner: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow for all operators: what another operator left in a worker goes first, and what a task alone held goes when it ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _evict(owner)
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(whole, schema)


def size_in_words(text):
    r"""Native count of ``[^\x20\x09-\x0D]+`` in a text column; null counts 0.

    A word begins where such a character follows a separator or the start; the
    texts' separators are folded to one blank and the blanks counted."""
    folded = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(F.length(folded) == 0, F.lit(0).cast("long")).otherwise(
        (F.length(folded) - F.length(F.replace(folded, F.lit(" "), F.lit(""))) + 1).cast("long")
    )


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable Latin-1 as itself, the others from U+0100 on."""
    own = [b for b in range(256) if chr(b).isprintable() and b != 32]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}
