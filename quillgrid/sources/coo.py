"""Readers and writers of coordinate text, edge lists, columnar layouts and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions.scalars import number, truncated, whole_index
from quillgrid.matrix import SparseMatrix
from quillgrid.operators.algebra import densify
from quillgrid.operators.layout import csc_chunks, csr_chunks, from_csc, from_csr


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, blank ones included."""
    try:
        return spark.read.text(path)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e


def parse_lines(lines: DataFrame, base: int = 1, double: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(i, j, v, ok), and columns to keep, for each line: ok has exactly three fields by commas, two integers and a number. Values are cut toward
    zero unless double; indices are shifted to begin at 0."""
    parts = F.split("value", ",")
    value = number(F.get(parts, F.lit(2)))
    fields = lines.select(
        (whole_index(F.get(parts, F.lit(0))) - base).alias("i"), (whole_index(F.get(parts, F.lit(1))) - base).alias("j"), (value if double else truncated(value)).alias("v"), F.size(parts).alias("n"), *keep
    )
    ok = (F.col("n") == 3) & F.col("i").isNotNull() & F.col("j").isNotNull() & F.col("v").isNotNull()
    return fields.select("i", "j", "v", ok.alias("ok"), *keep)


def read_coo(spark: SparkSession, path: str, shape: tuple[int, int] | None = None, base: int = 1, double: bool = False) -> SparseMatrix:
    """A matrix from lines `row,col,value`; others are left out (rejected_lines counts them). A header is one of those."""
    parsed = parse_lines(read_lines(spark, path), base, double)
    return SparseMatrix(parsed.filter("ok").select("i", "j", "v"), shape)


def rejected_lines(spark: SparkSession, path: str) -> int:
    """Lines, blank ones left out, that read_coo doesn't take."""
    lines = read_lines(spark, path).filter(F.trim("value") != "")
    return parse_lines(lines).filter("NOT ok").count()


def count_lines(spark: SparkSession, path: str, blank: bool = True) -> int:
    """All lines, or those that aren't blank."""
    lines = read_lines(spark, path)
    return (lines if blank else lines.filter(F.trim("value") != "")).count()


def read_table(spark: SparkSession, path: str, base: int = 1, double: bool = False, names: tuple[str, str, str] = ("row", "col", "value")) -> SparseMatrix:
    """A matrix from a file whose first line names its columns, in any order and with further ones; lines that don't fit are left out."""
    try:
        rows = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    if missing := [n for n in names if n not in rows.columns]:
        raise ValueError(f"{path} has no column {missing[0]}")
    i, j, v = (F.col(f"`{n}`") for n in names)
    parsed = rows.select((whole_index(i) - base).alias("i"), (whole_index(j) - base).alias("j"), (number(v) if double else truncated(number(v))).alias("v"))
    return SparseMatrix(parsed.dropna())


def read_edges(spark: SparkSession, path: str, base: int = 0, weighted: bool = False, nodes: int | None = None) -> DataFrame:
    """(src, dst[, weight]) of an edge list whose lines have so many columns or more; a malformed line is an error, a blank one isn't a line. With a
    number of nodes, edges beyond it are left out."""
    names = ("src", "dst", "weight")[: 3 if weighted else 2]
    parts = F.split("value", ",")

    def field(k: int, name: str):
        found = whole_index(F.get(parts, F.lit(k)))
        return F.coalesce(found, F.raise_error(F.concat(F.lit(f"no {name} in line: "), F.col("value"))).cast("bigint")).alias(name)

    edges = read_lines(spark, path).filter(F.trim("value") != "").select(*(field(k, n) for k, n in enumerate(names)))
    edges = edges.withColumn("src", F.col("src") - base).withColumn("dst", F.col("dst") - base)
    return edges if nodes is None else edges.filter(F.col("src").between(0, nodes - 1) & F.col("dst").between(0, nodes - 1))


def read_dense(spark: SparkSession, path: str, nodes: int, base: int = 1) -> DataFrame:
    """(i, j, v) of every cell of a graph's matrix, from lines src,dst,weight counted from 1: weights of parallel edges summed, 0 elsewhere."""
    edges = read_edges(spark, path, base, weighted=True, nodes=nodes)
    return densify(SparseMatrix(edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("v")), (nodes, nodes)))


def write_coo(a: SparseMatrix, path: str, base: int = 1, ordered: bool = False) -> None:
    """Lines `row,col,value` without a header, in order of rows if asked."""
    rows = a.df.select((F.col("i") + base).alias("i"), (F.col("j") + base).alias("j"), "v")
    (rows.orderBy("i", "j") if ordered else rows).write.mode("overwrite").csv(path)


def sort_file(spark: SparkSession, path: str, out: str, by_columns: bool = False) -> None:
    """Sorts coordinate text by row and column, or by column and row: range partitions, sorted with spilling. No lines give no lines."""
    rows = read_coo(spark, path, base=0, double=False).df
    (rows.orderBy("j", "i") if by_columns else rows.orderBy("i", "j")).select("i", "j", "v").write.mode("overwrite").csv(out)


def save_csr(a: SparseMatrix, path: str) -> None:
    """Compressed rows as Parquet, long ones in chunks; sorted by row, so that a row's lookup reads few row groups."""
    csr_chunks(a).repartitionByRange("i", "chunk").sortWithinPartitions("i", "chunk").write.mode("overwrite").parquet(path)


def load_csr(spark: SparkSession, path: str, shape: tuple[int, int] | None = None) -> SparseMatrix:
    return from_csr(spark.read.parquet(path), shape)


def save_csc(a: SparseMatrix, path: str) -> None:
    """Compressed columns as Parquet, long ones in chunks, sorted by column."""
    csc_chunks(a).repartitionByRange("j", "chunk").sortWithinPartitions("j", "chunk").write.mode("overwrite").parquet(path)


def load_csc(spark: SparkSession, path: str, shape: tuple[int, int] | None = None) -> SparseMatrix:
    return from_csc(spark.read.parquet(path), shape)


def save_matrix(a: SparseMatrix, path: str, buckets: int | None = None, name: str | None = None) -> None:
    """Coordinates as Parquet; with buckets and a table's name, bucketed by row, so that later joins on rows need no shuffle."""
    if buckets and name:
        a.df.write.mode("overwrite").bucketBy(buckets, "i").sortBy("i", "j").option("path", path).saveAsTable(name)
    else:
        a.df.write.mode("overwrite").parquet(path)


def load_matrix(spark: SparkSession, path: str, shape: tuple[int, int] | None = None, canonical: bool = False) -> SparseMatrix:
    return SparseMatrix(spark.read.parquet(path), shape, canonical)


def read_report(spark: SparkSession, path: str, lines: bool = False) -> DataFrame | None:
    """Records of a JSON report, an array or (lines) a record a line, as write_report makes them; None if there is none."""
    try:
        return spark.read.option("multiLine", not lines).json(path)
    except AnalysisException:
        return None


def write_report(records: DataFrame, path: str, kind: str = "json") -> None:
    """Benchmark records, written anew, as json or csv."""
    writer = records.coalesce(1).write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)
