"""Compressed layouts: one row of arrays for each matrix row or column, pointers, access, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.matrix import SparseMatrix

#: Indices whose counts are summed together.
RANGE = 4096


#: Columns of a row (or rows of a column) that stand in one array, at most.
CHUNK = 1 << 16


def csr_rows(a: SparseMatrix) -> DataFrame:
    """(i, col_idx, values) of the rows that have entries, columns ascending: an array a row, so for rows that fit one; csr_chunks has no such bound."""
    return _compressed(a, "i", "j", "col_idx")


def csc_cols(a: SparseMatrix) -> DataFrame:
    """(j, row_idx, values) of the columns that have entries, rows ascending."""
    return _compressed(a, "j", "i", "row_idx")


def csr_chunks(a: SparseMatrix, size: int = CHUNK) -> DataFrame:
    """(i, chunk, col_idx, values): a row's entries by ranges of so many columns; a hub row is many arrays, dealt over the cluster."""
    return _compressed(a, "i", "j", "col_idx", size)


def csc_chunks(a: SparseMatrix, size: int = CHUNK) -> DataFrame:
    """(j, chunk, row_idx, values): the same by columns."""
    return _compressed(a, "j", "i", "row_idx", size)


def _compressed(a: SparseMatrix, by: str, other: str, name: str, size: int | None = None) -> DataFrame:
    keys = [F.col(by)] if size is None else [F.col(by), F.floor(F.col(other) / size).alias("chunk")]
    packed = a.merged().df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(other, "v"))).alias("e"))
    return packed.select(by, *([] if size is None else ["chunk"]), F.col(f"e.{other}").alias(name), F.col("e.v").alias("values"))


def from_csr(rows: DataFrame, shape: tuple[int, int] | None = None) -> SparseMatrix:
    """The entries of compressed rows."""
    pairs = rows.select("i", F.explode(F.arrays_zip("col_idx", "values")).alias("e"))
    return SparseMatrix(pairs.select("i", F.col("e.col_idx").alias("j"), F.col("e.values").alias("v")), shape)


def from_csc(cols: DataFrame, shape: tuple[int, int] | None = None) -> SparseMatrix:
    """The entries of compressed columns."""
    pairs = cols.select("j", F.explode(F.arrays_zip("row_idx", "values")).alias("e"))
    return SparseMatrix(pairs.select(F.col("e.row_idx").alias("i"), "j", F.col("e.values").alias("v")), shape)


def row_pointers(a: SparseMatrix) -> DataFrame:
    """(i, ptr) for i from 0 to the number of rows: entries in rows before i, empty rows included."""
    a = a.merged().with_shape()
    return _pointers(a, "i", a.shape[0])


def col_pointers(a: SparseMatrix) -> DataFrame:
    """(j, ptr) for j from 0 to the number of columns."""
    a = a.merged().with_shape()
    return _pointers(a, "j", a.shape[1])


def _pointers(a: SparseMatrix, by: str, n: int) -> DataFrame:
    """A two-level prefix sum: within ranges of RANGE indices, and over the ranges' totals."""
    counts = a.df.groupBy(by).agg(F.count("*").alias("n"))
    every = a.df.sparkSession.range(n + 1).withColumnRenamed("id", by).join(counts, by, "left")
    every = every.select(by, F.coalesce("n", F.lit(0)).alias("n"), F.floor(F.col(by) / RANGE).alias("range"))
    totals = counts.groupBy(F.floor(F.col(by) / RANGE).alias("range")).agg(F.sum("n").alias("total"))
    ranges = a.df.sparkSession.range(n // RANGE + 1).withColumnRenamed("id", "range").join(totals, "range", "left")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    bases = ranges.select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("range").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return every.join(bases, "range").select(by, (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("ptr"))


def entry_positions(a: SparseMatrix) -> DataFrame:
    """(i, j, v, k): the place of each entry in its row, from 0. Two levels: within ranges of columns, and over a row's ranges, so that a hub row
    is dealt over the cluster."""
    rows = a.merged().df.withColumn("range", F.floor(F.col("j") / CHUNK))
    before = Window.partitionBy("i").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("i", "range").agg(F.count("*").alias("n")).select("i", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("i", "range").orderBy("j")) - 1
    return rows.withColumn("k", within).join(first, ["i", "range"]).select("i", "j", "v", (F.col("k") + F.col("first")).cast("int").alias("k"))


def _checked(a: SparseMatrix, axis: int, low: int, high: int) -> None:
    """An error for indices that can't be; a size that isn't known is not looked up: nothing lies beyond it."""
    if not 0 <= low < high or (a.shape is not None and high > a.shape[axis]):
        raise IndexError(f"{low} to {high} isn't within 0 to {a.shape[axis] if a.shape else 'the size'}")


def get_row(a: SparseMatrix, i: int) -> DataFrame:
    """(j, v) of a row; the predicate reaches the scan."""
    _checked(a, 0, i, i + 1)
    return SparseMatrix(a.df.filter(F.col("i") == i), a.shape, a.canonical).merged().df.select("j", "v")


def get_col(a: SparseMatrix, j: int) -> DataFrame:
    """(i, v) of a column."""
    _checked(a, 1, j, j + 1)
    return SparseMatrix(a.df.filter(F.col("j") == j), a.shape, a.canonical).merged().df.select("i", "v")


def row_block(a: SparseMatrix, low: int, high: int) -> SparseMatrix:
    """Rows low to high, not included, counted from 0."""
    _checked(a, 0, low, high)
    rows = a.df.filter((F.col("i") >= low) & (F.col("i") < high)).select((F.col("i") - low).alias("i"), "j", "v")
    return SparseMatrix(rows, a.shape and (high - low, a.shape[1]), a.canonical).merged()


def col_block(a: SparseMatrix, low: int, high: int) -> SparseMatrix:
    """Columns low to high, not included, counted from 0."""
    _checked(a, 1, low, high)
    cols = a.df.filter((F.col("j") >= low) & (F.col("j") < high)).select("i", (F.col("j") - low).alias("j"), "v")
    return SparseMatrix(cols, a.shape and (a.shape[0], high - low), a.canonical).merged()


def csr_add(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sum of two matrices in compressed rows, in compressed rows: each pair of rows is merged as maps."""

    def as_map(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("i", F.map_from_arrays("col_idx", "values").alias(name))

    empty = F.expr("cast(map() as map<bigint, bigint>)")
    both = as_map(a, "x").join(as_map(b, "y"), "i", "full").select("i", F.coalesce("x", empty).alias("x"), F.coalesce("y", empty).alias("y"))
    merged = F.map_zip_with("x", "y", lambda _, p, q: F.coalesce(p, F.lit(0)) + F.coalesce(q, F.lit(0)))
    entries = both.select("i", F.array_sort(F.map_entries(merged)).alias("e"))
    return entries.select("i", F.col("e.key").alias("col_idx"), F.col("e.value").alias("values"))


def sorted_entries(a: SparseMatrix, by_columns: bool = False) -> DataFrame:
    """All entries in order of rows, or of columns; Spark sorts ranges and spills by itself."""
    return a.df.orderBy("j", "i") if by_columns else a.df.orderBy("i", "j")


def first_entries(a: SparseMatrix, n: int, by_columns: bool = False) -> DataFrame:
    """The first n entries of an order, with their place from 1."""
    order = (F.col("j"), F.col("i")) if by_columns else (F.col("i"), F.col("j"))
    top = a.merged().df.orderBy(*order).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # of n rows


def joined_text(values: Column) -> Column:
    """An array as text, for comparison across engines."""
    return F.concat_ws(",", F.transform(values, lambda v: v.cast("string")))
