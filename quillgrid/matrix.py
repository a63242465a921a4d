"""Sparse matrices: a relation of coordinates (i, j, v) and a shape."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


class ShapeError(ValueError):
    """Shapes that don't fit."""


@dataclass(frozen=True)
class SparseMatrix:
    """Indices are 0-based longs, values long or double. canonical: no coordinate occurs twice."""

    df: DataFrame
    shape: tuple[int, int] | None = None
    canonical: bool = False

    @classmethod
    def from_entries(cls, spark: SparkSession, entries: Iterable[tuple], shape: tuple[int, int] | None = None, double: bool = False) -> SparseMatrix:
        """A matrix of (i, j, v) in memory; no entries are legal."""
        kind = DoubleType() if double else LongType()
        cast = float if double else int
        schema = StructType([StructField("i", LongType()), StructField("j", LongType()), StructField("v", kind)])
        return cls(spark.createDataFrame([(int(i), int(j), cast(v)) for i, j, v in entries], schema), shape)

    @classmethod
    def from_arrays(cls, spark: SparkSession, rows, cols, values, shape: tuple[int, int] | None = None, double: bool = False) -> SparseMatrix:
        """A matrix of three equally long arrays, taken over as Arrow columns."""
        import numpy as np
        import pyarrow as pa

        i, j, v = np.asarray(rows, np.int64), np.asarray(cols, np.int64), np.asarray(values)
        if not i.shape == j.shape == v.shape or i.ndim != 1:
            raise ValueError("arrays of different lengths")
        return cls(spark.createDataFrame(pa.table({"i": i, "j": j, "v": v.astype(np.float64 if double else np.int64)})), shape)

    @classmethod
    def from_csr(cls, spark: SparkSession, row_ptr, col_idx, values, shape: tuple[int, int] | None = None, double: bool = False) -> SparseMatrix:
        """A matrix of compressed-row arrays: pointers, columns, values."""
        import numpy as np

        ptr = np.asarray(row_ptr, np.int64)
        return cls.from_arrays(spark, np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)), col_idx, values, shape, double)

    def with_shape(self) -> SparseMatrix:
        """The matrix with a shape: if it has none, largest indices plus one (empty last rows and columns are lost)."""
        if self.shape is not None:
            return self
        m, n = self.df.agg(F.coalesce(F.max("i") + 1, F.lit(0)), F.coalesce(F.max("j") + 1, F.lit(0))).first()
        return replace(self, shape=(m, n))

    def merged(self) -> SparseMatrix:
        """One entry for each coordinate, duplicates summed; zeros stay."""
        if self.canonical:
            return self
        return replace(self, df=self.df.groupBy("i", "j").agg(F.sum("v").alias("v")), canonical=True)

    def nonzero(self, threshold: float | None = None) -> SparseMatrix:
        """Without zeros, or without values of at most a threshold's magnitude."""
        m = self.merged()
        return replace(m, df=m.df.filter(F.col("v") != 0 if threshold is None else F.abs("v") > threshold))

    def as_double(self) -> SparseMatrix:
        return replace(self, df=self.df.select("i", "j", F.col("v").cast("double").alias("v")))

    def stored_entries(self) -> int:
        """Entries as stored, duplicates and zeros counted."""
        return self.df.count()

    def nnz(self) -> int:
        """Entries once duplicates are merged."""
        return self.merged().df.count()

    def stats(self) -> DataFrame:
        """One row: entries, rows and columns that have any, least and largest value, density and sparsity in per cent."""
        m = self.merged().with_shape()
        cells = float(m.shape[0]) * m.shape[1]
        density = F.col("nnz") / F.lit(cells) * 100 if cells else F.lit(0.0)
        found = m.df.agg(
            F.count("*").alias("nnz"), F.countDistinct("i").alias("rows"), F.countDistinct("j").alias("cols"), F.min("v").alias("v_min"), F.max("v").alias("v_max")
        )
        return found.withColumn("density_pct", density).withColumn("sparsity_pct", 100 - density)

    def _small(self, limit: int) -> DataFrame:
        if self.df.limit(limit + 1).count() > limit:
            raise ValueError(f"more than {limit} entries; write them out, or raise the limit")
        return self.df.select("i", "j", "v")

    def collect(self, limit: int = 1_000_000) -> list[tuple]:
        """All entries in row order, for small matrices; an error beyond a limit."""
        return [tuple(r) for r in self._small(limit).orderBy("i", "j").collect()]

    def to_arrays(self, limit: int = 10_000_000) -> tuple:
        """NumPy arrays (rows, columns, values) in row order; an error beyond a limit."""
        found = self._small(limit).orderBy("i", "j").toArrow()
        return tuple(found[c].to_numpy() for c in ("i", "j", "v"))

    def to_csr(self, limit: int = 10_000_000) -> tuple:
        """NumPy arrays (row_ptr, col_idx, values), duplicates merged; an error beyond a limit."""
        import numpy as np

        a = self.merged().with_shape()
        rows, cols, values = a.to_arrays(limit)
        return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=a.shape[0]))]).astype(np.int64), cols, values


def require_equal(a: SparseMatrix, b: SparseMatrix) -> tuple[int, int] | None:
    """The shape of two matrices that are added; an error if both are known and differ."""
    if a.shape and b.shape and a.shape != b.shape:
        raise ShapeError(f"shapes differ: {a.shape} and {b.shape}")
    return a.shape or b.shape


def require_inner(a: SparseMatrix, b: SparseMatrix) -> tuple[int, int] | None:
    """The shape of a product; an error if inner sizes are known and differ."""
    if a.shape and b.shape and a.shape[1] != b.shape[0]:
        raise ShapeError(f"can't multiply {a.shape} by {b.shape}")
    return (a.shape[0], b.shape[1]) if a.shape and b.shape else None
