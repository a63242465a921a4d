"""What a multiplication would cost, and whether to run it sparse or dense."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.matrix import SparseMatrix
from quillgrid.operators.algebra import product_counts

#: Bytes of a sparse entry and of a dense cell; the density (per cent) from which dense is chosen.
ENTRY_BYTES, CELL_BYTES, DENSE_FROM = 16, 8, 10.0


def memory_footprint(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    """One row: MB of both operands sparse and dense, and their quotient."""
    a, b = a.with_shape(), b.with_shape()
    entries = a.merged().df.select("i").unionByName(b.merged().df.select("i")).agg(F.count("*").alias("n"))
    cells = float(a.shape[0]) * a.shape[1] + float(b.shape[0]) * b.shape[1]
    sparse, dense = F.col("n") * ENTRY_BYTES / 2**20, F.lit(cells * CELL_BYTES / 2**20)
    return entries.select(sparse.alias("sparse_mb"), dense.alias("dense_mb"), F.when(sparse > 0, dense / sparse).alias("ratio"))


def multiplication_choice(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    """One row: products of the sparse and of the dense way, density, and the way to go."""
    a, b = a.with_shape(), b.with_shape()
    products = product_counts(a, b).agg(F.coalesce(F.sum("products"), F.lit(0)).alias("sparse_products"), F.coalesce(F.max("products"), F.lit(0)).alias("hottest"))
    density = a.stats().select(F.col("density_pct").alias("density_a")).crossJoin(b.stats().select(F.col("density_pct").alias("density_b")))  # a row by a row
    dense = a.shape[0] * a.shape[1] * b.shape[1]
    both = products.crossJoin(density)
    choice = F.when(F.greatest("density_a", "density_b") >= DENSE_FROM, "dense").otherwise("sparse")
    return both.select("sparse_products", "hottest", F.lit(dense).cast("long").alias("dense_products"), "density_a", "density_b", choice.alias("choice"))
