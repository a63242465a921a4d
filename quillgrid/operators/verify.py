"""Verification: differences between two matrices, and when they count as equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.matrix import SparseMatrix


def differences(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    """(i, j, v_a, v_b, diff) over the coordinates of both; absent is 0."""
    x = a.merged().df.select("i", "j", F.col("v").alias("v_a"))
    y = b.merged().df.select("i", "j", F.col("v").alias("v_b"))
    both = x.join(y, ["i", "j"], "full").select("i", "j", F.coalesce("v_a", F.lit(0)).alias("v_a"), F.coalesce("v_b", F.lit(0)).alias("v_b"))
    return both.withColumn("diff", F.abs(F.col("v_a") - F.col("v_b")))


def max_abs_diff(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    """One row: the largest difference, 0 for none."""
    return differences(a, b).agg(F.coalesce(F.max("diff"), F.lit(0)).alias("max_abs_diff"))


def set_difference(a: SparseMatrix, b: SparseMatrix, digits: int = 6) -> DataFrame:
    """(side, i, j, v): entries of one matrix, rounded, that the other lacks."""
    x, y = (m.merged().df.select("i", "j", F.round("v", digits).alias("v")) for m in (a, b))
    return x.subtract(y).select(F.lit("a").alias("side"), "*").unionByName(y.subtract(x).select(F.lit("b").alias("side"), "*"))


def lookup(expected: SparseMatrix, actual: SparseMatrix, tolerance: float = 1e-6) -> DataFrame:
    """(i, j, expected, actual, ok) for each expected entry; absent is 0."""
    x = expected.merged().df.select("i", "j", F.col("v").alias("expected"))
    y = actual.merged().df.select("i", "j", F.col("v").alias("actual"))
    joined = x.join(y, ["i", "j"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return joined.withColumn("ok", F.abs(F.col("expected") - F.col("actual")) <= tolerance)


def nnz_match(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    """One row: entries of both, and whether they are as many."""
    x, y = (m.merged().df.agg(F.count("*").alias(n)) for m, n in ((a, "nnz_a"), (b, "nnz_b")))
    return x.crossJoin(y).withColumn("same", F.col("nnz_a") == F.col("nnz_b"))  # one row by one row


def equal(a: SparseMatrix, b: SparseMatrix, tolerance: float = 1e-9) -> bool:
    """Whether shapes agree, as far as known, and no entry differs by more than a tolerance."""
    if a.shape and b.shape and a.shape != b.shape:
        return False
    return differences(a, b).filter(F.col("diff") > tolerance).isEmpty()
