"""Synthetic matrices and graphs. All numbers are hashes of a row's number and a seed: any partition of the work gives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions.scalars import below, normal, permuted, uniform
from quillgrid.matrix import SparseMatrix

#: Bytes of an entry in memory and as text (fixed values of the estimate).
MEMORY_BYTES, TEXT_BYTES = 16, 25


def estimate_memory(nnz: int) -> dict[str, float]:
    """MB in memory and as text."""
    return {"memory_mb": nnz * MEMORY_BYTES / 2**20, "csv_mb": nnz * TEXT_BYTES / 2**20}


def check_safety(nnz: int, max_mb: float = 500.0) -> None:
    """An error if the estimate is above a limit; it names a number of entries that isn't."""
    if estimate_memory(nnz)["memory_mb"] > max_mb:
        raise ValueError(f"{nnz} entries need more than {max_mb} MB; {int(max_mb * 2**20 / MEMORY_BYTES)} would fit")


def uniform_matrix(spark: SparkSession, rows: int, cols: int, nnz: int, seed: int = 42, unique: bool = False) -> SparseMatrix:
    """nnz entries at uniform places with values from -100 to 99. unique: no place twice (the first of a keyed permutation of all
    places, so nothing is drawn in vain, sorted or gathered); an error if there aren't so many places."""
    value = (below(200, seed, F.lit("v"), F.col("id")) - 100).alias("v")
    if not unique:
        draws = spark.range(nnz).select(below(rows, seed, F.lit("i"), F.col("id")).alias("i"), below(cols, seed, F.lit("j"), F.col("id")).alias("j"), value)
        return SparseMatrix(draws, (rows, cols))
    if nnz > rows * cols:
        raise ValueError(f"{nnz} distinct places don't fit into {rows} x {cols}")
    taken = spark.range(nnz).select("id", permuted(F.col("id"), max(1, rows * cols), seed).alias("place"))
    return SparseMatrix(taken.select(F.floor(F.col("place") / cols).alias("i"), (F.col("place") % cols).alias("j"), value), (rows, cols), True)


def banded(spark: SparkSession, size: int, bandwidth: int, seed: int = 42) -> SparseMatrix:
    """All entries within a band, standard normal."""
    i = F.col("id")
    cells = spark.range(size).select(i.alias("i"), F.explode(F.sequence(F.greatest(i - bandwidth, F.lit(0)), F.least(i + bandwidth, F.lit(size - 1)))).alias("j"))
    return SparseMatrix(cells.withColumn("v", normal(seed, F.col("i"), F.col("j"))), (size, size), True)


def block_diagonal(spark: SparkSession, blocks: int, size: int, density: float, seed: int = 42) -> SparseMatrix:
    """int(size^2 * density) draws in each diagonal block, standard normal; places may repeat."""
    each = int(size * size * density)
    n = F.col("id")
    block = F.floor(n / max(each, 1))
    draws = spark.range(blocks * each).select(
        (block * size + below(size, seed, F.lit("i"), n)).alias("i"), (block * size + below(size, seed, F.lit("j"), n)).alias("j"), normal(seed, F.lit("v"), n).alias("v")
    )
    return SparseMatrix(draws, (blocks * size, blocks * size))


def power_law(spark: SparkSession, rows: int, cols: int, nnz: int, alpha: float = 2.0, seed: int = 42) -> SparseMatrix:
    """Pareto row degrees, cut at the number of columns, scaled to about nnz entries; a row's columns are distinct and uniform."""
    degree = F.least(F.floor(F.pow(uniform(seed, F.lit("d"), F.col("id")), -1 / alpha) - 1) + 1, F.lit(cols))
    degrees = spark.range(rows).select(F.col("id").alias("i"), degree.alias("d"))
    total = degrees.agg(F.sum("d")).first()[0] or 1
    scaled = degrees.select("i", F.least(F.greatest(F.floor(F.col("d") * nnz / total), F.lit(1)), F.lit(cols)).cast("int").alias("n"))
    # a row's columns: the first of its own permutation of all columns
    cells = scaled.select("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).withColumn("j", permuted(F.col("k"), cols, seed, F.col("i")))
    return SparseMatrix(cells.select("i", "j", normal(seed, F.col("i"), F.col("j")).alias("v")), (rows, cols), True)


#: Preset sizes: name, rows and columns, entries (fixed values).
PRESETS = (("small", 100, 500), ("medium", 1_000, 10_000), ("large", 10_000, 100_000), ("xlarge", 50_000, 1_000_000))


def presets(spark: SparkSession, seed: int = 42) -> dict[str, SparseMatrix]:
    """Named matrices of growing sizes; the two of a size differ in seed."""
    found = {}
    for name, size, nnz in PRESETS:
        for k, side in enumerate("ab"):
            found[f"{name}_{side}"] = uniform_matrix(spark, size, size, nnz, seed + k)
    found["banded"] = banded(spark, 1000, 5, seed)
    found["block"] = block_diagonal(spark, 10, 100, 0.1, seed)
    return found


def weighted_graph(spark: SparkSession, nodes: int, edges_per_node: int, seed: int = 42) -> DataFrame:
    """(src, dst, weight): random directed edges with weights from 1 to 10; loops and parallel edges are possible."""
    n = F.col("id")
    return spark.range(nodes * edges_per_node).select(
        below(nodes, seed, F.lit("s"), n).alias("src"), below(nodes, seed, F.lit("d"), n).alias("dst"), (below(10, seed, F.lit("w"), n) + 1).alias("weight")
    )


def sparse_graph(spark: SparkSession, nodes: int, sparsity: float, seed: int = 42) -> DataFrame:
    """(src, dst): draws for a given sparsity and a twentieth more, loops left out, parallel edges kept."""
    n = F.col("id")
    draws = spark.range(int(int(nodes * nodes * (1 - sparsity)) * 1.05))
    return draws.select(below(nodes, seed, F.lit("s"), n).alias("src"), below(nodes, seed, F.lit("d"), n).alias("dst")).filter("src <> dst")


def sparse_matrix(spark: SparkSession, size: int, sparsity: float, seed: int = 42) -> SparseMatrix:
    """Draws for a given sparsity with values from 1 to 10; places may repeat."""
    n = F.col("id")
    draws = spark.range(int(size * size * (1 - sparsity)))
    return SparseMatrix(draws.select(below(size, seed, F.lit("i"), n).alias("i"), below(size, seed, F.lit("j"), n).alias("j"), (below(10, seed, F.lit("v"), n) + 1).alias("v")), (size, size))


def features(spark: SparkSession, nodes: int, dims: int = 128, seed: int = 42) -> DataFrame:
    """(node, x array): standard normal features in packed form."""
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dims - 1).cast("long")), lambda d: normal(seed, F.col("id"), d))
    return spark.range(nodes).select(F.col("id").alias("node"), each.alias("x"))


def dense_matrix(spark: SparkSession, rows: int, cols: int, seed: int = 42) -> SparseMatrix:
    """Every cell, standard normal."""
    cells = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("i"), (F.col("id") % cols).alias("j"))
    return SparseMatrix(cells.withColumn("v", normal(seed, F.col("i"), F.col("j"))), (rows, cols), True)


def normalised(degrees: DataFrame) -> DataFrame:
    """(i, share): row degrees (i, d) as shares of their sum, which is one row that meets all."""
    return degrees.crossJoin(degrees.agg(F.sum("d").alias("total"))).select("i", (F.col("d") / F.col("total")).alias("share"))
