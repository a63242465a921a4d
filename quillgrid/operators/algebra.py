"""Matrix algebra as relational algebra: sums are unions, products are joins, both closed by a grouped sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillgrid.matrix import SparseMatrix, require_equal, require_inner
from quillgrid.operators import features as packed


def transpose(a: SparseMatrix) -> SparseMatrix:
    """Rows and columns exchanged."""
    return SparseMatrix(a.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), a.shape and (a.shape[1], a.shape[0]), a.canonical)


def scale(a: SparseMatrix, factor: float) -> SparseMatrix:
    return SparseMatrix(a.df.select("i", "j", (F.col("v") * factor).alias("v")), a.shape, a.canonical)


def add(a: SparseMatrix, b: SparseMatrix, drop_zeros: bool = False, by_rows: int | None = None) -> SparseMatrix:
    """a + b, one entry for each coordinate. Explicit zeros and those of cancellation stay unless dropped. The grouped sum
    combines on the map side, one shuffle in all; by_rows deals it by ranges of rows."""
    shape = require_equal(a, b)
    rows = a.df.select("i", "j", "v").unionByName(b.df.select("i", "j", "v"))
    if by_rows:
        rows = rows.repartitionByRange(by_rows, "i", "j")
    c = SparseMatrix(rows, shape).merged()
    return c.nonzero() if drop_zeros else c


def subtract(a: SparseMatrix, b: SparseMatrix, drop_zeros: bool = False) -> SparseMatrix:
    """a - b."""
    return add(a, scale(b, -1), drop_zeros)


def multiply(a: SparseMatrix, b: SparseMatrix, threshold: float | None = None, double: bool = False, blocks: tuple[int, int] | None = None) -> SparseMatrix:
    """a x b without zeros, or without values up to a threshold. Operands are merged first, so parallel entries don't
    multiply products. The join is on the inner index (adaptive execution splits hot ones), the grouped sum
    combines products before its shuffle.

    blocks (rows of a block, number of parts): blocks of rows are summed apart; the result is the same."""
    shape = require_inner(a, b)
    left, right = a.merged(), b.merged()
    if double:
        left, right = left.as_double(), right.as_double()
    x = left.df.select(F.col("i").alias("i"), F.col("j").alias("k"), F.col("v").alias("x"))
    y = right.df.select(F.col("i").alias("k"), F.col("j").alias("j"), F.col("v").alias("y"))
    products = x.join(y, "k").select("i", "j", (F.col("x") * F.col("y")).alias("v"))
    if blocks:
        # the block is part of the sum's own key: one shuffle, combined before it
        size, n = blocks
        products = products.groupBy(F.pmod(F.floor(F.col("i") / size), F.lit(n)).alias("block"), "i", "j").agg(F.sum("v").alias("v")).drop("block")
    return SparseMatrix(products, shape, bool(blocks)).nonzero(threshold)


def self_product(a: SparseMatrix) -> SparseMatrix:
    """a x a: numbers of two-step paths, if a counts edges."""
    return multiply(a, a)


def gram(a: SparseMatrix) -> SparseMatrix:
    """The transpose of a times a."""
    return multiply(transpose(a), a)


def spmv(a: SparseMatrix, x: DataFrame) -> DataFrame:
    """a times a vector (k, x): (i, y)."""
    joined = a.df.join(x.select(F.col("k").alias("j"), "x"), "j")
    return joined.groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def spmm(a: SparseMatrix, features: DataFrame, dims: int | None = None) -> DataFrame:
    """a times a dense matrix in packed form (node, x array): (i, y array) of the rows that have entries."""
    dims = packed.dims_of(features) if dims is None else dims
    joined = a.merged().df.join(features.select(F.col("node").alias("j"), "x"), "j")
    return packed.summed(joined, "i", "x", F.col("v"), dims, "y")


def product_counts(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    """(k, products) by inner index: what a product's join makes before it sums. Two grouped counts and a join."""
    x = a.merged().df.groupBy(F.col("j").alias("k")).agg(F.count("*").alias("left"))
    y = b.merged().df.groupBy(F.col("i").alias("k")).agg(F.count("*").alias("right"))
    return x.join(y, "k").select("k", (F.col("left") * F.col("right")).alias("products"))


#: Rows and columns of a tile of cells, for matrices that are wide enough, and cells that a task makes.
TILE, TILE_CELLS, TASK_CELLS = 256, 4096, 2**24


def densify(a: SparseMatrix) -> DataFrame:
    """(i, j, v) of every cell, zeros included: m x n rows, each made where it is returned. Only entries and a start for each tile are shuffled; in a
    tile, in order of its rows, each is followed by the zeros up to the next. Entries outside the shape are left out."""
    a = a.merged().with_shape()
    spark, (m, n) = a.df.sparkSession, a.shape
    width = max(min(n, TILE), 1)
    height = TILE_CELLS // width
    down, across = -(-m // height), -(-n // width)
    parts = max(min(down * across, max(-(-m * n // TASK_CELLS), spark.sparkContext.defaultParallelism)), 1)

    inside = a.df.filter(F.col("i").between(0, m - 1) & F.col("j").between(0, n - 1))
    tile = F.expr(f"i div {height}") * across + F.expr(f"j div {width}")
    entries = inside.select(tile.alias("tile"), (F.col("i") % height).alias("r"), (F.col("j") % width).alias("c"), "v")
    starts = spark.range(down * across).select(F.col("id").alias("tile"), F.lit(0).cast("long").alias("r"), F.lit(-1).cast("long").alias("c"), F.lit(None).alias("v"))
    # the last tiles of a row or column are narrower or lower
    top, left = F.expr(f"tile div {max(across, 1)}") * height, F.col("tile") % max(across, 1) * width
    runs = entries.unionByName(starts).repartition(parts, "tile").withColumns({"top": top, "left": left})
    runs = runs.withColumns({"h": F.least(F.lit(height), m - F.col("top")), "w": F.least(F.lit(width), n - F.col("left"))})
    runs = runs.withColumn("at", F.col("r") * F.col("w") + F.col("c"))
    runs = runs.withColumn("next", F.coalesce(F.lead("at").over(Window.partitionBy("tile").orderBy("at")), F.col("h") * F.col("w")))
    runs = runs.withColumn("first", F.greatest("at", F.lit(0))).filter(F.col("first") < F.col("next"))
    cells = runs.select("top", "left", "w", "at", "v", F.explode(F.sequence("first", F.col("next") - 1)).alias("cell"))
    value = F.coalesce(F.when(F.col("cell") == F.col("at"), F.col("v")), F.lit(0))
    return cells.select((F.col("top") + F.floor(F.col("cell") / F.col("w"))).alias("i"), (F.col("left") + F.col("cell") % F.col("w")).alias("j"), value.alias("v"))


#: Rows and columns of a dense block: 8 B^2 bytes.
BLOCK = 256


def _blocks(a: SparseMatrix, row: str, col: str) -> DataFrame:
    """(row, col, e): the entries of each block that has any, with their place in it."""
    place = (F.col("i") % BLOCK * BLOCK + F.col("j") % BLOCK).cast("int")
    return a.df.groupBy(F.floor(F.col("i") / BLOCK).alias(row), F.floor(F.col("j") / BLOCK).alias(col)).agg(F.collect_list(F.struct(place.alias("at"), "v")).alias("e"))


def dense_multiply(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    """The product of two matrices as dense ones: every cell, zeros included. Blocks of BLOCK^2 cells meet on the inner index, one
    dense product for each pair of blocks; the sum over pairs is a grouped one."""
    a, b = a.merged().with_shape(), b.merged().with_shape()
    shape, kind = require_inner(a, b), a.df.schema["v"].dataType
    pairs = _blocks(a, "r", "k").withColumnRenamed("e", "x").join(_blocks(b, "k", "c").withColumnRenamed("e", "y"), "k").select("r", "c", "x", "y")

    def product(batches):
        import numpy as np
        import pyarrow as pa

        def dense(entries):
            v = entries.field("v").to_numpy(zero_copy_only=False)
            block = np.zeros(BLOCK * BLOCK, v.dtype)
            block[entries.field("at").to_numpy()] = v
            return block.reshape(BLOCK, BLOCK)

        for batch in batches:
            for n in range(batch.num_rows):
                r, c = batch.column(0)[n].as_py(), batch.column(1)[n].as_py()
                out = dense(batch.column(2)[n].values) @ dense(batch.column(3)[n].values)
                i, j = np.nonzero(out)
                yield pa.RecordBatch.from_arrays([pa.array(i + r * BLOCK, pa.int64()), pa.array(j + c * BLOCK, pa.int64()), pa.array(out[i, j])], names=["i", "j", "v"])

    products = pairs.mapInArrow(product, StructType([StructField("i", LongType()), StructField("j", LongType()), StructField("v", kind)]))
    return densify(SparseMatrix(products, shape))
