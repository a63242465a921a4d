"""Runs that report on themselves: sums and products from file to file, parallel against serial, full against incremental."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions.scalars import stamp, winner
from quillgrid.matrix import SparseMatrix
from quillgrid.operators import algebra, graph
from quillgrid.plans import reports, strategy
from quillgrid.sources import coo

RECORD = (
    "operation string, rows_a long, cols_a long, rows_b long, cols_b long, rows_c long, cols_c long, nnz_a long, nnz_b long, nnz_c long,"
    " density_a_pct double, density_b_pct double, density_c_pct double, flops long, partitions int, read_s double, compute_s double, total_s double"
)


class _Clock:
    def __init__(self):
        self.at = self.begun = time.perf_counter()

    def lap(self) -> float:
        last, self.at = self.at, time.perf_counter()
        return self.at - last


def _density(nnz: int, shape: tuple[int, int]) -> float:
    cells = shape[0] * shape[1]
    return 100.0 * nnz / cells if cells else 0.0


def fitting(a: SparseMatrix, b: SparseMatrix, operation: str) -> tuple[SparseMatrix, SparseMatrix]:
    """Merged, with sizes; sizes that are only inferred from entries are widened until they fit the operation."""
    inferred, (a, b) = a.shape is None and b.shape is None, (m.merged().with_shape() for m in (a, b))
    if not inferred:
        return a, b
    if operation == "add":
        both = tuple(max(x, y) for x, y in zip(a.shape, b.shape, strict=True))
        return replace(a, shape=both), replace(b, shape=both)
    inner = max(a.shape[1], b.shape[0])
    return replace(a, shape=(a.shape[0], inner)), replace(b, shape=(inner, b.shape[1]))


def run(spark: SparkSession, operation: str, path_a: str, path_b: str, out: str, shapes: tuple | None = None, double: bool = False) -> DataFrame:
    """Adds or multiplies two coordinate files, writes the result, and returns one record: sizes, shapes, densities, multiplications and additions
    (two a product), seconds by phase, entries a second, time of the run."""
    clock = _Clock()
    shape_a, shape_b = shapes or (None, None)
    a, b = fitting(*(coo.read_coo(spark, p, s, double=double) for p, s in ((path_a, shape_a), (path_b, shape_b))), operation)
    nnz_a, nnz_b = a.nnz(), b.nnz()
    read = clock.lap()
    c = {"add": algebra.add, "multiply": algebra.multiply}[operation](a, b)
    coo.write_coo(c, out)
    compute = clock.lap()
    nnz_c = coo.count_lines(spark, out, blank=False)
    flops = 2 * (algebra.product_counts(a, b).agg(F.sum("products")).first()[0] or 0) if operation == "multiply" else nnz_a + nnz_b - nnz_c
    row = (operation, *a.shape, *b.shape, *c.shape, nnz_a, nnz_b, nnz_c, _density(nnz_a, a.shape), _density(nnz_b, b.shape), _density(nnz_c, c.shape), flops, spark.sparkContext.defaultParallelism, read, compute, read + compute)
    record = spark.createDataFrame([row], RECORD)
    return record.withColumn("entries_per_second", (F.col("nnz_a") + F.col("nnz_b")) / F.col("total_s")).withColumn("at", stamp())


def phases(record: DataFrame) -> DataFrame:
    """(phase, seconds, pct) of a run's record."""
    long = record.select(F.explode(F.array(*(F.struct(F.lit(p).alias("phase"), F.col(f"{p}_s").alias("seconds")) for p in ("read", "compute")))).alias("p")).select("p.*")
    return reports.phase_shares(long)


def parallel_or_serial(spark: SparkSession, work: Callable[[], DataFrame], runs: int = 3) -> DataFrame:
    """One record: seconds of a query with all of its partitions and with one, their quotient, and which was faster."""
    key, found = "spark.sql.shuffle.partitions", {}
    held = spark.conf.get(key)
    try:
        for name, partitions in (("parallel", held), ("serial", "1")):
            spark.conf.set(key, partitions)
            times = []
            for _ in range(runs):
                clock = _Clock()
                rows = work()
                (rows if name == "parallel" else rows.coalesce(1)).write.format("noop").mode("overwrite").save()
                times.append(clock.lap())
            found[name] = sum(times) / len(times)
    finally:
        spark.conf.set(key, held)
    one = spark.createDataFrame([(found["parallel"], found["serial"])], "parallel_s double, serial_s double")
    speedup = F.col("serial_s") / F.col("parallel_s")
    return one.withColumn("speedup", speedup).withColumn("winner", winner(speedup, "parallel", "serial"))


def sparse_or_dense(spark: SparkSession, a: SparseMatrix, b: SparseMatrix, runs: int = 3) -> DataFrame:
    """One record: mean and deviation of the seconds that a product takes sparse and dense, speedup, winner, densities, MB of the operands either way."""
    a, b = fitting(a, b, "multiply")
    ways = (("sparse", lambda: algebra.multiply(a, b).df), ("dense", lambda: algebra.dense_multiply(a, b)))
    times = reports.timed(spark, *ways[0], runs=runs).unionByName(reports.timed(spark, *ways[1], runs=runs))
    each = reports.summary(times)
    sides = [each.filter(F.col("name") == n).select(F.col("mean").alias(f"{n}_s"), F.col("std").alias(f"{n}_std")) for n, _ in ways]
    nnz_a, nnz_b = a.nnz(), b.nnz()
    sizes = [F.lit(x).alias(n) for n, x in (("nnz_a", nnz_a), ("nnz_b", nnz_b), ("density_a_pct", _density(nnz_a, a.shape)), ("density_b_pct", _density(nnz_b, b.shape)))]
    speedup = F.col("dense_s") / F.col("sparse_s")
    record = sides[0].crossJoin(sides[1]).crossJoin(strategy.memory_footprint(a, b))  # a row each
    return record.select(*sizes, "*", speedup.alias("speedup"), winner(speedup, "sparse", "dense").alias("winner"))


def full_or_incremental(spark: SparkSession, edges: DataFrame, features: DataFrame, dims: int, folder: str, added: Iterable[int] = (1, 2, 3), seed: int = 42) -> DataFrame:
    """A record for each number of new edges: seconds to work the aggregate out anew and to update the stored one (its touched
    buckets are read, merged and written), speedup, winner, and whether the two agree."""
    nodes, n, records = graph.node_count(edges), edges.count(), []
    graph.AggregateState(spark, f"{folder}/warm").start(graph.aggregate(edges, features, dims)).update(graph.sample_new_edges(edges, nodes, 1, seed - 1), features, dims)
    for k in added:
        new = graph.sample_new_edges(edges, nodes, k, seed + k)
        new = spark.createDataFrame([tuple(r) for r in new.collect()], "src long, dst long")  # k edges
        state = graph.AggregateState(spark, f"{folder}/{k}").start(graph.aggregate(edges, features, dims))
        clock = _Clock()
        graph.update_full(edges, new, features, dims).write.mode("overwrite").parquet(f"{folder}/full-{k}")
        full = clock.lap()
        state.update(new, features, dims)
        incremental = clock.lap()
        both = spark.read.parquet(f"{folder}/full-{k}").join(state.load().select("src", F.col("h").alias("own")), "src", "full")
        apart = F.exists(F.zip_with("h", "own", lambda x, y: F.coalesce(F.abs(x - y) > 1e-6 * (1 + F.abs(x)), x.isNull() != y.isNull())), lambda e: e)
        same = both.filter(F.coalesce(apart, F.lit(True))).isEmpty()
        records.append((nodes, n, k, full, incremental, same))
    out = spark.createDataFrame(records, "num_nodes long, num_edges long, edges_added int, full_recomputation_s double, incremental_update_s double, agree boolean")
    speedup = F.col("full_recomputation_s") / F.col("incremental_update_s")
    return out.withColumn("speedup", speedup).withColumn("winner", winner(speedup, "incremental", "full"))
