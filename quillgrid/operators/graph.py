"""Graphs: neighbour sums, a linear layer, and their maintenance when edges come or go.

A graph is a multigraph of edges (src, dst), a feature table is packed, (node, x) with an array a node (`features.packed`
makes one of long form), a layer's weights are (d, e, w). Aggregates are packed too, (src, h); `features.unpacked` makes
long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions.scalars import below
from quillgrid.matrix import SparseMatrix
from quillgrid.operators import features as packed


def edge_weights(edges: DataFrame) -> SparseMatrix:
    """Parallel edges merged into counts: the graph as a matrix."""
    merged = edges.groupBy(F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.count("*").alias("v"))
    return SparseMatrix(merged, None, True)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) of the nodes that have edges, parallel ones counted."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def node_count(edges: DataFrame) -> int:
    """The largest node plus one."""
    return edges.agg(F.coalesce(F.max(F.greatest("src", "dst")) + 1, F.lit(0))).first()[0]


def aggregate(edges: DataFrame, features: DataFrame, dims: int | None = None) -> DataFrame:
    """(src, h array): for each source the sum over its edges of the neighbours' features. Parallel edges count each;
    they are merged into weights first, so that each pair is joined once."""
    weights = edges.groupBy("src", "dst").agg(F.count("*").alias("w"))
    return weighted_aggregate(weights, features, dims)


def weighted_aggregate(edges: DataFrame, features: DataFrame, dims: int | None = None) -> DataFrame:
    """The same for edges (src, dst, w); negative weights take edges away."""
    dims = packed.dims_of(features) if dims is None else dims
    joined = edges.select("src", "dst", "w").join(features.select(F.col("node").alias("dst"), "x"), "dst")
    return packed.summed(joined, "src", "x", F.col("w"), dims, "h")


def aggregate_all(edges: DataFrame, features: DataFrame, nodes: int, dims: int) -> DataFrame:
    """The same for all nodes: 0 where a node has no edges."""
    every = edges.sparkSession.range(nodes).withColumnRenamed("id", "src").join(aggregate(edges, features, dims), "src", "left")
    return every.select("src", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.coalesce(F.get("h", d), F.lit(0))).alias("h"))


def transform(aggregated: DataFrame, weights: DataFrame) -> DataFrame:
    """(src, y array): the aggregate times a layer's weights (d, e, w), without a shuffle of the aggregate."""
    return packed.multiplied(aggregated, "src", "h", weights, "y")


def forward(edges: DataFrame, features: DataFrame, weights: DataFrame, dims: int | None = None) -> DataFrame:
    """Neighbour sums times weights; no normalisation, no activation."""
    return transform(aggregate(edges, features, dims), weights)


def append_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(new.select("src", "dst"))


def update_full(edges: DataFrame, new: DataFrame, features: DataFrame, dims: int | None = None) -> DataFrame:
    """The aggregate after an insertion, from all edges."""
    return aggregate(append_edges(edges, new), features, dims)


def update_delta(new: DataFrame, features: DataFrame, dims: int | None = None) -> DataFrame:
    """What new edges add to the aggregate. Only their neighbours' features are read."""
    return aggregate(new, features, dims)


def update_incremental(previous: DataFrame, delta: DataFrame) -> DataFrame:
    """The aggregate after an insertion, from the one before and what is added: sums are linear. A source of either side may be new."""
    joined = previous.join(delta.select("src", F.col("h").alias("_more")), "src", "full")
    none = F.array()
    sums = F.zip_with(F.coalesce("h", none), F.coalesce("_more", none), lambda p, q: F.when(p.isNull(), q).when(q.isNull(), p).otherwise(p + q))
    return joined.select("src", sums.alias("h"))


def new_edges(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates that aren't edges yet and aren't loops, each once."""
    return candidates.filter("src <> dst").join(edges, ["src", "dst"], "left_anti").select("src", "dst").distinct()


def sample_new_edges(edges: DataFrame, nodes: int, n: int, seed: int = 42) -> DataFrame:
    """n edges at most that the graph lacks: 100 n draws, those that are new in order of a hash."""
    spark = edges.sparkSession
    draws = spark.range(100 * n).select(below(nodes, seed, F.lit(0), F.col("id")).alias("src"), below(nodes, seed, F.lit(1), F.col("id")).alias("dst"))
    return new_edges(draws, edges).orderBy(F.xxhash64(F.lit(seed), "src", "dst"), "src", "dst").limit(n)


class AggregateState:
    """An aggregate that is carried from update to update in a folder all executors share.

    Sources lie in buckets by hash. An update reads the new edges, their neighbours' features and the buckets of the
    sources that they touch, and writes these buckets anew as a version; a list of each bucket's version is
    written last and makes the update count. What was there before stays readable."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self):
        return F.pmod(F.xxhash64("src"), F.lit(self.buckets)).cast("int")

    def versions(self) -> dict[int, int]:
        """Each bucket's version; one small row a bucket."""
        lists = self.spark.read.parquet(f"{self.path}/versions")
        return {r["b"]: r["v"] for r in lists.filter(F.col("at") == lists.agg(F.max("at")).first()[0]).collect()}

    def _write(self, rows: DataFrame, known: dict[int, int]) -> None:
        at = max(known.values(), default=-1) + 1
        folder = f"{self.path}/rows/v={at}"  # what a broken update has left there goes
        rows.withColumn("b", self._bucket()).repartition("b").sortWithinPartitions("src").write.partitionBy("b").mode("overwrite").parquet(folder)
        known = known | {r[0]: at for r in self.spark.read.parquet(folder).select("b").distinct().collect()}  # a number a bucket
        self.spark.createDataFrame([(at, b, v) for b, v in known.items()], "at int, b int, v int").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def start(self, aggregated: DataFrame) -> AggregateState:
        """Stores an aggregate (src, h) as the state."""
        self._write(aggregated.select("src", "h"), {})
        return self

    def _read(self, known: dict[int, int]) -> DataFrame:
        """The rows of the wanted versions of buckets."""
        by: dict[int, list[int]] = {}
        for b, v in known.items():
            by.setdefault(v, []).append(b)
        wanted = F.lit(False)
        for v, own in by.items():
            wanted = wanted | ((F.col("v") == v) & F.col("b").isin(own))
        return self.spark.read.parquet(f"{self.path}/rows").filter(wanted).select("src", "h")  # folders that aren't wanted are not read

    def load(self) -> DataFrame:
        """The aggregate (src, h) as it is now."""
        return self._read(self.versions())

    def update(self, new: DataFrame, features: DataFrame, dims: int | None = None) -> AggregateState:
        """Adds what new edges (src, dst[, w]) bring; a negative w takes edges away."""
        delta = weighted_aggregate(new, features, dims) if "w" in new.columns else update_delta(new, features, dims)
        known, touched = self.versions(), {r[0] for r in new.select(self._bucket()).distinct().collect()}
        before = self._read({b: v for b, v in known.items() if b in touched})
        self._write(update_incremental(before, delta), known)
        return self
