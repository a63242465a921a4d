"""Edges as a stream: the neighbour aggregate and degrees are maintained as edges arrive.

Sums don't depend on order, so late edges are no special case. State is a row for each source; senders
that may send an edge again are cut to first arrivals by event id within a watermark. Results are written by executors, never
gathered by the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillgrid.operators import features as packed


def edge_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once_each(edges: DataFrame, time: str, event_id: str = "event_id", delay: str = "10 minutes") -> DataFrame:
    """First arrivals only, as far back as the watermark."""
    return _timed(edges, time).withWatermark(time, delay).dropDuplicatesWithinWatermark([event_id])


def _timed(edges: DataFrame, time: str) -> DataFrame:
    """Watermarks need instants; local times are read in the session's zone."""
    return edges.withColumn(time, F.col(time).cast("timestamp"))


def maintained_aggregate(edges: DataFrame, features: DataFrame, dims: int) -> DataFrame:
    """(src, h array) over all edges so far; the packed feature table (node, x) is static. State is a row a source."""
    weight = F.col("w") if "w" in edges.columns else F.lit(1)
    joined = edges.select("src", "dst", weight.alias("w")).join(features.select(F.col("node").alias("dst"), "x"), "dst")
    return packed.summed(joined, "src", "x", F.col("w"), dims, "h")


def maintained_counts(edges: DataFrame) -> DataFrame:
    """(src, edges) so far."""
    return edges.groupBy("src").agg(F.count("*").alias("edges"))


def windowed_counts(edges: DataFrame, time: str, length: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(begin, src, edges) by windows of event time. In the modes append and update rows later than the watermark are dropped and
    their windows' state goes; complete keeps all windows and drops nothing."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    counted = _timed(edges, time).withWatermark(time, delay).groupBy(window.alias("window"), "src").agg(F.count("*").alias("edges"))
    return counted.select(F.col("window.start").alias("begin"), "src", "edges")


def drain(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there; its table. Executors write each batch below the folder: in mode complete the last one is the
    table, in mode append all are. A batch that runs again replaces itself."""
    spark, done = stream.sparkSession, []

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        done.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.parquet(f"{folder}/rows/batch={max(done)}")
    return spark.read.parquet(f"{folder}/rows").drop("batch")
