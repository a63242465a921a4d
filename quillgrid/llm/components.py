"""Connected components of a table of links, by alternating large-star and small-star steps.

Results: a link of a node with itself, and one that occurs again, add nothing; a link with a null end is left out; nodes without
another are not in the result; no links give an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of the links (a, b) the least node that can be reached.

    Large star: each node's larger neighbours are linked to its least neighbour. Small star: its smaller ones
    and itself. Both keep components and bring nodes to the root in a logarithmic number of rounds. Minima are
    aggregated before the shuffle; a hot node's links are joined, never gathered."""
    now = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())  # null ends go here
    state = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = stored(large.distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).filter("a <> b")
        now = stored(small.distinct())
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == state:
            return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
        state = new
