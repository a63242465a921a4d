"""Dense feature tables in packed form: (node, x) with an array of components a node.

A join carries an array once for each edge instead of a row for each edge and component; sums over a key are
one aggregate for each component, so they combine on the map side within generated code. A component that an array lacks
adds nothing; a sum without any addend is null in packed form and absent in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components that are summed as columns at once; longer arrays are summed by place.
COLUMNS = 256


def packed(long: DataFrame, key: str = "node", place: str = "d", value: str = "x", dims: int | None = None) -> DataFrame:
    """(key, value array) of rows (key, place, value); places that a key lacks are null."""
    dims = _dims(long.select((F.max(place) + 1).alias("n"))) if dims is None else dims
    pairs = long.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(place).cast("int"), F.col(value)))).alias("_m"))
    return pairs.select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.try_element_at("_m", d)).alias(value) if dims else F.array().alias(value))


def unpacked(rows: DataFrame, key: str, value: str, place: str = "d", name: str | None = None) -> DataFrame:
    """(key, place, value) of the components that aren't null."""
    long = rows.select(key, F.posexplode(value).alias(place, name or value))
    return long.filter(F.col(name or value).isNotNull()).withColumn(place, F.col(place).cast("long"))


def dims_of(rows: DataFrame, value: str = "x") -> int:
    """The length of the longest array."""
    return _dims(rows.select(F.max(F.size(value)).alias("n")))


def _dims(one: DataFrame) -> int:
    return int(one.first()[0] or 0)


def summed(rows: DataFrame, key: str, value: str, weight: Column, dims: int, name: str) -> DataFrame:
    """(key, name array): for each key the sum of its rows' arrays, each times its weight."""
    if 0 < dims <= COLUMNS:
        sums = rows.groupBy(key).agg(*(F.sum(weight * F.get(value, F.lit(d))).alias(f"_{d}") for d in range(dims)))
        return sums.select(key, F.array(*(f"_{d}" for d in range(dims))).alias(name))
    long = rows.select(key, weight.alias("_w"), F.posexplode(value).alias("_d", "_x"))
    return packed(long.groupBy(key, "_d").agg(F.sum(F.col("_w") * F.col("_x")).alias(name)), key, "_d", name, dims)


#: Numbers of a layer that is sent to every task: 8 MB.
LAYER = 1 << 20


def multiplied(rows: DataFrame, key: str, value: str, weights: DataFrame, name: str) -> DataFrame:
    """(key, name array): each array times a matrix (d, e, w). A matrix of up to LAYER numbers, counted first, becomes one row of arrays that
    meets every row where it lies, so that nothing is shuffled; a larger one is joined by component."""
    if weights.limit(LAYER + 1).count() > LAYER:
        joined = unpacked(rows, key, value, "d", "_x").join(weights, "d")
        return packed(joined.groupBy(key, "e").agg(F.sum(F.col("_x") * F.col("w")).alias(name)), key, "e", name)

    def placed(by: str, v: str) -> tuple[Column, Column]:
        """The values by place, as a map, and the last place."""
        return F.map_from_entries(F.collect_list(F.struct(F.col(by).cast("int"), F.col(v)))).alias("_m"), F.max(F.col(by).cast("int")).alias("_top")

    def by_place(name: str) -> Column:
        return F.transform(F.sequence(F.lit(0), "_top"), lambda k: F.try_element_at("_m", k)).alias(name)

    columns = weights.groupBy("e").agg(*placed("d", "w")).select("e", by_place("w"))
    layer = columns.agg(*placed("e", "w")).select(by_place("_layer"))
    whole = {rows.schema[value].dataType.elementType.typeName(), weights.schema["w"].dataType.typeName()} <= {"long", "integer", "short", "byte"}
    kind = "bigint" if whole else "double"
    zero = F.lit(0).cast(kind)

    def dot(w: Column) -> Column:
        return F.aggregate(F.zip_with(value, w, lambda x, y: F.coalesce((x * y).cast(kind), zero)), zero, lambda s, p: s + p)

    return rows.crossJoin(F.broadcast(layer)).select(key, F.transform("_layer", dot).alias(name))
