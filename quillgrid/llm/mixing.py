"""Operator 10 [native]: mixing sources to target weights by pivotal dependent rounding.

A source's target in words gives its documents a fractional number of copies. Its whole part is
given; the fractions are rounded by pairs: words are moved from one document to the other, in a
direction drawn so that each expectation stays, until one fraction is 0 or 1. What a pair leaves
fractional meets the next document. Groups of about GROUP documents of a source and a power of two of sizes are folded
at once, their residuals are folded in groups of GROUP, and so on: a reduction tree over all the
cluster. At its root a source's residuals, one for each power of two, meet the documents that have been kept
back for it (one group of each), larger ones first, so that small documents settle what large ones leave. One
fraction a source is left, and is drawn. No draw is ever turned: every document's
expected copies are its source's target over its size, and a source's words are its target but for one document.

Draws are hashes of ids and texts: a rerun gives the same mix. Rows alike in id, source and text are one item
of so many rows: the whole copies of their sum are shared out evenly, only the rest is drawn. Sources are counted and
numbered in ranges; the level of their targets is found by Newton steps over one aggregate each.

Results: rows of null source are a source of their own, the last; rows of null id take part as all others; rows without
words, and those of null text, take no part (taken 0; mix leaves them out); repeated rows come back each, none
of them more than twice; an empty table gives an empty table; other columns, of any name, are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, size_in_words, stored, table

WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes; times that a document can be taken.
SHARE, MOST = 1.5, 2.0
GROUP = 32
#: Fractions nearer to 0 or 1 than this are whole.
WHOLE = 1e-12


def source_targets(each: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Rows (source, source_size, ...), one a source, with their target: by weight in order of sources, null last; those
    above `most` times their source's size stop there and the excess is reshared by weight until none is above."""
    each = numbered(each, F.col("source").asc_nulls_last())
    each = stored(each.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1).cast("double")))
    size = F.col("source_size")
    total, every = each.agg(F.sum("source_size"), F.sum("w")).first()
    level, stopped = share * (total or 0) / (every or 1), -1
    while True:  # the sum of targets is concave in the level: steps from below end at the exact set of sources that stop
        stops = most * size <= level * F.col("w")
        n, held, left = each.agg(F.count_if(stops), F.sum(F.when(stops, most * size)), F.sum(F.when(~stops, F.col("w")))).first()
        if n == stopped or not left:
            break
        stopped, level = n, (share * total - (held or 0)) / left
    return each.withColumn("target", F.least(most * size, F.lit(float(level)) * F.col("w"))).drop("place", "w")


def _draw(*keys: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(F.lit("draw"), *keys), 11).cast("double") + 0.5) / float(1 << 53)


def _fold(items: Column, kind: str) -> Column:
    """Folds an array of fractional items: (items decided for or against a further copy, the item left fractional)."""
    start = F.expr(f"named_struct('done', cast(array() as array<{kind}>), 'left', cast(null as {kind}))")

    def moved(i: Column, x: Column) -> Column:
        return i.withField("x", x)

    def meet(state: Column, b: Column) -> Column:
        a = state["left"]
        a_more, a_less, b_more, b_less = (1 - a["x"]) * a["size"], a["x"] * a["size"], (1 - b["x"]) * b["size"], b["x"] * b["size"]
        up, down = F.least(a_more, b_less), F.least(a_less, b_more)  # words that can go to a, and from a
        rise = _draw(a["key"], b["key"]) * (up + down) < down
        # what is exhausted is set to 0 or 1 outright
        a_x = F.when(rise, F.when(up == a_more, F.lit(1.0)).otherwise(a["x"] + up / a["size"])).otherwise(F.when(down == a_less, F.lit(0.0)).otherwise(a["x"] - down / a["size"]))
        b_x = F.when(rise, F.when(up == b_less, F.lit(0.0)).otherwise(b["x"] - up / b["size"])).otherwise(F.when(down == b_more, F.lit(1.0)).otherwise(b["x"] + down / b["size"]))
        pair = F.array(moved(a, a_x), moved(b, b_x))
        open_ = F.filter(pair, lambda i: (i["x"] > WHOLE) & (i["x"] < 1 - WHOLE))
        done = F.concat(state["done"], F.filter(pair, lambda i: (i["x"] <= WHOLE) | (i["x"] >= 1 - WHOLE)))
        return F.when(a.isNull(), F.struct(state["done"].alias("done"), b.alias("left"))).otherwise(F.struct(done.alias("done"), F.get(open_, F.lit(0)).alias("left")))

    return F.aggregate(items, start, meet)


_KEYS = ("source", "class", "bucket")


def _level(items: DataFrame, kind: str) -> DataFrame:
    """One level of the tree: (source, class, bucket, done, left)."""
    grouped = items.groupBy(*_KEYS).agg(F.sort_array(F.collect_list("item")).alias("items"))
    return grouped.select(*_KEYS, _fold(F.col("items"), kind).alias("f")).select(*_KEYS, "f.done", "f.left")


def _group_counts(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...]) -> DataFrame:
    """(doc_id, source, h, size, rows, source_size, target, total): rows alike in id, source and text's hash, and how often they are taken in all.
    Texts are read once and never shuffled."""
    each = df.select(df[id_col].cast("long").alias("doc_id"), df[source_col].cast("string").alias("source"), F.xxhash64(df[text_col].cast("string")).alias("h"), size_in_words(df[text_col].cast("string")).alias("size"))
    each = stored(each.groupBy("doc_id", "source", "h", "size").agg(F.count("*").alias("rows")))
    size_class = F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int")
    classes = each.groupBy("source", size_class.alias("class")).agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("rows")).alias("words"))
    sources = classes.groupBy("source").agg(F.sum("words").alias("source_size"), F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("classes"))  # 64 classes a source
    sources = stored(source_targets(stored(sources), weights).withColumnRenamed("source", "own"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = each.join(sources, F.col("source").eqNullSafe(F.col("own"))).drop("own")
    rated = rated.withColumns({"class": size_class, "rate": rate, "key": F.xxhash64(F.lit("item"), "doc_id", "source", "h")})
    buckets = F.ceil(F.element_at("classes", F.col("class")) / GROUP)
    part = F.col("rows") * (F.col("rate") - F.floor("rate"))
    rated = rated.select(
        "source",
        "class",
        F.pmod(F.xxhash64(F.lit("bucket"), "key"), buckets).alias("bucket"),
        F.struct(
            "key",
            F.col("size").cast("double").alias("size"),
            (part - F.floor(part)).alias("x"),
            F.struct("doc_id", "h", "rows", "source_size", "target", (F.col("rows") * F.floor("rate") + F.floor(part)).cast("long").alias("whole")).alias("row"),
        ).alias("item"),
    )
    rated = stored(rated.withColumn("kept", F.when((F.col("item.size") == 0) | (F.col("item.x") <= WHOLE), -1).when(F.col("bucket") == 0, 0).otherwise(1)))
    kind = rated.schema["item"].dataType.simpleString()

    def decided(done: DataFrame, more: Column) -> DataFrame:
        whole = F.when(F.col("item.size") > 0, F.col("item.row.whole") + more.cast("long")).otherwise(F.lit(0).cast("long"))
        own = [F.col(f"item.row.{n}") for n in ("h", "rows", "source_size", "target")]
        return done.select("item.row.doc_id", "source", F.col("item.size").cast("long").alias("size"), *own, whole.alias("total"))

    out = [decided(rated.filter("kept < 0"), F.lit(0))]
    taken = F.col("item.x") >= 0.5
    width = sources.agg(F.max(F.array_max(F.map_values("classes")))).first()[0] or 0
    width = -(-width // GROUP) - 1  # but for the group that is kept back
    items = rated.filter("kept = 1").select("source", "class", F.floor((F.col("bucket") - 1)).alias("bucket"), "item")
    while width > 0:
        level = stored(_level(items, kind))
        out.append(decided(level.select("source", F.explode("done").alias("item")), taken))
        items = level.filter("left IS NOT NULL").select("source", "class", F.floor(F.col("bucket") / GROUP).alias("bucket"), F.col("left").alias("item"))
        width = 0 if width == 1 else -(-width // GROUP)
    last = items.select("source", "class", "item").unionByName(rated.filter("kept = 0").select("source", "class", "item"))
    last = last.groupBy("source").agg(F.sort_array(F.collect_list(F.struct((-F.col("class")).alias("by"), "item"))).alias("items"))  # a group of each class
    root = stored(last.select("source", _fold(F.col("items.item"), kind).alias("f")).select("source", "f.done", "f.left"))
    out.append(decided(root.select("source", F.explode("done").alias("item")), taken))
    out.append(decided(root.filter("left IS NOT NULL").select("source", F.col("left").alias("item")), _draw(F.lit("root"), F.col("item.key")) < F.col("item.x")))
    counts = out[0]
    for o in out[1:]:
        counts = counts.unionByName(o)
    return counts


def copy_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per row: (doc_id, size, source_size, target, copies)."""
    counts = _group_counts(df, id_col, text_col, source_col, weights)
    each = counts.select("doc_id", "size", "source_size", "target", "rows", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("rank"))
    return each.select("doc_id", "size", "source_size", "target", _share().alias("copies"))


def _share() -> Column:
    """What the row of a rank among so many rows gets of their total."""
    return F.floor(F.col("total") / F.col("rows")) + (F.col("rank") < F.col("total") % F.col("rows")).cast("long")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: each row as many times as it is taken, its columns as they are."""
    counts = stored(_group_counts(df, id_col, text_col, source_col, weights).select(F.col("doc_id").alias("i"), F.col("source").alias("s"), "h", "rows", "total"))
    keyed = df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row"), df[id_col].cast("long").alias("doc_id"), df[source_col].cast("string").alias("source"), F.xxhash64(df[text_col].cast("string")).alias("hash"))
    met = keyed.join(counts.filter("total > 0"), (F.col("hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")))
    taken = met.filter("rows = 1").select("row", F.col("total").alias("copies"))
    if not counts.filter("rows > 1 AND total > 0").isEmpty():
        # ranks within a task's rows, and the rows of tasks before
        many = stored(met.filter("rows > 1").select("row", "i", "s", "h", "rows", "total", F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33)))
        keys = ("i", "s", "h")
        before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        first = many.groupBy(*keys, "part").agg(F.count("*").alias("n")).select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("part").alias("part_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
        within = F.row_number().over(Window.partitionBy(*keys, "part").orderBy("at")) - 1
        ranked = many.withColumn("rank", within).join(first, (F.col("part") == F.col("part_")) & (F.col("h") == F.col("h_")) & F.col("i").eqNullSafe(F.col("i_")) & F.col("s").eqNullSafe(F.col("s_")))
        ranked = ranked.withColumn("rank", F.col("rank") + F.col("first"))
        taken = taken.unionByName(ranked.select("row", _share().alias("copies")))
    copies = taken.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return copies.select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = copy_counts(table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op10_mixing": op10_mixing}
ORACLES: dict[str, str] = {}
