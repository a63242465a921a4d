r"""Operator 5 [native]: document fingerprints by consistent weighted sampling.

A text's terms are its words ``[^\x20\x09-\x0D]+``; a term's weight S is its count. For each of SAMPLES samples
and each term, r and c are Gamma(2, 1) and b is uniform, all drawn by hashes of term and sample;
t = floor(ln S / r + b), and the term with the least ln c - r (t - b + 1) is sampled, with its t. Two texts agree
in a sample with the probability of their generalised Jaccard similarity: the sum of the lesser counts over the
sum of the greater ones. A fingerprint is the samples' hashes of 24 bits, in hexadecimal digits; the likeness of two is
the share of samples that agree, with a standard error of 1 / (2 sqrt(SAMPLES)) at most.

A text's words are hashed and sorted in one array and counted as the distances between the last ones of equal
hashes. A value and its hash are packed into one whole number, so that a sample is a plain minimum. Texts are shuffled
once by id and hash; next texts' beginnings are sent to where they are needed; terms are never shuffled.

Results: rows come back one for one. Their order is that of ids, null last, then of the texts' hashes; rows alike in
both are worked on once, each but the last of them followed by its like. Null and empty texts have no terms and a fingerprint of f
digits, like each other's (1.0) and no text's with terms; a single row is its own next; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, two_columns

SAMPLES = 32
_MASK = (1 << 24) - 1
#: Ids that are numbered together, about.
TOGETHER = 100_000


def _uniform(h: Column, low: bool) -> Column:
    """One of the two halves of a hash as a number between 0 and 1."""
    half = h.bitwiseAND(F.lit(0xFFFFFFFF)) if low else F.shiftrightunsigned(h, 32)
    return (half.cast("double") + 0.5) * (1.0 / (1 << 32))


def _packed_sample(term: Column, log_weight: Column, k: int) -> Column:
    """A term's value in sample k, above the hash of the term and its t."""
    h1, h2 = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    h3 = F.xxhash64(term, F.lit(-1 - k))
    r = -F.log(_uniform(h1, True) * _uniform(h1, False))
    c = -F.log(_uniform(h2, True) * _uniform(h2, False))
    b = _uniform(h3, True)
    t = F.floor(log_weight / r + b)
    value = ((F.log(c) - r * (t - b + 1.0)) + 8192.0) * float(1 << 25)  # 39 bits, for values from -8192 on
    return F.shiftleft(value.cast("long"), 24).bitwiseOR(F.pmod(h3 + t * 0x9E3779B1, F.lit(_MASK)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression that uses a value, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_counts(text: Column) -> Column:
    """array<struct<term, n>>: the hashes of a text's distinct words and their counts; what blanks at its ends leave comes as the empty word."""

    def ends(terms: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(terms) - 1), lambda i: F.coalesce(F.get(terms, i + 1) != F.get(terms, i), F.lit(True)))

    def counted(terms: Column) -> Column:
        return _let(ends(terms), lambda last: F.transform(last, lambda e, k: F.struct(F.get(terms, e).alias("term"), (e - F.coalesce(F.get(last, k - 1), F.lit(-1))).alias("n"))))

    return _let(F.sort_array(F.transform(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))), counted)


def signatures(texts: DataFrame, keys: list[str], text_col: str, samples: int = SAMPLES) -> DataFrame:
    """(keys, signature array<int>) of texts that have terms. Rows must lie by a subset of keys for no shuffle to be needed."""
    each = texts.select(*keys, F.explode(term_counts(F.col(text_col))).alias("t")).select(*keys, F.col("t.term").alias("term"), F.log("t.n").alias("log_weight"))
    each = each.filter(F.col("term") != F.xxhash64(F.lit("")))
    least = each.groupBy(*keys).agg(*(F.min(_packed_sample(F.col("term"), F.col("log_weight"), k)).alias(f"s{k}") for k in range(samples)))
    return least.select(*keys, F.array(*(F.col(f"s{k}").bitwiseAND(F.lit(_MASK)).cast("int") for k in range(samples))).alias("signature"))


_KEY = ("gone", "id", "h")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(distinct texts by key, rows of each key with their number): a key is an id, or none, and a text's hash."""
    docs = two_columns(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.select(F.col("doc_id").isNull().alias("gone"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("h"), "text")
    groups = stored(docs.groupBy(*_KEY).agg(F.max(F.length("text")).cast("long").alias("n_chars"), F.count("*").alias("rows")))
    return (docs if groups.filter("rows > 1").isEmpty() else docs.groupBy(*_KEY).agg(F.min("text").alias("text"))), groups


def _nexts(groups: DataFrame) -> DataFrame:
    """The keys with `next`, the key after them in ascending order, after the last the first. Ranges are ordered apart; only their ends meet."""
    parts = max(1, -(-groups.count() // TOGETHER))
    ranged = stored(groups.repartitionByRange(parts, *_KEY).withColumn("part", F.spark_partition_id()))
    after = F.lead(F.struct(*_KEY)).over(Window.partitionBy("part").orderBy(*_KEY))
    ends = ranged.groupBy("part").agg(F.min(F.struct(*_KEY)).alias("first"))  # a row a range
    ends = ends.select("part", F.coalesce(F.lead("first").over(Window.orderBy("part")), F.min("first").over(Window.partitionBy())).alias("beyond"))
    return ranged.withColumn("after", after).join(ends, "part").select(*_KEY, "n_chars", "rows", F.coalesce("after", "beyond").alias("next"))


def _hex(signature: Column) -> Column:
    return F.concat_ws("", F.transform(signature, lambda s: F.lpad(F.lower(F.hex(s)), 6, "0")))


def likeness(a: Column, b: Column) -> Column:
    """The share of samples that agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def fingerprint(df: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, signature) of every row."""
    docs, groups = _keyed(df, id_col, text_col)
    found = groups.join(signatures(docs, list(_KEY), "text", samples), list(_KEY), "left").withColumn("signature", F.coalesce("signature", F.array_repeat(F.lit(_MASK), samples)))
    return found.select(_doc_id(), _hex(F.col("signature")).alias("fingerprint"), "signature", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("row")).drop("row")


def _doc_id() -> Column:
    return F.when(~F.col("gone"), F.col("id")).alias("doc_id")


def edited_fingerprints(df: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of the text edited with the next document's beginning, and their likeness."""
    docs, groups = _keyed(df, id_col, text_col)
    order, own = stored(_nexts(groups)), F.struct(*_KEY)
    # a key's last row needs the next key, its other rows the key itself
    known = _edited(docs, order.select(*_KEY, "n_chars", "next", F.lit(1).cast("long").alias("times")), samples)
    after = known.select(own.alias("next"), F.col("own").alias("following"))
    if not groups.filter("rows > 1").isEmpty():
        known = known.unionByName(_edited(docs, order.filter("rows > 1").select(*_KEY, "n_chars", own.alias("next"), (F.col("rows") - 1).alias("times")), samples))
    found = known.join(after, "next").select(
        _doc_id(),
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        _hex(F.col("own")).alias("fingerprint"),
        _hex(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("row"),
    )
    return found.drop("row")


def _edited(docs: DataFrame, asked: DataFrame, samples: int) -> DataFrame:
    """(key, n_chars, next, times, sha, own, changed) for each key that asks for the beginning of its next text."""
    key = list(_KEY)
    heads = docs.join(asked.select(F.struct(*_KEY).alias("asking"), F.floor(F.col("n_chars") / 2).cast("int").alias("half"), "times", "next.*"), key)
    heads = heads.select("asking.*", "times", F.struct(*_KEY).alias("next"), F.expr("substring(text, 1, half)").alias("head"))
    half = F.floor(F.length("text") / 2).cast("int")
    both = docs.join(heads, key).select(*key, "times", "next", "text", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.col("head")).alias("edited"))
    sides = both.select(*key, F.posexplode(F.array("text", "edited")).alias("side", "text"))
    none = F.array_repeat(F.lit(_MASK), samples)
    each = signatures(sides, [*key, "side"], "text", samples)
    pairs = each.groupBy(*key).agg(*(F.max(F.when(F.col("side") == s, F.col("signature"))).alias(n) for s, n in enumerate(("own", "changed"))))
    plain = both.select(*key, "times", "next", F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("sha"))
    return stored(plain.join(pairs, key, "left").withColumns({c: F.coalesce(c, none) for c in ("own", "changed")}))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op5_fingerprints": op5_fingerprints}
ORACLES: dict[str, str] = {}
