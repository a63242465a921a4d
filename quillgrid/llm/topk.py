"""Operator 9: exact top-k search by inner product with MaxScore.

Vectors become integers, floor(64 x). A query's terms are its dimensions; a term's score is
shifted to begin at 0 at the worst value of a shard's postings, its bound is the range. In each
shard a query's terms are split by bounds: non-essential are the terms of least bounds that
together can't lift a vector over the k-th best score known. The postings of essential terms are
traversed for all vectors; the other terms are probed, by falling bounds, only for vectors that can
still compete. A shard keeps its k best; the shards' lists are merged.

Queries and shards are blocks: each shard meets each block of queries once, so what a task holds
is bounded by the blocks' sizes, whatever the number of rows.

Results: vectors null, or holding null or non-finite components, take no part, nor do rows of null
id. Vectors of another length than a query's share no score with it. Ties go to the smaller
vec_id. Rows repeating an id are candidates each, and never their own query's; a repeated query
comes out once, as the row of the least vector. Scores are 64-bit whole numbers and wrap beyond them. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_workers, stored, table, worker_state

#: Vectors of a shard and queries of a block, about.
SHARD, BLOCK = 8192, 512
#: Terms that are probed between two looks at who still competes.
PROBE = 8
#: Vectors that drop out are set aside once only this share is left.
FEW = 0.5
KINDS = (np.int8, np.int16, np.int32, np.int64)
PACKED = "width int, part int, ids binary, vectors binary"
FOUND = "query_id long, vec_id long, score long"


def scaled(df: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>) of the valid rows: floor(scale * component)."""
    v = df[vector_col].cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(df[id_col].cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.filter(F.coalesce(finite, F.lit(False))).select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def _packed(rows: DataFrame, part: int, total: int) -> DataFrame:
    """Blocks of about `part` vectors of one length, as bytes: whole numbers of the least width that holds a block's.

    The row's place is part of the hash, so that rows alike, however many, lie in many blocks."""
    parts = max(1, -(-total // part))

    def pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("top k",), dict)
        t = pa.Table.from_batches(list(batches))
        ids = t["vec_id"].to_numpy().astype(np.int64)
        width, number = (k.as_py() for k in key)
        vectors = t["v"].combine_chunks().flatten().to_numpy().astype(np.int64).reshape(len(ids), width)
        by = np.lexsort((*vectors.T[::-1], ids))
        low, high = vectors.min(initial=0), vectors.max(initial=0)
        vectors = vectors.astype(next(k for k in KINDS if np.iinfo(k).min <= low and high <= np.iinfo(k).max))
        yield pa.RecordBatch.from_arrays(
            [pa.array([width], pa.int32()), pa.array([number], pa.int32()), pa.array([ids[by].tobytes()]), pa.array([vectors[by].tobytes()])], names=["width", "part", "ids", "vectors"]
        )

    keyed = rows.withColumn("width", F.size("v")).withColumn("part", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(parts)).cast("int"))
    return keyed.groupBy("width", "part").applyInArrow(pack, PACKED)


def _vectors(raw: bytes, n: int, width: int) -> np.ndarray:
    """A block's vectors, a row each."""
    kind = np.dtype(f"i{len(raw) // (n * width)}") if width else np.dtype("i8")
    return np.frombuffer(raw, kind).reshape(n, width).astype(np.int64)


def _search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of a shard for each query: (queries, vec_ids, scores). x: a shard's postings, a row a dimension."""
    if x.shape[0] == 0:
        x, queries = np.zeros((1, len(ids)), np.int64), np.zeros((len(queries), 1), np.int64)
    low, high = x.min(axis=1), x.max(axis=1)
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[0] < 2**22
    kind = np.float32 if exact else np.int64  # whole numbers below 2^24 are exact in either
    wide = x.astype(kind)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for query_id, q in zip(query_ids.tolist(), queries, strict=True):
        bound = np.where(q >= 0, q * (high - low), q * (low - high))
        base = int(np.where(q >= 0, q * low, q * high).sum())  # of a vector that is worst in each term
        order = np.argsort(-bound, kind="stable")
        rest = base + np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # best score from the terms not seen yet
        qs = q[order].astype(kind)
        worst = np.where(q >= 0, q * low, q * high)[order]
        # the k-th best of a few vectors that are good in the largest terms: a score that k vectors reach
        head = np.zeros(x.shape[1], kind)
        at = 0
        if at < (to := min(8, len(order))):
            head = qs[at:to] @ wide[order[at:to]]
            at = to
        seed = np.argpartition(-head, min(len(head) - 1, 4 * k))[: 4 * k + 1]
        seed = seed[ids[seed] != query_id]
        full = np.sort(qs @ wide[np.ix_(order, seed)])[::-1]
        least = full[k - 1] if len(full) >= k else -np.inf
        # essential terms: all but those of least bounds that can't reach it together
        essential = int(np.searchsorted(-rest, -least, "right")) if least > -np.inf else len(order)
        if at < (to := min(essential, len(order))):
            head = head + qs[at:to] @ wide[order[at:to]]
            at = to
        alive, score = np.arange(len(ids)), head
        while at < len(order):
            if least > -np.inf:  # who can still reach the score
                competes = np.flatnonzero(score + float(rest[at] - int(worst[:at].sum())) >= least)
                if len(competes) < FEW * len(alive):
                    alive, score = alive[competes], score[competes]
            to = min(at + PROBE, len(order))
            some = wide[order[at:to]] if len(alive) == len(ids) else wide[np.ix_(order[at:to], alive)]
            score = score + qs[at:to] @ some
            at = to
        keep = ids[alive] != query_id
        alive, score = alive[keep], score[keep].astype(np.int64)
        best = np.lexsort((ids[alive], -score))[:k]
        out.append((np.full(len(best), query_id), ids[alive][best], score[best]))
    empty = np.empty(0, np.int64)
    return tuple(np.concatenate([o[n] for o in out] or [empty]) for n in range(3))  # type: ignore[return-value]


def top_k(df: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best of df for each row of queries: (query_id, rank, vec_id, score)."""
    rows, asked = scaled(df, scale, id_col, vector_col), scaled(queries, scale, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    shards = stored(_packed(rows, SHARD, df.count()))
    blocks = stored(_packed(asked, BLOCK, queries.count()))
    places = shards.groupBy("width").agg(F.collect_list("part").alias("parts"))  # numbers of blocks alone
    dealt = blocks.select("width", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries")).join(places, "width")
    dealt = dealt.select("width", "query_ids", "queries", F.explode("parts").alias("part"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, x = b"", np.empty(0, np.int64), np.empty((0, 0), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                width, raw_ids, raw, asked_ids, asked_raw = (batch.column(n)[row].as_py() for n in range(5))
                if raw_ids != last:
                    last, ids = raw_ids, np.frombuffer(raw_ids, np.int64)
                    x = np.ascontiguousarray(_vectors(raw, len(ids), width).T)
                asked_by = np.frombuffer(asked_ids, np.int64)
                found = _search(ids, x, asked_by, _vectors(asked_raw, len(asked_by), width), k)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["query_id", "vec_id", "score"])

    pairs = shards.join(dealt, ["width", "part"]).select("width", "ids", "vectors", "query_ids", "queries")
    found = in_workers(pairs, "top k", search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter(F.col("vec_id") % 20 == 0))


ORACLE = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

QUERIES = {"op9_topk": op9_topk}
ORACLES = {"op9_topk": ORACLE}
