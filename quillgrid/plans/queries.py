"""Registered queries over the TPC-H-like tables, with SQL for DuckDB.

Matrices: A and B are parts by suppliers with signed values, M is orders by parts; the graph's edges are events from
users to items; features are quantised embeddings, so that sums are exact in any order."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.functions.scalars import grouped_digits
from quillgrid.matrix import SparseMatrix
from quillgrid.operators import algebra, features, graph, layout, verify
from quillgrid.plans import reports, runs, strategy
from quillgrid.registry import query
from quillgrid.sources import coo, generators
from quillgrid.sources.workspace import workspace
from quillgrid.streaming import edges as streaming


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shape(spark: SparkSession, sf_dir: str, rows: str, cols: str) -> tuple[int, int]:
    return _read(spark, sf_dir, rows).count(), _read(spark, sf_dir, cols).count()


def _items(spark: SparkSession, sf_dir: str, flag: str, shaped: bool = False) -> SparseMatrix:
    rows = _read(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag)
    rows = rows.select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), (F.col("l_quantity").cast("long") - 25).alias("v"))
    return SparseMatrix(rows, _shape(spark, sf_dir, "part", "supplier") if shaped else None)


def a_ps(spark: SparkSession, sf_dir: str, shaped: bool = False) -> SparseMatrix:
    return _items(spark, sf_dir, "R", shaped)


def b_ps(spark: SparkSession, sf_dir: str, shaped: bool = False) -> SparseMatrix:
    return _items(spark, sf_dir, "N", shaped)


def m_op(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").cast("long").alias("v"))
    return SparseMatrix(rows)


def g_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst"))


#: Components of the embeddings.
DIMS = 64


def x_feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: (x.cast("double") * 1000).cast("long"))
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), whole.alias("x"))


def long_h(aggregated: DataFrame) -> DataFrame:
    return features.unpacked(aggregated, "src", "h")


def layer(spark: SparkSession, dims: int = 64, out: int = 8) -> DataFrame:
    """(d, e, w): whole weights by a rule."""
    w = (F.col("id") * 7 + F.floor(F.col("id") / out) * 3) % 11 - 5
    return spark.range(dims * out).select(F.floor(F.col("id") / out).alias("d"), (F.col("id") % out).alias("e"), w.cast("long").alias("w"))


A = "a AS (SELECT l_partkey AS i, l_suppkey AS j, CAST(SUM(CAST(trunc(l_quantity) AS BIGINT) - 25) AS BIGINT) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)"
B = "b AS (SELECT l_partkey AS i, l_suppkey AS j, CAST(SUM(CAST(trunc(l_quantity) AS BIGINT) - 25) AS BIGINT) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2)"
M = "m AS (SELECT l_orderkey AS i, l_partkey AS j, CAST(SUM(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2)"
G = "g AS (SELECT event_id, event_type, ts, user_id AS src, CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst FROM events)"
X = "x AS (SELECT vec_id AS node, CAST(unnest(range(0, len(embedding))) AS BIGINT) AS d, CAST(trunc(CAST(unnest(embedding) AS DOUBLE) * 1000) AS BIGINT) AS x FROM embeddings)"
W = "w AS (SELECT r // 8 AS d, r % 8 AS e, CAST((r * 7 + (r // 8) * 3) % 11 - 5 AS BIGINT) AS w FROM range(512) t(r))"
P = "p AS (SELECT m.i, a.j, CAST(SUM(m.v * a.v) AS BIGINT) AS v FROM m JOIN a ON m.j = a.i GROUP BY 1, 2)"
H = "h AS (SELECT src, d, CAST(SUM(x) AS BIGINT) AS h FROM g JOIN x ON g.dst = x.node GROUP BY 1, 2)"
E = "e AS (SELECT src AS i, dst AS j, count(*) AS v FROM g GROUP BY 1, 2)"
SUM = "s AS (SELECT i, j, CAST(SUM(v) AS BIGINT) AS v FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)"
N = "n AS (SELECT p.range AS i, s.range AS j, coalesce(CAST(trunc(s_acctbal) AS BIGINT), 0) AS v FROM range(0, (SELECT count(*) FROM nation)) p CROSS JOIN range(0, (SELECT count(*) FROM supplier)) s LEFT JOIN supplier t ON t.s_nationkey = p.range AND t.s_suppkey = s.range)"
PARTS, SUPPLIERS = "(SELECT count(*) FROM part)", "(SELECT count(*) FROM supplier)"


def _with(*parts: str) -> str:
    """A WITH clause of named parts; the last part is the query, with further named parts before it if it begins with one."""
    return "WITH " + ", ".join(parts[:-1]) + (", " if re.match(r"\w+ AS \(", parts[-1]) else " ") + parts[-1]


# -- products, sums -------------------------------------------------------------------


@query("mat_mul", _with(M, A, P, "SELECT i, j, v FROM p WHERE v <> 0"))
def mat_mul(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.multiply(m_op(spark, sf_dir), a_ps(spark, sf_dir)).df


@query("mat_mul_threshold", _with(M, A, P, "SELECT i, j, v FROM p WHERE abs(v) > 100"))
def mat_mul_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.multiply(m_op(spark, sf_dir), a_ps(spark, sf_dir), threshold=100).df


@query("mat_mul_blocked", _with(M, A, P, "SELECT i, j, v FROM p WHERE v <> 0"))
def mat_mul_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.multiply(m_op(spark, sf_dir), a_ps(spark, sf_dir), blocks=(512, 8)).df


@query("mat_mul_double", _with(M, A, P, "SELECT i, j, CAST(v AS DOUBLE) AS v FROM p WHERE v <> 0"))
def mat_mul_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.multiply(m_op(spark, sf_dir), a_ps(spark, sf_dir), double=True).df


@query("mat_mul_transpose", _with(A, "SELECT x.j AS i, y.j AS j, CAST(SUM(x.v * y.v) AS BIGINT) AS v FROM a x JOIN a y ON x.i = y.i GROUP BY 1, 2 HAVING SUM(x.v * y.v) <> 0"))
def mat_mul_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.gram(a_ps(spark, sf_dir)).df


@query("mat_self_product", _with(G, E, "SELECT x.i, y.j, CAST(SUM(x.v * y.v) AS BIGINT) AS v FROM e x JOIN e y ON x.j = y.i GROUP BY 1, 2"))
def mat_self_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.self_product(graph.edge_weights(g_edges(spark, sf_dir))).df


@query("mat_add", _with(A, B, SUM, "SELECT i, j, v FROM s"))
def mat_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.add(a_ps(spark, sf_dir), b_ps(spark, sf_dir)).df


@query("mat_add_by_rows", _with(A, B, SUM, "SELECT i, j, v FROM s"))
def mat_add_by_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.add(a_ps(spark, sf_dir), b_ps(spark, sf_dir), by_rows=8).df


@query("mat_add_drop_zeros", _with(A, B, SUM, "SELECT i, j, v FROM s WHERE v <> 0"))
def mat_add_drop_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.add(a_ps(spark, sf_dir), b_ps(spark, sf_dir), drop_zeros=True).df


@query("mat_add_zeros", _with(A, B, SUM, "SELECT i, j, v FROM s WHERE v = 0"))
def mat_add_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.add(a_ps(spark, sf_dir), b_ps(spark, sf_dir)).df.filter("v = 0")


@query("mat_sub", _with(A, B, "SELECT i, j, CAST(SUM(v) AS BIGINT) AS v FROM (SELECT * FROM a UNION ALL SELECT i, j, -v FROM b) GROUP BY 1, 2"))
def mat_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.subtract(a_ps(spark, sf_dir), b_ps(spark, sf_dir)).df


@query("mat_transpose", _with(A, "SELECT j AS i, i AS j, v FROM a"))
def mat_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.transpose(a_ps(spark, sf_dir).merged()).df


# -- canonical form, statistics ---------------------------------------------------------


@query("coo_canonical", _with(M, "SELECT i, j, v FROM m"))
def coo_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m_op(spark, sf_dir).merged().df


@query("coo_stats", _with(A, f"SELECT count(*) AS nnz, count(DISTINCT i) AS rows, count(DISTINCT j) AS cols, min(v) AS v_min, max(v) AS v_max, count(*) / (CAST({PARTS} AS DOUBLE) * {SUPPLIERS}) * 100 AS density_pct, 100 - count(*) / (CAST({PARTS} AS DOUBLE) * {SUPPLIERS}) * 100 AS sparsity_pct FROM a"))
def coo_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a_ps(spark, sf_dir, shaped=True).stats()


@query("coo_stored_entries", "SELECT count(*) AS stored FROM lineitem")
def coo_stored_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m_op(spark, sf_dir).df.agg(F.count("*").alias("stored"))


@query("coo_shape_infer", _with(M, "SELECT max(i) + 1 AS rows, max(j) + 1 AS cols FROM m"))
def coo_shape_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m_op(spark, sf_dir).df.agg((F.max("i") + 1).alias("rows"), (F.max("j") + 1).alias("cols"))


# -- layouts ------------------------------------------------------------------------------


@query("csr_row_ptr", _with(A, f"r AS (SELECT range AS i FROM range(0, {PARTS} + 1)), n AS (SELECT i, count(*) AS n FROM a GROUP BY i) SELECT r.i, CAST(coalesce(SUM(coalesce(n, 0)) OVER (ORDER BY r.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr FROM r LEFT JOIN n ON r.i = n.i"))
def csr_row_ptr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.row_pointers(a_ps(spark, sf_dir, shaped=True))


@query("csc_col_ptr", _with(A, f"r AS (SELECT range AS j FROM range(0, {SUPPLIERS} + 1)), n AS (SELECT j, count(*) AS n FROM a GROUP BY j) SELECT r.j, CAST(coalesce(SUM(coalesce(n, 0)) OVER (ORDER BY r.j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr FROM r LEFT JOIN n ON r.j = n.j"))
def csc_col_ptr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.col_pointers(a_ps(spark, sf_dir, shaped=True))


@query("csr_rows", _with(A, "SELECT i, string_agg(CAST(j AS VARCHAR), ',' ORDER BY j) AS col_idx, string_agg(CAST(v AS VARCHAR), ',' ORDER BY j) AS \"values\" FROM a GROUP BY i"))
def csr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.csr_rows(a_ps(spark, sf_dir)).select("i", layout.joined_text(F.col("col_idx")).alias("col_idx"), layout.joined_text(F.col("values")).alias("values"))


@query("csc_cols", _with(A, "SELECT j, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS row_idx, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS \"values\" FROM a GROUP BY j"))
def csc_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.csc_cols(a_ps(spark, sf_dir)).select("j", layout.joined_text(F.col("row_idx")).alias("row_idx"), layout.joined_text(F.col("values")).alias("values"))


@query("csr_chunks", _with(A, "SELECT i, j // 16 AS chunk, string_agg(CAST(j AS VARCHAR), ',' ORDER BY j) AS col_idx, string_agg(CAST(v AS VARCHAR), ',' ORDER BY j) AS \"values\" FROM a GROUP BY 1, 2"))
def csr_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.csr_chunks(a_ps(spark, sf_dir), 16).select("i", "chunk", layout.joined_text(F.col("col_idx")).alias("col_idx"), layout.joined_text(F.col("values")).alias("values"))


@query("csr_get_row", _with(A, "SELECT j, v FROM a WHERE i = 7"))
def csr_get_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.get_row(a_ps(spark, sf_dir, shaped=True), 7)


@query("csc_get_col", _with(A, "SELECT i, v FROM a WHERE j = 3"))
def csc_get_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.get_col(a_ps(spark, sf_dir, shaped=True), 3)


@query("csr_row_block", _with(A, "SELECT i - 20 AS i, j, v FROM a WHERE i >= 20 AND i < 120"))
def csr_row_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.row_block(a_ps(spark, sf_dir, shaped=True), 20, 120).df


@query("csc_col_block", _with(A, "SELECT i, j - 2 AS j, v FROM a WHERE j >= 2 AND j < 8"))
def csc_col_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.col_block(a_ps(spark, sf_dir, shaped=True), 2, 8).df


@query("csr_roundtrip", _with(A, "SELECT i, j, v FROM a"))
def csr_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.from_csr(layout.csr_rows(a_ps(spark, sf_dir))).df


@query("csc_roundtrip", _with(A, "SELECT i, j, v FROM a"))
def csc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.from_csc(layout.csc_cols(a_ps(spark, sf_dir))).df.select("i", "j", "v")


@query("csr_add", _with(A, B, SUM, "SELECT i, j, v FROM s"))
def csr_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.from_csr(layout.csr_add(layout.csr_rows(a_ps(spark, sf_dir)), layout.csr_rows(b_ps(spark, sf_dir)))).df


@query("entry_position", _with(A, "SELECT i, j, v, CAST(row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS INTEGER) AS k FROM a"))
def entry_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.entry_positions(a_ps(spark, sf_dir))


@query("sort_row_major", _with(A, "SELECT i, j, v, CAST(row_number() OVER (ORDER BY i, j) AS INTEGER) AS place FROM a QUALIFY place <= 500"))
def sort_row_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.first_entries(a_ps(spark, sf_dir), 500)


@query("sort_col_major", _with(A, "SELECT i, j, v, CAST(row_number() OVER (ORDER BY j, i) AS INTEGER) AS place FROM a QUALIFY place <= 500"))
def sort_col_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.first_entries(a_ps(spark, sf_dir), 500, by_columns=True)


@query("sort_all", _with(A, "SELECT i, j, v FROM a ORDER BY i, j"))
def sort_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.sorted_entries(a_ps(spark, sf_dir).merged())


# -- graphs ---------------------------------------------------------------------------------


@query("graph_edge_weights", _with(G, E, "SELECT i, j, v FROM e"))
def graph_edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_weights(g_edges(spark, sf_dir)).df


@query("graph_degrees", _with(G, "SELECT node, CAST(SUM(o) AS BIGINT) AS out_degree, CAST(SUM(k) AS BIGINT) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS k FROM g UNION ALL SELECT dst, 0, 1 FROM g) GROUP BY node"))
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(g_edges(spark, sf_dir))


@query("graph_node_count", _with(G, "SELECT max(greatest(src, dst)) + 1 AS nodes FROM g"))
def graph_node_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g_edges(spark, sf_dir).agg((F.max(F.greatest("src", "dst")) + 1).alias("nodes"))


@query("graph_no_loops", _with(G, "SELECT event_id, src, dst FROM g WHERE src <> dst"))
def graph_no_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g_edges(spark, sf_dir).filter("src <> dst").select("event_id", "src", "dst")


@query("gcn_aggregate", _with(G, X, H, "SELECT src, d, h FROM h"))
def gcn_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_h(graph.aggregate(g_edges(spark, sf_dir), x_feat(spark, sf_dir), DIMS))


@query("gcn_aggregate_all_nodes", _with(G, X, H, "n AS (SELECT s.range AS src, d.range AS d FROM range(0, (SELECT max(greatest(src, dst)) + 1 FROM g)) s, range(0, 64) d) SELECT n.src, n.d, coalesce(h, 0) AS h FROM n LEFT JOIN h ON n.src = h.src AND n.d = h.d"))
def gcn_aggregate_all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = g_edges(spark, sf_dir)
    return long_h(graph.aggregate_all(edges, x_feat(spark, sf_dir), graph.node_count(edges), DIMS))


@query("gcn_forward", _with(G, X, H, W, "SELECT src, e, CAST(SUM(h * w) AS BIGINT) AS y FROM h JOIN w ON h.d = w.d GROUP BY 1, 2"))
def gcn_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.unpacked(graph.forward(g_edges(spark, sf_dir), x_feat(spark, sf_dir), layer(spark), DIMS), "src", "y", "e")


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges that are there, and those that an update brings: purchases come later."""
    edges = _read(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst"))
    return edges.filter("event_type <> 'purchase'"), edges.filter("event_type = 'purchase'")


@query("gcn_update_full", _with(G, X, H, "SELECT src, d, h FROM h"))
def gcn_update_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _split(spark, sf_dir)
    return long_h(graph.update_full(old, new, x_feat(spark, sf_dir), DIMS))


#: States that earlier calls have left, by application and folder: an update begins from what is carried.
_STATES: dict[tuple[str, str], graph.AggregateState] = {}


def _state(spark: SparkSession, sf_dir: str) -> graph.AggregateState:
    """The stored aggregate before the update; worked out the first time that a session asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STATES:
        old = _split(spark, sf_dir)[0]
        _STATES[key] = graph.AggregateState(spark, workspace(spark, "state"), buckets=8).start(graph.aggregate(old, x_feat(spark, sf_dir), DIMS))
    return _STATES[key]


@query("gcn_update_incremental", _with(G, X, H, "SELECT src, d, h FROM h"))
def gcn_update_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The carried aggregate and what new edges add to it; the old edges are not read."""
    delta = graph.update_delta(_split(spark, sf_dir)[1], x_feat(spark, sf_dir), DIMS)
    return long_h(graph.update_incremental(_state(spark, sf_dir).load(), delta))


@query("gcn_update_stored", _with(G, X, H, "SELECT src, d, h FROM h"))
def gcn_update_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state itself after two updates, each of which writes only the buckets that it touches."""
    old, new = _split(spark, sf_dir)
    state = graph.AggregateState(spark, workspace(spark, "state"), buckets=8).start(graph.aggregate(old, x_feat(spark, sf_dir), DIMS))
    for odd in (0, 1):
        state.update(new.filter(F.col("dst") % 2 == odd), x_feat(spark, sf_dir), DIMS)
    return long_h(state.load())


@query("gcn_update_delta", _with(G, X, "SELECT src, d, CAST(SUM(x) AS BIGINT) AS h FROM g JOIN x ON g.dst = x.node WHERE event_type = 'purchase' GROUP BY 1, 2"))
def gcn_update_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_h(graph.update_delta(_split(spark, sf_dir)[1], x_feat(spark, sf_dir), DIMS))


@query("gcn_update_removal", _with(G, X, "SELECT src, d, CAST(SUM(x) AS BIGINT) AS h FROM (SELECT src, d, x FROM g JOIN x ON g.dst = x.node UNION ALL SELECT src, d, -x FROM g JOIN x ON g.dst = x.node WHERE event_type = 'purchase') GROUP BY 1, 2"))
def gcn_update_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _split(spark, sf_dir)[1].groupBy("src", "dst").agg((-F.count("*")).alias("w"))
    x = x_feat(spark, sf_dir)
    return long_h(graph.update_incremental(graph.aggregate(g_edges(spark, sf_dir), x, DIMS), graph.weighted_aggregate(gone, x, DIMS)))


@query("new_edges_antijoin", _with(G, "SELECT DISTINCT src, dst FROM g n WHERE event_type = 'purchase' AND src <> dst AND NOT EXISTS (SELECT 1 FROM g o WHERE o.event_type <> 'purchase' AND o.src = n.src AND o.dst = n.dst)"))
def new_edges_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _split(spark, sf_dir)
    return graph.new_edges(new, old)


# -- dense, strategy -----------------------------------------------------------------------------


@query("spmm", _with(G, X, E, "SELECT i, d, CAST(SUM(v * x) AS BIGINT) AS y FROM e JOIN x ON e.j = x.node GROUP BY 1, 2"))
def spmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.unpacked(algebra.spmm(graph.edge_weights(g_edges(spark, sf_dir)), x_feat(spark, sf_dir), DIMS), "i", "y")


@query("spmv", _with(A, "SELECT i, CAST(SUM(v * (j % 5 + 1)) AS BIGINT) AS y FROM a GROUP BY i"))
def spmv(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "supplier").count()
    return algebra.spmv(a_ps(spark, sf_dir), spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 5 + 1).alias("x")))


@query("densify", _with(A, f"SELECT p.range AS i, s.range AS j, coalesce(v, 0) AS v FROM range(0, {PARTS}) p CROSS JOIN range(0, {SUPPLIERS}) s LEFT JOIN a ON a.i = p.range AND a.j = s.range"))
def densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.densify(a_ps(spark, sf_dir, shaped=True))


@query("dense_mul", _with(N, "SELECT x.i, y.i AS j, CAST(SUM(x.v * y.v) AS BIGINT) AS v FROM n x JOIN n y ON x.j = y.j GROUP BY 1, 2"))
def dense_mul(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by suppliers with whole balances, times its transpose."""
    rows = _read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("i"), F.col("s_suppkey").alias("j"), F.col("s_acctbal").cast("long").alias("v"))
    balances = SparseMatrix(rows, _shape(spark, sf_dir, "nation", "supplier"))
    return algebra.dense_multiply(balances, algebra.transpose(balances))


@query("memory_footprint", _with(A, B, f"n AS (SELECT (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS n, 2.0::DOUBLE * {PARTS} * {SUPPLIERS} AS c) SELECT n * 16 / 1048576::DOUBLE AS sparse_mb, c * 8 / 1048576 AS dense_mb, (c * 8 / 1048576) / (n * 16 / 1048576::DOUBLE) AS ratio FROM n"))
def memory_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategy.memory_footprint(a_ps(spark, sf_dir, shaped=True), b_ps(spark, sf_dir, shaped=True))


@query("product_counts", _with(M, A, "SELECT m.k, CAST(m.n * a.n AS BIGINT) AS products FROM (SELECT j AS k, count(*) AS n FROM m GROUP BY j) m JOIN (SELECT i AS k, count(*) AS n FROM a GROUP BY i) a ON m.k = a.k"))
def product_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.product_counts(m_op(spark, sf_dir), a_ps(spark, sf_dir))


@query("mul_strategy_choice", _with(A, f"t AS (SELECT SUM(n * n) AS p, MAX(n * n) AS h FROM (SELECT j, count(*) AS n FROM a GROUP BY j)), q AS (SELECT count(*) / (CAST({PARTS} AS DOUBLE) * {SUPPLIERS}) * 100 AS y FROM a) SELECT CAST(p AS BIGINT) AS sparse_products, CAST(h AS BIGINT) AS hottest, {PARTS} * {SUPPLIERS} * {PARTS} AS dense_products, y AS density_a, y AS density_b, CASE WHEN y >= 10 THEN 'dense' ELSE 'sparse' END AS choice FROM t, q"))
def mul_strategy_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = a_ps(spark, sf_dir, shaped=True)
    return strategy.multiplication_choice(a, algebra.transpose(a))


# -- text, verification, reports ------------------------------------------------------------------


@query("csv_lines_parse", _with(A, "SELECT i, j, v FROM a"))
def csv_lines_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries written as lines from 1, some of them malformed, and parsed again."""
    a = a_ps(spark, sf_dir).merged().df
    lines = a.select(F.concat_ws(",", F.col("i") + 1, F.col("j") + 1, F.concat("v", F.lit(".0"))).alias("value"))
    bad = a.select(F.explode(F.array(F.concat_ws(",", "i", "j"), F.concat(F.lit("x,1,"), F.col("v")), F.lit(""))).alias("value"))
    return coo.parse_lines(lines.unionByName(bad)).filter("ok").select("i", "j", "v")


@query("csv_rejects", _with(A, "SELECT count(*) * 3 AS rejected FROM a"))
def csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = a_ps(spark, sf_dir).merged().df
    bad = a.select(F.explode(F.array(F.concat_ws(",", "i", "j"), F.concat(F.lit("x,1,"), F.col("v")), F.lit("2.0,1,1"))).alias("value"))
    return coo.parse_lines(bad).filter("NOT ok").agg(F.count("*").alias("rejected"))


# -- files -----------------------------------------------------------------------------------------


@query("csv_roundtrip", _with(A, "SELECT i, j, v FROM a"))
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as lines counted from 1, and read again."""
    path = workspace(spark, "coo")
    coo.write_coo(a_ps(spark, sf_dir).merged(), path)
    return coo.read_coo(spark, path).df


@query("csr_file_roundtrip", _with(A, "SELECT i, j, v FROM a"))
def csr_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "csr")
    coo.save_csr(a_ps(spark, sf_dir), path)
    return coo.load_csr(spark, path).df


@query("csc_file_roundtrip", _with(A, "SELECT i, j, v FROM a"))
def csc_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "csc")
    coo.save_csc(a_ps(spark, sf_dir), path)
    return coo.load_csc(spark, path).df.select("i", "j", "v")


@query("sort_file", _with(A, "SELECT i, j, v, CAST(row_number() OVER (ORDER BY j, i) - 1 AS BIGINT) AS line FROM a"))
def sort_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file sorted by columns; line: where an entry stands in it."""
    path = workspace(spark, "sort")
    coo.write_coo(a_ps(spark, sf_dir).merged(), f"{path}/in", base=0)
    coo.sort_file(spark, f"{path}/in", f"{path}/out", by_columns=True)
    lines = spark.read.text(f"{path}/out").select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    before = Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of a file
    parts = lines.groupBy("file", "at").agg(F.count("*").alias("rows")).withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("file", "at").orderBy("n")) - 1
    numbered = lines.withColumn("k", within).join(parts, ["file", "at"])
    return coo.parse_lines(numbered, base=0, keep=("k", "first")).select("i", "j", "v", (F.col("k") + F.col("first")).alias("line"))


@query("count_lines", "SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')")
def count_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "lines")
    coo.write_coo(a_ps(spark, sf_dir).merged(), path)
    return coo.read_lines(spark, path).agg(F.count("*").alias("n"))


def _files(spark: SparkSession, *matrices: SparseMatrix) -> list[str]:
    path = workspace(spark, "run")
    for n, matrix in enumerate(matrices):
        coo.write_coo(matrix.merged(), f"{path}/{n}")
    return [f"{path}/{n}" for n in range(len(matrices) + 1)]


@query("run_add", _with(A, B, SUM, "SELECT 'add' AS operation, (SELECT count(*) FROM a) AS nnz_a, (SELECT count(*) FROM b) AS nnz_b, (SELECT count(*) FROM s) AS nnz_c, (SELECT max(i) + 1 FROM s) AS rows_c, (SELECT max(j) + 1 FROM s) AS cols_c, (SELECT count(*) FROM a) + (SELECT count(*) FROM b) - (SELECT count(*) FROM s) AS flops"))
def run_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of a sum from file to file, without its times."""
    record = runs.run(spark, "add", *_files(spark, a_ps(spark, sf_dir), b_ps(spark, sf_dir)))
    return record.select("operation", "nnz_a", "nnz_b", "nnz_c", "rows_c", "cols_c", "flops")


@query("run_multiply", _with(M, A, P, "t AS (SELECT CAST(2 * SUM(x.n * y.n) AS BIGINT) AS flops FROM (SELECT j AS k, count(*) AS n FROM m GROUP BY 1) x JOIN (SELECT i AS k, count(*) AS n FROM a GROUP BY 1) y ON x.k = y.k) SELECT 'multiply' AS operation, (SELECT count(*) FROM m) AS nnz_a, (SELECT count(*) FROM a) AS nnz_b, (SELECT count(*) FROM p WHERE v <> 0) AS nnz_c, (SELECT max(i) + 1 FROM m) AS rows_c, (SELECT max(j) + 1 FROM a) AS cols_c, flops FROM t"))
def run_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = runs.run(spark, "multiply", *_files(spark, m_op(spark, sf_dir), a_ps(spark, sf_dir)))
    return record.select("operation", "nnz_a", "nnz_b", "nnz_c", "rows_c", "cols_c", "flops")


@query("edge_file_dense", "SELECT p.range AS i, s.range AS j, coalesce(CAST(abs(trunc(s_acctbal)) AS BIGINT), 0) AS v FROM range(0, 25) p CROSS JOIN range(0, 25) s LEFT JOIN supplier t ON t.s_nationkey = p.range AND t.s_suppkey = s.range")
def edge_file_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines src,dst,weight counted from 1, read as a dense matrix."""
    rows = _read(spark, sf_dir, "supplier").select((F.col("s_nationkey") + 1).alias("s"), (F.col("s_suppkey") + 1).alias("d"), F.abs(F.col("s_acctbal").cast("long")).alias("w"))
    path = workspace(spark, "edges")
    rows.write.csv(path)
    return coo.read_dense(spark, path, 25)


@query("report_numbers", "SELECT l_returnflag AS flag, format('{:,}', count(*)) AS entries FROM lineitem GROUP BY 1")
def report_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(grouped_digits(F.count("*")).alias("entries"))


@query("verify_max_abs_diff", _with(A, B, "SELECT max(abs(coalesce(a.v, 0) - coalesce(b.v, 0))) AS max_abs_diff FROM a FULL JOIN b ON a.i = b.i AND a.j = b.j"))
def verify_max_abs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.max_abs_diff(a_ps(spark, sf_dir), b_ps(spark, sf_dir))


@query("verify_set_diff", _with(A, B, "SELECT 'a' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'b', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"))
def verify_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.set_difference(a_ps(spark, sf_dir), b_ps(spark, sf_dir))


@query("verify_lookup", _with(A, B, "SELECT a.i, a.j, a.v AS expected, coalesce(b.v, 0) AS actual, a.v = coalesce(b.v, 0) AS ok FROM a LEFT JOIN b ON a.i = b.i AND a.j = b.j"))
def verify_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.lookup(a_ps(spark, sf_dir), b_ps(spark, sf_dir))


@query("verify_nnz_match", _with(A, B, "SELECT (SELECT count(*) FROM a) AS nnz_a, (SELECT count(*) FROM b) AS nnz_b, (SELECT count(*) FROM a) = (SELECT count(*) FROM b) AS same"))
def verify_nnz_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.nnz_match(a_ps(spark, sf_dir), b_ps(spark, sf_dir))


def _times(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag)
    return rows.groupBy("l_suppkey").agg(F.max("l_quantity").alias("seconds"))


BENCH = "t AS (SELECT x.l_suppkey, max(x.l_quantity) AS first_s FROM lineitem x WHERE l_returnflag = 'R' GROUP BY 1), u AS (SELECT l_suppkey, max(l_quantity) AS second_s FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)"


@query("bench_winner_join", f"WITH {BENCH} SELECT l_suppkey, first_s, second_s, second_s / first_s AS speedup, CASE WHEN second_s / first_s > 1 THEN 'first' ELSE 'second' END AS winner FROM t JOIN u USING (l_suppkey)")
def bench_winner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.compared(_times(spark, sf_dir, "R"), _times(spark, sf_dir, "N"), "l_suppkey")


@query("bench_wins", f"WITH {BENCH} SELECT CASE WHEN second_s / first_s > 1 THEN 'first' ELSE 'second' END AS winner, count(*) AS wins FROM t JOIN u USING (l_suppkey) GROUP BY 1")
def bench_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.wins(bench_winner_join(spark, sf_dir))


@query("bench_summary", "SELECT l_returnflag AS name, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS std, CAST(max(l_linenumber) AS DOUBLE) / avg(l_quantity) AS rows_per_second FROM lineitem GROUP BY 1")
def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as if they were the times of runs."""
    return reports.summary(_read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("name"), F.col("l_quantity").alias("seconds"), F.col("l_linenumber").alias("rows")))


@query("bench_phase_shares", "SELECT l_returnflag AS phase, sum(l_quantity) AS seconds, sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem) * 100 AS pct FROM lineitem GROUP BY 1")
def bench_phase_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.phase_shares(_read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("phase")).agg(F.sum("l_quantity").alias("seconds")))


@query("report_roundtrip", f"WITH {BENCH} SELECT CAST(l_suppkey AS BIGINT) AS l_suppkey, first_s, second_s FROM t JOIN u USING (l_suppkey)")
def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON and read again."""
    path = workspace(spark, "report")
    coo.write_report(bench_winner_join(spark, sf_dir), path)
    return coo.read_report(spark, path, lines=True).select("l_suppkey", "first_s", "second_s")


@query("verify_equal", "SELECT true AS itself, false AS other")
def verify_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = a_ps(spark, sf_dir), b_ps(spark, sf_dir)
    return spark.createDataFrame([(verify.equal(a, algebra.transpose(algebra.transpose(a))), verify.equal(a, b))], "itself boolean, other boolean")


@query("update_harness", "SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS edges_added, true AS agree, true AS timed")
def update_harness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full against incremental updates by one to three new edges: whether both give the same aggregate."""
    records = runs.full_or_incremental(spark, g_edges(spark, sf_dir).select("src", "dst"), x_feat(spark, sf_dir), DIMS, workspace(spark, "updates"))
    return records.select("edges_added", "agree", ((F.col("full_recomputation_s") > 0) & (F.col("speedup") > 0) & F.col("winner").isin("full", "incremental")).alias("timed"))


@query("graph_degree_shares", _with(G, "d AS (SELECT src AS i, count(*) AS d FROM g GROUP BY 1) SELECT i, CAST(d AS DOUBLE) / (SELECT sum(d) FROM d) AS share FROM d"))
def graph_degree_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.normalised(g_edges(spark, sf_dir).groupBy(F.col("src").alias("i")).agg(F.count("*").alias("d")))


@query("graph_sampled_edges", "SELECT CAST(20 AS BIGINT) AS n, CAST(0 AS BIGINT) AS loops, CAST(0 AS BIGINT) AS known")
def graph_sampled_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty new edges: none is a loop, none is there already."""
    edges = g_edges(spark, sf_dir)
    new = graph.sample_new_edges(edges, 2000, 20)
    known = new.join(edges, ["src", "dst"], "left_semi").agg(F.count("*").alias("known"))
    return new.agg(F.count("*").alias("n"), F.count_if(F.col("src") == F.col("dst")).alias("loops")).crossJoin(known)  # a row each


# -- generators -------------------------------------------------------------------------------------


@query("gen_banded_pattern", "SELECT i.range AS i, j.range AS j FROM range(0, 1000) i JOIN range(0, 1000) j ON abs(i.range - j.range) <= 5")
def gen_banded_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.banded(spark, 1000, 5).df.select("i", "j")


@query("gen_uniform", "SELECT 100000 AS entries, true AS inside")
def gen_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generators.uniform_matrix(spark, 5000, 4000, 100_000).df
    inside = F.col("i").between(0, 4999) & F.col("j").between(0, 3999) & F.col("v").between(-100, 99)
    return rows.agg(F.count("*").cast("int").alias("entries"), F.min(inside).alias("inside"))


@query("gen_unique", "SELECT CAST(50000 AS BIGINT) AS entries, CAST(50000 AS BIGINT) AS places, true AS even, true AS seeded")
def gen_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct places, even over a grid of 100 fields (chi square), others for another seed (2,500 in common are expected)."""
    one, two = (generators.uniform_matrix(spark, 1000, 1000, 50_000, seed, unique=True).df for seed in (1, 2))
    fields = one.groupBy(F.floor(F.col("i") / 100).alias("a"), F.floor(F.col("j") / 100).alias("b")).count()
    even = fields.agg((F.sum(F.pow(F.col("count") - 500, F.lit(2)) / 500) < 160).alias("even"))
    common = one.join(two, ["i", "j"], "left_semi").agg(F.count("*").between(2200, 2800).alias("seeded"))
    return one.agg(F.count("*").alias("entries"), F.countDistinct("i", "j").alias("places")).crossJoin(even).crossJoin(common)  # a row each


@query("gen_block", "SELECT CAST(10000 AS BIGINT) AS entries, true AS inside")
def gen_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generators.block_diagonal(spark, 10, 100, 0.1).df
    return rows.agg(F.count("*").alias("entries"), F.min(F.floor(F.col("i") / 100) == F.floor(F.col("j") / 100)).alias("inside"))


@query("gen_power_law", "SELECT true AS distinct_columns, true AS all_rows, true AS even, true AS heavy")
def gen_power_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct columns in every row, even over the columns, and a few rows that hold many entries."""
    rows = generators.power_law(spark, 2000, 1500, 20_000).df
    fields = rows.groupBy(F.floor(F.col("j") / 15).alias("f")).count()
    even = fields.agg((F.max("count") < 1.5 * F.avg("count")).alias("even"))
    heavy = rows.groupBy("i").count().agg((F.max("count") > 8 * F.avg("count")).alias("heavy"))
    return rows.agg((F.count("*") == F.countDistinct("i", "j")).alias("distinct_columns"), (F.countDistinct("i") == 2000).alias("all_rows")).crossJoin(even).crossJoin(heavy)  # a row each


@query("gen_graph_fast", "SELECT CAST(0 AS BIGINT) AS loops, true AS enough")
def gen_graph_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generators.sparse_graph(spark, 2000, 0.99)
    return rows.agg(F.count_if(F.col("src") == F.col("dst")).alias("loops"), (F.count("*") > 40_000).alias("enough"))


@query("gen_graph_weighted", "SELECT CAST(20000 AS BIGINT) AS edges, true AS inside")
def gen_graph_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generators.weighted_graph(spark, 2000, 10)
    return rows.agg(F.count("*").alias("edges"), F.min(F.col("weight").between(1, 10) & F.col("src").between(0, 1999)).alias("inside"))


@query("gen_sparse", "SELECT CAST(10000 AS BIGINT) AS entries, true AS inside, true AS even")
def gen_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generators.sparse_matrix(spark, 1000, 0.99).df
    mean = F.avg("v").between(5.35, 5.65) & F.avg("i").between(480, 520) & F.avg("j").between(480, 520)
    return rows.agg(F.count("*").alias("entries"), F.min(F.col("v").between(1, 10) & F.col("i").between(0, 999) & F.col("j").between(0, 999)).alias("inside"), mean.alias("even"))


@query("gen_features", "SELECT CAST(500 AS BIGINT) AS nodes, true AS normal")
def gen_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generators.features(spark, 500, 128)
    moments = rows.select("node", F.explode("x").alias("x")).agg(F.countDistinct("node").alias("nodes"), F.avg("x").alias("m"), F.stddev("x").alias("s"))
    return moments.select("nodes", (F.abs("m").between(0, 0.02) & F.col("s").between(0.98, 1.02)).alias("normal"))


@query("gen_presets", "SELECT * FROM (VALUES ('small_a', 500), ('small_b', 500), ('medium_a', 10000), ('large_b', 100000), ('banded', 10970), ('block', 10000)) t(name, entries)")
def gen_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = generators.presets(spark)
    counts = [found[n].df.agg(F.count("*").cast("int").alias("entries")).select(F.lit(n).alias("name"), "entries") for n in ("small_a", "small_b", "medium_a", "large_b", "banded", "block")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("gen_memory", "SELECT 100000 * 16 / 1048576::DOUBLE AS memory_mb, 100000 * 25 / 1048576::DOUBLE AS csv_mb")
def gen_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = generators.estimate_memory(100_000)
    return spark.createDataFrame([(found["memory_mb"], found["csv_mb"])], "memory_mb double, csv_mb double")


# -- streams ------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _read(spark, sf_dir, "events").schema
    rows = streaming.edge_stream(spark, f"{sf_dir}/events*.parquet", schema)
    return rows.select("event_id", "ts", F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst"))


@query("stream_gcn_aggregate", _with(G, X, H, "SELECT src, d, h FROM h"))
def stream_gcn_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streaming.maintained_aggregate(_stream(spark, sf_dir), x_feat(spark, sf_dir), DIMS)
    return long_h(streaming.drain(rows, workspace(spark, "stream")))


@query("stream_edge_counts", _with(G, "SELECT src, count(*) AS edges FROM g GROUP BY src"))
def stream_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.drain(streaming.maintained_counts(_stream(spark, sf_dir)), workspace(spark, "stream"))


@query("stream_windowed_counts", _with(G, "SELECT time_bucket(INTERVAL '1 day', ts) AS begin, src, count(*) AS edges FROM g GROUP BY 1, 2"))
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streaming.windowed_counts(_stream(spark, sf_dir), "ts", "1 day")
    return streaming.drain(rows, workspace(spark, "stream")).withColumn("begin", F.col("begin").cast("timestamp_ntz"))
