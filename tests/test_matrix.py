"""Hand examples and properties of the matrix operators."""

import random

import pytest
from pyspark.sql import functions as F

from quillgrid.functions.scalars import permuted
from quillgrid.matrix import ShapeError, SparseMatrix
from quillgrid.operators import algebra, features, graph, layout, verify
from quillgrid.plans import strategy
from quillgrid.sources import coo, generators


def m(spark, entries, shape=None, double=False):
    return SparseMatrix.from_entries(spark, entries, shape, double)


def randomly(spark, rows, cols, n, seed):
    r = random.Random(seed)
    return m(spark, [(r.randrange(rows), r.randrange(cols), r.randrange(-5, 6)) for _ in range(n)], (rows, cols))


def test_multiply_by_hand(spark):
    a, b = m(spark, [(0, 0, 1), (0, 2, 2), (1, 1, 3)], (2, 3)), m(spark, [(0, 0, 4), (1, 1, 5), (2, 0, 6)], (3, 2))
    assert algebra.multiply(a, b).collect() == [(0, 0, 16), (1, 1, 15)]
    assert algebra.multiply(a, b, double=True).collect() == [(0, 0, 16.0), (1, 1, 15.0)]
    assert algebra.multiply(a, b, threshold=15).collect() == [(0, 0, 16)]
    assert algebra.multiply(a, b, blocks=(1, 2)).collect() == [(0, 0, 16), (1, 1, 15)]


def test_zeros(spark):
    a, b = m(spark, [(0, 0, 1), (0, 1, 2)], (2, 2)), m(spark, [(0, 0, -1), (1, 1, 5)], (2, 2))
    assert algebra.add(a, b).collect() == [(0, 0, 0), (0, 1, 2), (1, 1, 5)]
    assert algebra.add(a, b, drop_zeros=True).collect() == [(0, 1, 2), (1, 1, 5)]
    gone = algebra.multiply(m(spark, [(0, 0, 1), (0, 1, 1)], (1, 2)), m(spark, [(0, 0, 2), (1, 0, -2)], (2, 1)))
    assert gone.collect() == []


def test_duplicates_are_summed(spark):
    a = m(spark, [(0, 0, 1), (0, 0, 2), (1, 0, 3)])
    assert a.merged().collect() == [(0, 0, 3), (1, 0, 3)]
    assert (a.stored_entries(), a.nnz()) == (3, 2)


def test_shapes(spark):
    a, b = m(spark, [], (2, 3)), m(spark, [], (3, 2))
    with pytest.raises(ShapeError):
        algebra.add(a, b)
    with pytest.raises(ShapeError):
        algebra.multiply(a, a)
    with pytest.raises(ValueError):
        algebra.subtract(a, b)
    assert algebra.multiply(a, b).collect() == []
    assert m(spark, []).with_shape().shape == (0, 0)
    assert m(spark, [(4, 1, 1)]).with_shape().shape == (5, 2)


def test_pointers_and_layouts(spark):
    a = m(spark, [(1, 0, 5), (1, 2, 6), (3, 1, 7)], (4, 3))
    assert [r.ptr for r in layout.row_pointers(a).orderBy("i").collect()] == [0, 0, 2, 2, 3]
    assert [r.ptr for r in layout.col_pointers(a).orderBy("j").collect()] == [0, 1, 2, 3]
    assert [tuple(r) for r in layout.csr_rows(a).orderBy("i").collect()] == [(1, [0, 2], [5, 6]), (3, [1], [7])]
    assert [tuple(r) for r in layout.csc_cols(a).orderBy("j").collect()] == [(0, [1], [5]), (1, [3], [7]), (2, [1], [6])]
    assert layout.row_block(a, 1, 3).collect() == [(0, 0, 5), (0, 2, 6)]
    assert layout.col_block(a, 1, 3).collect() == [(1, 1, 6), (3, 0, 7)]
    assert layout.get_row(a, 0).collect() == []
    for bad in (lambda: layout.get_row(a, 4), lambda: layout.get_col(a, 3), lambda: layout.row_block(a, 2, 5), lambda: layout.get_row(a, -1)):
        with pytest.raises(IndexError):
            bad()
    assert layout.from_csr(layout.csr_rows(a)).collect() == layout.from_csc(layout.csc_cols(a)).collect() == a.collect()


def test_pointers_across_ranges(spark):
    a = m(spark, [(0, 0, 1), (5000, 0, 1), (5000, 1, 1), (9000, 0, 1)], (9001, 2))
    found = {r.i: r.ptr for r in layout.row_pointers(a).collect()}
    assert len(found) == 9002 and [found[k] for k in (0, 1, 5000, 5001, 9000, 9001)] == [0, 1, 1, 3, 3, 4]


def test_laws(spark):
    a, b, c = randomly(spark, 9, 7, 30, 1), randomly(spark, 9, 7, 25, 2), randomly(spark, 7, 8, 30, 3)
    assert verify.equal(algebra.add(a, b), algebra.add(b, a))
    assert verify.equal(algebra.transpose(algebra.multiply(a, c)), algebra.multiply(algebra.transpose(c), algebra.transpose(a)))
    assert verify.equal(algebra.multiply(algebra.add(a, b), c), algebra.add(algebra.multiply(a, c), algebra.multiply(b, c)))
    assert verify.equal(algebra.subtract(a, a), m(spark, [], (9, 7)))
    x, y = layout.csr_rows(a), layout.csr_rows(b)
    assert layout.from_csr(layout.csr_add(x, y)).collect() == algebra.add(a, b).collect()
    dense = SparseMatrix(algebra.dense_multiply(a, c), (9, 8))
    assert verify.equal(dense, algebra.multiply(a, c))
    assert not verify.equal(a, b)
    assert algebra.densify(a).count() == 63


def test_densify_shuffles_no_cells(spark):
    """Tiles that the shape cuts off, entries outside of it, a full matrix; what is shuffled grows with entries and tiles, not with cells."""
    for rows, cols, n in ((0, 5, 0), (1, 5000, 40), (5000, 1, 40), (33, 257, 300), (17, 300, 20_000)):
        a = randomly(spark, rows, cols, n, rows) if n else m(spark, [], (rows, cols))
        outside = m(spark, [(-1, 0, 9), (0, -1, 9), (rows, 0, 9), (0, cols, 9)])
        got = algebra.densify(SparseMatrix(a.df.unionByName(outside.df), (rows, cols)))
        cells, want = [tuple(r) for r in got.collect()], {(i, j): v for i, j, v in a.merged().collect()}
        assert sorted(cells) == [(i, j, want.get((i, j), 0)) for i in range(rows) for j in range(cols)]

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = algebra.densify(m(spark, [(0, 0, 1), (999, 999, 2)], (1000, 1000)))._jdf.queryExecution().executedPlan()
        assert plan.execute().count() == 1_000_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)

    def shuffled(node):
        own = node.metrics().get("shuffleRecordsWritten").get().value() if node.nodeName() == "Exchange" else 0
        return own + sum(shuffled(node.children().apply(k)) for k in range(node.children().size()))

    assert 0 < shuffled(plan) < 1000


def test_verification(spark):
    a, b = m(spark, [(0, 0, 1), (0, 1, 2)]), m(spark, [(0, 0, 1), (1, 1, 4)])
    assert verify.max_abs_diff(a, b).first()[0] == 4
    assert sorted(map(tuple, verify.set_difference(a, b).collect())) == [("a", 0, 1, 2), ("b", 1, 1, 4)]
    assert [r.ok for r in verify.lookup(a, b).orderBy("i", "j").collect()] == [True, False]
    assert verify.nnz_match(a, b).first().same


def test_parsing(spark):
    lines = spark.createDataFrame([(x,) for x in ("1,1,2.9", "1,2", "x,1,1", "2.0,1,1", " 2 , 1 , -1.7 ", "1,3,abc")], "value string")
    got = coo.parse_lines(lines)
    assert sorted(tuple(r)[:3] for r in got.filter("ok").collect()) == [(0, 0, 2), (1, 0, -1)]
    assert got.filter("NOT ok").count() == 4
    assert sorted(r.v for r in coo.parse_lines(lines, double=True).filter("ok").collect()) == [-1.7, 2.9]


def test_files(spark, tmp_path):
    a = randomly(spark, 20, 30, 60, 5).merged()
    coo.write_coo(a, f"{tmp_path}/a", ordered=True)
    assert coo.read_coo(spark, f"{tmp_path}/a").collect() == a.collect()
    assert coo.rejected_lines(spark, f"{tmp_path}/a") == 0 and coo.count_lines(spark, f"{tmp_path}/a") == a.nnz()
    coo.sort_file(spark, f"{tmp_path}/a", f"{tmp_path}/s", by_columns=True)
    coo.save_csr(a, f"{tmp_path}/csr")
    coo.save_csc(a, f"{tmp_path}/csc")
    assert coo.load_csr(spark, f"{tmp_path}/csr").collect() == coo.load_csc(spark, f"{tmp_path}/csc").collect() == a.collect()
    with pytest.raises(FileNotFoundError):
        coo.read_coo(spark, f"{tmp_path}/none").collect()
    assert coo.read_report(spark, f"{tmp_path}/none") is None
    (tmp_path / "g.csv").write_text("0,1\n0,1\n2,0\n")
    edges = coo.read_edges(spark, f"{tmp_path}/g.csv")
    assert graph.node_count(edges) == 3 and coo.read_edges(spark, f"{tmp_path}/g.csv", nodes=2).count() == 2


def test_edge_files(spark, tmp_path):
    (tmp_path / "w.csv").write_text("1,2,5\n1,2,1\n\n3,1,4\n9,1,7\n")
    assert sorted(map(tuple, coo.read_edges(spark, f"{tmp_path}/w.csv", base=1).collect())) == [(0, 1), (0, 1), (2, 0), (8, 0)]
    cells = {(r.i, r.j): r.v for r in coo.read_dense(spark, f"{tmp_path}/w.csv", 3).collect()}
    assert len(cells) == 9 and {k: v for k, v in cells.items() if v} == {(0, 1): 6, (2, 0): 4}
    (tmp_path / "bad.csv").write_text("1,2\n1\n")
    with pytest.raises(Exception, match="no dst in line: 1"):
        coo.read_edges(spark, f"{tmp_path}/bad.csv").collect()
    (tmp_path / "h.csv").write_text("note,value,col,row\na,2.9,1,1\nb,x,1,1\nc,-1.7,1,2\n")
    assert coo.read_table(spark, f"{tmp_path}/h.csv").collect() == [(0, 0, 2), (1, 0, -1)]
    with pytest.raises(ValueError):
        coo.read_table(spark, f"{tmp_path}/h.csv", names=("row", "col", "weight"))


def test_arrays(spark):
    a = randomly(spark, 9, 7, 30, 11)
    i, j, v = a.merged().to_arrays()
    assert SparseMatrix.from_arrays(spark, i, j, v, (9, 7)).collect() == a.merged().collect()
    ptr, cols, values = a.to_csr()
    assert len(ptr) == 10 and ptr[-1] == a.nnz()
    assert SparseMatrix.from_csr(spark, ptr, cols, values, (9, 7)).collect() == a.merged().collect()
    with pytest.raises(ValueError):
        a.collect(limit=3)
    with pytest.raises(ValueError):
        SparseMatrix.from_arrays(spark, [1], [1, 2], [1])


def test_chunks(spark):
    a = randomly(spark, 6, 300, 400, 12)
    chunks = layout.csr_chunks(a, 50)
    assert max(len(r.col_idx) for r in chunks.collect()) <= 50 and chunks.filter("i = 0").count() > 1
    assert layout.from_csr(chunks).collect() == layout.from_csc(layout.csc_chunks(a, 2)).collect() == a.merged().collect()


def test_dense_blocks(spark, monkeypatch):
    a, b = randomly(spark, 40, 30, 300, 13), randomly(spark, 30, 50, 300, 14)
    dense = {(r.i, r.j): r.v for r in algebra.dense_multiply(a, b).collect()}
    assert len(dense) == 2000
    assert {k: v for k, v in dense.items() if v} == {(i, j): v for i, j, v in algebra.multiply(a, b).collect()}
    assert algebra.dense_multiply(m(spark, [], (2, 3)), m(spark, [], (3, 2))).count() == 4
    far = m(spark, [(600, 300, 2)], (601, 301)), m(spark, [(300, 500, 3)], (301, 501))
    assert algebra.dense_multiply(*far).filter("v <> 0").collect() == [(600, 500, 6)]


def long_h(rows):
    return sorted(map(tuple, features.unpacked(rows, "src", "h").collect()))


def test_graph_by_hand(spark, monkeypatch):
    edges = spark.createDataFrame([(0, 1), (0, 1), (2, 0)], "src long, dst long")
    x = spark.createDataFrame([(0, [1]), (1, [10])], "node long, x array<long>")
    assert long_h(graph.aggregate_all(edges, x, 3, 1)) == [(0, 0, 20), (1, 0, 0), (2, 0, 1)]
    new = spark.createDataFrame([(1, 0)], "src long, dst long")
    step = graph.update_incremental(graph.aggregate(edges, x), graph.update_delta(new, x))
    assert long_h(step) == long_h(graph.update_full(edges, new, x)) == [(0, 0, 20), (1, 0, 1), (2, 0, 1)]
    weights = spark.createDataFrame([(0, 0, 2), (0, 1, 3)], "d long, e long, w long")
    assert sorted(map(tuple, features.unpacked(graph.forward(edges, x, weights), "src", "y", "e").collect())) == [(0, 0, 40), (0, 1, 60), (2, 0, 2), (2, 1, 3)]
    gaps = spark.createDataFrame([(2, 1, 5), (0, 3, 2)], "d long, e long, w long")
    wide = spark.createDataFrame([(7, [1, 2, 3])], "src long, h array<long>")
    assert sorted(map(tuple, features.unpacked(graph.transform(wide, gaps), "src", "y", "e").collect())) == [(7, 1, 15), (7, 3, 2)]
    monkeypatch.setattr(features, "LAYER", 1)  # a layer too large to be sent to every task
    assert sorted(map(tuple, features.unpacked(graph.forward(edges, x, weights), "src", "y", "e").collect())) == [(0, 0, 40), (0, 1, 60), (2, 0, 2), (2, 1, 3)]
    some = graph.sample_new_edges(edges, 50, 3)
    assert some.count() == 3 and some.filter("src = dst").count() == 0


def test_packed_features(spark, monkeypatch):
    long = spark.createDataFrame([(0, 0, 1.5), (0, 2, 2.0), (1, 1, -1.0)], "node long, d long, x double")
    rows = features.packed(long)
    assert sorted(map(tuple, rows.collect())) == [(0, [1.5, None, 2.0]), (1, [None, -1.0, None])]
    assert sorted(map(tuple, features.unpacked(rows, "node", "x").collect())) == sorted(map(tuple, long.collect()))
    weighed = spark.createDataFrame([(7, 0, 2), (7, 1, 3), (8, 0, 1)], "src long, dst long, w long")
    columns = long_h(graph.weighted_aggregate(weighed, rows))
    monkeypatch.setattr(features, "COLUMNS", 1)  # arrays too long for columns are summed by place
    assert long_h(graph.weighted_aggregate(weighed, rows)) == columns == [(7, 0, 3.0), (7, 1, -3.0), (7, 2, 4.0), (8, 0, 1.5), (8, 2, 2.0)]


def test_aggregate_state(spark, tmp_path):
    """A carried aggregate equals the one worked out anew, and an update writes only the buckets that it touches."""
    edges = generators.weighted_graph(spark, 60, 4).select("src", "dst")
    x = spark.range(60).select(F.col("id").alias("node"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda d: F.col("id") * 7 + d).alias("x"))
    state = graph.AggregateState(spark, f"{tmp_path}/s", buckets=16).start(graph.aggregate(edges, x, 5))
    new = spark.createDataFrame([(3, 5), (3, 5), (70, 1)], "src long, dst long")
    state.update(new, x, 5)
    assert long_h(state.load()) == long_h(graph.update_full(edges, new, x, 5))
    versions = list(state.versions().values())
    assert 1 <= versions.count(1) <= 2 and versions.count(0) >= 13
    state.update(new.limit(2).withColumn("w", F.lit(-1)), x, 5)
    assert long_h(graph.AggregateState(spark, f"{tmp_path}/s", buckets=16).load().filter("src = 3")) == long_h(graph.aggregate(edges.filter("src = 3"), x, 5))
    (tmp_path / "s" / "rows" / "v=3").mkdir()  # of an update that broke off
    state.update(new.limit(1), x, 5)
    assert max(state.versions().values()) == 3


def test_generators(spark):
    assert generators.banded(spark, 10, 1).df.count() == 28
    with pytest.raises(ValueError):
        generators.uniform_matrix(spark, 3, 3, 10, unique=True)
    with pytest.raises(ValueError):
        generators.check_safety(10**9)
    for nnz in (9, 40, 90):
        got = generators.uniform_matrix(spark, 10, 10, nnz, unique=True).df
        assert got.count() == nnz == got.distinct().count() == got.select("i", "j").distinct().count()
    once, again = (generators.uniform_matrix(spark, 50, 60, 500).df.orderBy("i", "j", "v").collect() for _ in range(2))
    assert once == again
    long = generators.power_law(spark, 100, 80, 1000).df
    assert long.count() == long.select("i", "j").distinct().count()
    assert abs(features.unpacked(generators.features(spark, 200, 16), "node", "x").agg(F.avg("x")).first()[0]) < 0.1
    assert generators.dense_matrix(spark, 4, 5).nnz() == 20


def test_permutation(spark):
    """Every number once, for odd sizes; keys give different orders, and places are even."""
    for n in (1, 2, 3, 7, 100, 101, 997):
        got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), n, 5)).collect()]
        assert sorted(got) == list(range(n))
    one, two = ({(r.i, r.j) for r in generators.uniform_matrix(spark, 300, 200, 2000, seed, unique=True).df.collect()} for seed in (1, 2))
    assert len(one) == len(two) == 2000 and len(one & two) < 140  # 67 expected
    cells = [sum((i // 30, j // 20) == (a, b) for i, j in one) for a in range(10) for b in range(10)]
    assert sum((c - 20) ** 2 / 20 for c in cells) < 160  # chi square of 99 degrees
    gaps = sorted(i * 200 + j for i, j in one)
    assert len({q - p for p, q in zip(gaps, gaps[1:], strict=False)}) > 60
    columns = generators.power_law(spark, 400, 50, 8000, seed=3).df.groupBy("j").count().collect()
    n = sum(r["count"] for r in columns)
    assert len(columns) == 50 and sum((r["count"] - n / 50) ** 2 / (n / 50) for r in columns) < 100


def test_strategy(spark):
    a = randomly(spark, 10, 10, 80, 9)
    assert strategy.multiplication_choice(a, a).first().choice == "dense"
    thin = m(spark, [(0, 0, 1)], (100, 100))
    assert strategy.multiplication_choice(thin, thin).first().choice == "sparse"
    assert strategy.memory_footprint(thin, thin).first().ratio == 5000
