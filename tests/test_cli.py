"""The command line, reports and streams."""

from pyspark.sql import functions as F

from quillgrid import cli
from quillgrid.matrix import SparseMatrix
from quillgrid.operators import graph
from quillgrid.plans import reports, runs
from quillgrid.sources import coo
from quillgrid.streaming import edges as streaming


def run(spark, *args):
    return cli.run(spark, cli.parser().parse_args(list(map(str, args))))


def test_commands(spark, tmp_path):
    a = SparseMatrix.from_entries(spark, [(0, 0, 1), (0, 2, 2), (1, 1, 3)])
    b = SparseMatrix.from_entries(spark, [(0, 0, 4), (1, 1, 5), (2, 0, 6)])
    coo.write_coo(a, f"{tmp_path}/a")
    coo.write_coo(b, f"{tmp_path}/b")
    assert run(spark, "multiply", f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/c") == 0
    assert coo.read_coo(spark, f"{tmp_path}/c").collect() == [(0, 0, 16), (1, 1, 15)]
    assert run(spark, "add", f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/s") == 0
    assert coo.read_coo(spark, f"{tmp_path}/s").collect() == [(0, 0, 5), (0, 2, 2), (1, 1, 8), (2, 0, 6)]
    assert run(spark, "sort", f"{tmp_path}/s", f"{tmp_path}/t", "--by-columns") == 0
    assert run(spark, "verify", f"{tmp_path}/s", f"{tmp_path}/t") == 0
    assert run(spark, "verify", f"{tmp_path}/a", f"{tmp_path}/b") == 1
    for kind in ("uniform", "banded", "block", "power-law"):
        assert run(spark, "generate", f"{tmp_path}/g", "--kind", kind, "--rows", 60, "--cols", 60, "--nnz", 100) == 0
        assert coo.read_coo(spark, f"{tmp_path}/g", double=True).stored_entries() >= 30


def test_reports(spark, tmp_path):
    times = reports.timed(spark, "range", lambda: spark.range(10), runs=2)
    row = reports.summary(times).first()
    assert row["mean"] > 0 and row["rows_per_second"] > 0
    x = spark.createDataFrame([("a", 1.0), ("b", 4.0)], "case string, seconds double")
    y = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 1.0)], "case string, seconds double")
    both = reports.compared(x, y, "case")
    assert {r.case: (r.speedup, r.winner) for r in both.collect()} == {"a": (2.0, "first"), "b": (0.25, "second")}
    assert {r.winner: r.wins for r in reports.wins(both).collect()} == {"first": 1, "second": 1}
    phases = spark.createDataFrame([("load", 1.0), ("join", 3.0)], "phase string, seconds double")
    assert {r.phase: r.pct for r in reports.phase_shares(phases).collect()} == {"load": 25.0, "join": 75.0}
    coo.write_report(both, f"{tmp_path}/r")
    assert coo.read_report(spark, f"{tmp_path}/r", lines=True).count() == 2
    (tmp_path / "array.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert coo.read_report(spark, f"{tmp_path}/array.json").count() == 2
    assert "speedup" in reports.as_text(both, "times")


def test_stream_drops_repeats(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (2, 0, 2)], "event_id long, src long, dst long").withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    rows.coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = streaming.once_each(streaming.edge_stream(spark, f"{tmp_path}/e", rows.schema), "ts")
    got = streaming.drain(stream.select("event_id", "src", "dst"), f"{tmp_path}/c", mode="append")
    assert sorted(r.event_id for r in got.collect()) == [1, 2]


def test_stream_of_several_batches(spark, tmp_path):
    """A table maintained over batches is that of all edges."""
    rows = spark.range(90).select((F.col("id") % 7).alias("src"), (F.col("id") % 3).alias("dst"))
    rows.repartition(3).write.parquet(f"{tmp_path}/e")
    x = spark.createDataFrame([(0, [1, 2]), (1, [3, 4]), (2, [5, 6])], "node long, x array<long>")
    stream = streaming.edge_stream(spark, f"{tmp_path}/e", rows.schema)
    got = streaming.drain(streaming.maintained_aggregate(stream, x, 2), f"{tmp_path}/s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph.aggregate(rows, x, 2).collect()))


def test_runs(spark, tmp_path):
    a = SparseMatrix.from_entries(spark, [(0, 0, 1), (0, 2, 2), (1, 1, 3)])
    b = SparseMatrix.from_entries(spark, [(0, 0, 4), (1, 1, 5), (2, 0, 6)])
    coo.write_coo(a, f"{tmp_path}/a")
    coo.write_coo(b, f"{tmp_path}/b")
    assert run(spark, "multiply", f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/c", "--report", f"{tmp_path}/r") == 0
    r = coo.read_report(spark, f"{tmp_path}/r", lines=True).first()
    assert (r.rows_a, r.cols_a, r.rows_b, r.cols_b, r.rows_c, r.cols_c, r.nnz_a, r.nnz_b, r.nnz_c, r.flops) == (2, 3, 3, 2, 2, 2, 3, 3, 2, 6)
    assert r.density_a_pct == 50.0 and r.total_s >= r.compute_s > 0 and len(r["at"]) == 19
    record = runs.run(spark, "add", f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/d")
    assert record.first().nnz_c == 4 and abs(sum(p.pct for p in runs.phases(record).collect()) - 100) < 1e-6


def test_harnesses(spark, tmp_path):
    edges = spark.range(300).select((F.col("id") * 7 % 50).alias("src"), (F.col("id") * 11 % 40).alias("dst"))
    x = spark.range(50).select(F.col("id").alias("node"), F.array(F.col("id"), F.col("id") + 1).alias("x"))
    found = runs.full_or_incremental(spark, edges, x, 2, f"{tmp_path}/h", added=(1, 3)).collect()
    assert [(r.edges_added, r.agree) for r in found] == [(1, True), (3, True)] and all(r.winner in ("full", "incremental") for r in found)
    one = runs.parallel_or_serial(spark, lambda: edges.groupBy("src").count(), runs=1).first()
    assert one.speedup > 0 and one.winner in ("parallel", "serial")


def test_benchmarks(spark, tmp_path):
    a = SparseMatrix.from_entries(spark, [(0, 0, 1), (0, 2, 2), (1, 1, 3)])
    coo.write_coo(a, f"{tmp_path}/a")
    for kind in ("parallel", "dense"):
        assert run(spark, "benchmark", kind, f"{tmp_path}/a", f"{tmp_path}/a", "--runs", 1, "--report", f"{tmp_path}/{kind}") == 0
        assert coo.read_report(spark, f"{tmp_path}/{kind}", lines=True).first().winner in (kind, "serial", "sparse")
    (tmp_path / "g.csv").write_text("0,1\n1,2\n2,0\n5,1\n")
    assert run(spark, "benchmark", "updates", f"{tmp_path}/g.csv", "--dims", 3, "--added", 2, "--report", f"{tmp_path}/u") == 0
    r = coo.read_report(spark, f"{tmp_path}/u", lines=True).first()
    assert r.edges_added == 2 and r.agree and r.winner in ("full", "incremental")
