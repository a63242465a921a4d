"""Command line: generate, sort, add, multiply, benchmark, verify."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quillgrid.operators import algebra, graph, verify
from quillgrid.plans import reports, runs
from quillgrid.sources import coo, generators
from quillgrid.sources.workspace import workspace


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillgrid", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    make = commands.add_parser("generate", help="write a synthetic matrix")
    make.add_argument("out")
    make.add_argument("--kind", choices=("uniform", "banded", "block", "power-law", "preset"), default="uniform")
    make.add_argument("--rows", type=int, default=1000)
    make.add_argument("--cols", type=int, default=1000)
    make.add_argument("--nnz", type=int, default=10_000)
    make.add_argument("--bandwidth", type=int, default=5)
    make.add_argument("--blocks", type=int, default=10)
    make.add_argument("--density", type=float, default=0.1)
    make.add_argument("--alpha", type=float, default=2.0)
    make.add_argument("--seed", type=int, default=42)
    make.add_argument("--unique", action="store_true")
    make.add_argument("--max-memory", type=float, default=500.0, help="MB that the entries may take")
    order = commands.add_parser("sort", help="sort a coordinate file")
    order.add_argument("path")
    order.add_argument("out")
    order.add_argument("--by-columns", action="store_true")
    for name in ("add", "multiply"):
        two = commands.add_parser(name, help=f"{name} two coordinate files")
        two.add_argument("a")
        two.add_argument("b")
        two.add_argument("out")
        two.add_argument("--double", action="store_true")
        two.add_argument("--report", help="folder for the run's record as JSON: sizes, shapes, densities, phases")
    bench = commands.add_parser("benchmark", help="time two ways against each other and write the record")
    bench.add_argument("kind", choices=("parallel", "dense", "updates"), help="parallel or serial, sparse or dense products of two files; full or incremental updates of an edge list's aggregate")
    bench.add_argument("a")
    bench.add_argument("b", nargs="?", help="the second matrix")
    bench.add_argument("--operation", choices=("add", "multiply"), default="multiply")
    bench.add_argument("--runs", type=int, default=3)
    bench.add_argument("--dims", type=int, default=128)
    bench.add_argument("--added", type=int, nargs="+", default=[1, 2, 3])
    bench.add_argument("--report", help="folder for the records as JSON")
    same = commands.add_parser("verify", help="compare two coordinate files")
    same.add_argument("a")
    same.add_argument("b")
    same.add_argument("--tolerance", type=float, default=1e-6)
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    """Runs a parsed command; 0 for success, 1 for matrices that differ."""
    if args.command == "generate":
        generators.check_safety(args.nnz, args.max_memory)
        if args.kind == "preset":
            for name, matrix in generators.presets(spark, args.seed).items():
                coo.write_coo(matrix, f"{args.out}/{name}")
            return 0
        made = {
            "uniform": lambda: generators.uniform_matrix(spark, args.rows, args.cols, args.nnz, args.seed, args.unique),
            "banded": lambda: generators.banded(spark, args.rows, args.bandwidth, args.seed),
            "block": lambda: generators.block_diagonal(spark, args.blocks, max(1, args.rows // args.blocks), args.density, args.seed),
            "power-law": lambda: generators.power_law(spark, args.rows, args.cols, args.nnz, args.alpha, args.seed),
        }[args.kind]()
        coo.write_coo(made, args.out)
    elif args.command == "sort":
        coo.sort_file(spark, args.path, args.out, args.by_columns)
    elif args.command in ("add", "multiply") and args.report:
        coo.write_report(runs.run(spark, args.command, args.a, args.b, args.out, double=args.double), args.report)
    elif args.command in ("add", "multiply"):
        a, b = (coo.read_coo(spark, p, double=args.double) for p in (args.a, args.b))
        coo.write_coo(algebra.add(a, b) if args.command == "add" else algebra.multiply(a, b), args.out)
    elif args.command == "benchmark":
        if args.kind == "updates":
            edges = coo.read_edges(spark, args.a)
            x = generators.features(spark, graph.node_count(edges), args.dims)
            record = runs.full_or_incremental(spark, edges, x, args.dims, workspace(spark, "benchmark"), args.added)
        else:
            if args.b is None:
                raise SystemExit("a second matrix is needed")
            a, b = (coo.read_coo(spark, p) for p in (args.a, args.b))
            work = algebra.add if args.operation == "add" else algebra.multiply
            record = runs.sparse_or_dense(spark, a, b, args.runs) if args.kind == "dense" else runs.parallel_or_serial(spark, lambda: work(a, b).df, args.runs)
        print(reports.as_text(record, args.kind))
        if args.report:
            coo.write_report(record, args.report)
    else:
        a, b = (coo.read_coo(spark, p, double=True) for p in (args.a, args.b))
        same = verify.equal(a, b, args.tolerance)
        print("equal" if same else "different")
        return int(not same)
    return 0


def main() -> int:
    spark = SparkSession.builder.appName("quillgrid").getOrCreate()
    return run(spark, parser().parse_args())


if __name__ == "__main__":
    raise SystemExit(main())
