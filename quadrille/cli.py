"""python -m quadrille.cli [options] [files]: load RDF, infer, query, save.

Exit codes: 0 done, 1 a syntax or data error, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import sys
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .operators.store import QuadStore
from .session import Engine
from .sources.generator import Spec, bibliography
from .sources.readers import read_nquads, read_ntriples, read_turtle
from .sources.tokens import ParseError
from .storage import Folder, shared_folder


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quadrille", description="Query RDF files with SPARQL on Spark.")
    p.add_argument("files", nargs="*", help="Turtle files, unless another syntax is named")
    p.add_argument("-q", "--query", help="a SPARQL query, or @file; without it the query is read from standard input")
    p.add_argument("--ntriples", action="store_true", help="the files are N-Triples")
    p.add_argument("--nquads", action="store_true", help="the files are N-Quads")
    p.add_argument("--rdfs", action="store_true", help="store what follows by RDFS before the query")
    p.add_argument("--rdfs-query", action="store_true", help="apply RDFS while the query reads")
    p.add_argument("--naive", action="store_true", help="keep triple patterns in their written order")
    p.add_argument("--merge", action="store_true", help="ask for merge joins; without this and --no-merge Spark chooses")
    p.add_argument("--no-merge", action="store_true", help="ask for hash joins instead of merge joins")
    p.add_argument("--generate", type=int, metavar="N", help="load a generated bibliography of N papers")
    p.add_argument("--save", metavar="PATH", help="save the store")
    p.add_argument("--plain", action="store_true", help="save without compression")
    p.add_argument("--open", metavar="PATH", help="open a saved store")
    p.add_argument("--plan", action="store_true", help="print the algebra and the plan")
    p.add_argument("--profile", action="store_true", help="print the rows that each node gave; that runs the query once more")
    p.add_argument("--limit", type=int, default=20, metavar="N", help="print so many solutions at most")
    return p


def load(spark: SparkSession, args: argparse.Namespace, generated: Folder) -> QuadStore:
    parts: list[DataFrame] = []
    if args.generate is not None:
        generated.write_new(bibliography(Spec.sized(args.generate)))
        parts.append(read_turtle(spark, generated.path.toString()))
    if args.files:
        read = read_nquads if args.nquads else read_ntriples if args.ntriples else read_turtle
        parts.append(read(spark, args.files))
    if args.open and not parts:
        return QuadStore.open(spark, args.open)
    store = QuadStore.open(spark, args.open) if args.open else QuadStore.empty(spark)
    for p in parts:
        store = store.add(p)
    return store.cached()


def main(argv: list[str] | None = None) -> int:
    parser = arguments()
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    if not (args.files or args.open or args.generate is not None) or args.ntriples and args.nquads:
        parser.print_usage(sys.stderr)
        return 2
    spark = SparkSession.builder.appName("quadrille").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    generated = Folder(spark, f"{shared_folder(spark)}/generated-{uuid.uuid4().hex}.ttl")  # where executors can read it, too
    try:
        store = load(spark, args, generated)
        print(f"{store.triple_count()} triples in the default graph, {store.quad_count()} quads in all")
        if args.rdfs:
            store, stats = store.materialise_rdfs()
            print(f"RDFS: {stats.inferred} inferred in {stats.rounds} rounds, {stats.after} triples now")
        if args.save:
            store.save(args.save, "none" if args.plain else "zstd")
        text = args.query
        if text is None and not args.save and not sys.stdin.isatty():
            text = sys.stdin.read()
        if text and text.startswith("@"):
            text = Path(text[1:]).read_text()
        if text:
            out = Engine(store).run(text, naive_join_order=args.naive, enable_merge_join=True if args.merge else False if args.no_merge else None, rdfs_query_time=args.rdfs_query, row_counts=args.profile)
            if args.plan:
                print(out.algebra + out.plan())
            if args.profile:
                print(out.profile())
            print(out.table(args.limit))
    except ParseError as e:
        print(f"syntax error: {e}", file=sys.stderr)
        return 1
    except Exception as e:
        print(f"error: {str(e).splitlines()[0][:500] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1
    finally:
        generated.delete()
    return 0


if __name__ == "__main__":
    sys.exit(main())
