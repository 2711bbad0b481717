"""python -m tessera index [--reindex] [--no-graph] | ask QUESTION [--repo R] [--no-graph] [--no-bm25] | stats | graph-stats"""

from __future__ import annotations

import argparse
import sys


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("--index-dir", default=None)
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index")
    i.add_argument("--repos-dir", default=None)
    i.add_argument("--reindex", action="store_true")
    i.add_argument("--no-graph", action="store_true")
    a = sub.add_parser("ask")
    a.add_argument("question")
    a.add_argument("--repo", default=None)
    a.add_argument("--no-graph", action="store_true")
    a.add_argument("--no-bm25", action="store_true")
    sub.add_parser("stats")
    sub.add_parser("graph-stats")
    return p


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .plans import ask, index, service
    from .sources.repos import git_metadata, load_repos

    spark = SparkSession.builder.appName("tessera").getOrCreate()
    at = index.Index(spark, args.index_dir)
    if args.command == "index":
        print(index.run(spark, load_repos(spark, args.repos_dir, git_metadata(spark, args.repos_dir)), args.index_dir, args.reindex, not args.no_graph))
        return 0
    if not at.exists():
        print("There is no index yet; run 'index' first.", file=sys.stderr)
        return 1
    if args.command == "ask":
        q = spark.createDataFrame([("0", args.question)], "query_id string, query string")
        row = ask.answer(at, q, repo=args.repo, use_graph=not args.no_graph, use_bm25=not args.no_bm25).first()
        print(row["answer"], *(f"- {f}" for f in row["relevant_files"]), sep="\n")
    elif args.command == "stats":
        for df in service.index_stats(at):
            df.show(truncate=False)
    else:
        service.graph_stats(at).show(40, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
