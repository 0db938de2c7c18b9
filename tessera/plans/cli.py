"""``python -m tessera.plans.cli build|search``: the two programs of a search engine."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.normalize import NormalizerConfig
from tessera.functions.scoring import scorer
from tessera.operators import index as ix
from tessera.operators.search import search
from tessera.sources.collections import read_collection, read_queries, run_lines, write_run

MODES = {"daat": "or", "daat-disjunctive": "or", "daat-c": "and", "daat-conjunctive": "and", "bmm": "pruned"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="index a tab-separated collection")
    b.add_argument("collection")
    b.add_argument("data", nargs="?", default="data")
    b.add_argument("--no-stemmer", action="store_true", help="neither stop words nor stemming")
    b.add_argument("--fix-encoding", action="store_true")
    b.add_argument("--latin1-case", action="store_true")
    s = sub.add_parser("search", help="answer queries")
    s.add_argument("data", nargs="?", default="data")
    s.add_argument("-q", "--query", action="append", default=[])
    s.add_argument("-b", "--batch", help="file of qid<TAB>text lines")
    s.add_argument("-o", "--out", help="folder for the run's lines; else they are printed")
    s.add_argument("-k", "--top-k", type=int, default=10)
    s.add_argument("-s", "--score", default="bm25")
    s.add_argument("-a", "--algorithm", default="daat")
    s.add_argument("-r", "--run-name", default="TESSERA0")
    s.add_argument("-t", "--threads", type=int, help="partitions of a search, where the session doesn't choose them itself")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "build":
        docs, corrupt = read_collection(spark, args.collection)
        config = NormalizerConfig(args.fix_encoding, args.latin1_case, not args.no_stemmer, not args.no_stemmer)
        built = ix.save(ix.build(ix.with_docids(docs), config, docno_col="docno"), args.data)
        print(f"{built.n_docs} documents, {built.lexicon.count()} terms, {corrupt.count()} corrupt lines")
        return
    if args.threads:
        spark.conf.set("spark.sql.shuffle.partitions", str(args.threads))
    index = ix.load(spark, args.data)

    def answer(queries: DataFrame) -> None:
        found = search(index, queries, args.top_k, MODES.get(args.algorithm, "or"), scorer(args.score))
        if args.out:
            write_run(found, args.out, args.run_name)
        else:
            for row in run_lines(found, args.run_name).orderBy("qid", "rank").toLocalIterator():
                print(row.line, flush=True)

    def asked(first: int, *texts: str) -> DataFrame:
        return spark.createDataFrame([(first + i, q) for i, q in enumerate(texts) if q], "qid long, text string")

    if args.batch:
        answer(read_queries(spark, args.batch)[0])
    elif args.query:
        answer(asked(1, *args.query))
    else:  # a query on each line, until there are no more
        for i, line in enumerate(sys.stdin, 1):
            answer(asked(i, line.strip()))


if __name__ == "__main__":
    main()
