"""Command line: ``python -m faultline.cli <command> ...``; every answer is printed as one JSON object per row."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import api
from .schema import LANGUAGES


def parse_duration(text: str) -> int:
    """Milliseconds of ``2s``, ``500ms`` or a bare number of milliseconds."""
    number, times = (text[:-2], 1) if text.endswith("ms") else (text[:-1], 1000) if text.endswith("s") else (text, 1)
    return int(number) * times


def parse_weights(text: str) -> tuple[float, ...]:
    """Four numbers: churn, bug density, ownership, fanout."""
    out = tuple(float(p) for p in text.split(",") if p.strip())
    if len(out) != 4:
        raise argparse.ArgumentTypeError("four weights are needed: churn,bug_density,ownership,fanout")
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="faultline")
    p.add_argument("--store", default=".faultline/index")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple, **options) -> None:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for o, default in options.items():
            c.add_argument(f"--{o.replace('_', '-')}", default=default, type=type(default) if default is not None else str)

    index = sub.add_parser("index")
    index.add_argument("roots", nargs="+")
    command("impact", "symbol", limit=api.IMPACT, in_file=None)
    command("review", "root", base="HEAD", limit=api.REVIEW)
    command("locate", "task", limit=api.LOCATE)
    command("search", "query", limit=api.SEARCH)
    command("neighbors", "symbol", direction="out", depth=api.NEIGHBORS_DEPTH, limit=api.NEIGHBORS, kinds=None)
    command("parse", "file")
    command("path", "start", "goal", depth=api.PATH_DEPTH, limit=api.PATHS)
    command("risk", symbol=None)
    command("explain", "a", "b")
    command("uses", "dep", "symbol")
    command("mcp")
    evaluate = sub.add_parser("eval")
    evaluate.add_argument("what", choices=["recall", "risk", "grep"])
    evaluate.add_argument("root")
    evaluate.add_argument("--commits", type=int, default=50)
    evaluate.add_argument("--weights", type=parse_weights, default=None)
    return p


def answer(engine: api.Engine, a: argparse.Namespace):
    c = a.command
    if c == "impact":
        return engine.impact(a.symbol, a.limit, a.in_file)
    if c == "review":
        from .sources.git import changed_ranges

        return engine.review(changed_ranges(engine.spark, a.root, a.base), a.limit)
    if c == "locate":
        return engine.locate(a.task, a.limit)
    if c == "search":
        return engine.search(a.query, a.limit)
    if c == "neighbors":
        return engine.neighbors(a.symbol, a.direction, a.kinds.split(",") if a.kinds else None, a.depth, a.limit)
    if c == "path":
        return engine.path(a.start, a.goal, a.depth, a.limit)
    if c == "risk":
        return engine.risk(a.symbol)
    if c == "eval":
        from .sources.files import discover
        from .sources.git import history

        log = api.commit_files(history(engine.spark, a.root))
        if a.what == "recall":
            return engine.evaluate_recall(log, a.commits)
        if a.what == "risk":
            return engine.evaluate_risk(log, a.commits, a.weights)
        return engine.evaluate_grep(log, discover(engine.spark, [a.root]).selectExpr("module_path AS file", "cast(content AS string) AS text"), a.commits)
    if c == "explain":
        return engine.explain_edge(a.a, a.b)
    return engine.uses(a.dep, a.symbol).select("key", "module_path")


def parsed(path: str) -> list[dict]:
    """The facts of one file, as an index would read them."""
    from .extract.base import facts_of

    language = next((lang for lang, suffixes in LANGUAGES.items() if path.endswith(tuple(suffixes))), "")
    with open(path, encoding="utf-8", errors="replace") as f:
        return facts_of(language, path, f.read())


def history_of(spark: SparkSession, roots: list[str]):
    """The commits of all roots that have any, with files named as the index names them; None where none has."""
    import subprocess

    from pyspark.sql import functions as F

    from .sources.files import unique_tags
    from .sources.git import history

    out = None
    for tag, path in unique_tags(roots):
        try:
            log = history(spark, path)
            if log.isEmpty():
                continue
        except (subprocess.CalledProcessError, OSError) as e:
            print(f"no history of {path}: {e}", file=sys.stderr)
            continue
        one = api.commit_files(log)
        if len(roots) > 1:
            one = one.withColumn("file", F.concat(F.lit(f"{tag}/"), F.col("file"))).withColumn("commit", F.concat(F.lit(f"{tag}:"), F.col("commit")))
        out = one if out is None else out.unionByName(one)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "parse":
        for fact in parsed(a.file):
            print(json.dumps(fact))
        return 0
    spark = spark or SparkSession.builder.appName("faultline").getOrCreate()
    if a.command == "index":
        engine = api.Engine.index_roots(spark, a.roots, history_of(spark, a.roots), a.store)
        print(f'{{"nodes": {engine.nodes.count()}, "edges": {engine.edges.count()}}}')
        return 0
    engine = api.Engine.load(spark, a.store)
    if a.command == "mcp":
        from .mcp import serve

        serve(engine, sys.stdin, sys.stdout)
        return 0
    for line in answer(engine, a).toJSON().collect():
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
