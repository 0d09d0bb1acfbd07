"""Command line: ``python -m docquarry.cli <command>``."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from docquarry.config import ChunkSettings, EngineConfig, SearchSettings
from docquarry.errors import QuarryError
from docquarry.operators.answer import prompt_ids
from docquarry.operators.evaluate import default_evaluations, evaluate, simplify_run


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="docquarry")
    root.add_argument("--data-dir", default=".docquarry")
    root.add_argument("--json", action="store_true", help="print JSON lines")
    root.add_argument("--model", default="sha256")
    commands = root.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="index a folder, or one file of it")
    index.add_argument("folder")
    index.add_argument("--file")
    index.add_argument("--force", action="store_true")
    index.add_argument("--chunk-size", type=int)
    index.add_argument("--chunk-overlap", type=int)
    index.add_argument("--no-semantic", action="store_true")
    clear = commands.add_parser("clear", help="delete sources, or everything")
    clear.add_argument("source_ids", nargs="*")
    clear.add_argument("--all", action="store_true")
    query = commands.add_parser("query", help="answer questions")
    query.add_argument("questions", nargs="+")
    query.add_argument("-k", type=int, default=4)
    query.add_argument("--prompt", default="default")
    query.add_argument("--rerank", action="store_true")
    query.add_argument("--hybrid", action="store_true")
    summarize = commands.add_parser("summarize")
    summarize.add_argument("-k", type=int, default=5)
    commands.add_parser("list")
    commands.add_parser("prompts")
    commands.add_parser("repl", help="answer one question per input line")
    judge = commands.add_parser("eval", help="score a run against judgements, both parquet")
    judge.add_argument("run", nargs="?")
    judge.add_argument("qrels", nargs="?")
    return root


def emit(rows, as_json: bool, out=None) -> None:
    """Print dictionaries as JSON lines, or as ``key: value`` blocks."""
    out = out or sys.stdout
    for row in rows:
        if as_json:
            print(json.dumps(row, default=str, ensure_ascii=False), file=out)
        else:
            print("\n".join(f"{key}: {value}" for key, value in row.items()) + "\n", file=out)


def _chunks(args) -> ChunkSettings:
    given = {"size": args.chunk_size, "overlap": args.chunk_overlap}
    chosen = {key: value for key, value in given.items() if value is not None}
    return ChunkSettings.from_environment(semantic=not args.no_semantic, **chosen)


def run(args, spark, out=None) -> int:
    """Carry out parsed arguments on a session."""
    from docquarry.engine import Engine
    from docquarry.service import rows

    def show(found) -> None:
        emit(found, args.json, out)

    if args.command == "prompts":
        show({"prompt_id": p} for p in prompt_ids())
        return 0
    if args.command == "eval":
        if not args.run:
            show({"category": e.category, "test": e.test, "metrics": list(e.metrics)} for e in default_evaluations())
            return 0
        found = evaluate(simplify_run(spark.read.parquet(args.run)), spark.read.parquet(args.qrels))
        show(rows(found.orderBy("metric")))
        return 0
    chunks = _chunks(args) if args.command == "index" else ChunkSettings.from_environment()
    config = EngineConfig(args.data_dir, embedding_model=args.model, chunks=chunks)
    engine = Engine(spark, config)
    if args.command == "index":
        if args.file:
            result = engine.index_file(args.file, args.folder)
        else:
            result = engine.index_directory(args.folder, args.force)
        show([{"success": result.success, **result.counts}])
        show(row.asDict(recursive=True) for row in result.errors.toLocalIterator())
        return 0 if result.success else 1
    if args.command == "clear":
        if args.all:
            engine.clear()
        elif args.source_ids:
            engine.delete(args.source_ids)
        show([{"cleared": "all" if args.all else list(args.source_ids)}])
    elif args.command == "query":
        settings = SearchSettings(
            k=args.k, prompt_id=args.prompt, rerank=args.rerank, hybrid=args.hybrid
        )
        show(rows(engine.answer(engine.questions(args.questions), **settings.__dict__).orderBy("qid")))
    elif args.command == "summarize":
        show(rows(engine.summaries(args.k)))
    elif args.command == "list":
        show(row.asDict() for row in engine.listing().toLocalIterator())
    elif args.command == "repl":
        for line in sys.stdin:
            if line.strip():
                show([engine.ask(line.strip())])
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    from docquarry.session import build_session

    args = parser().parse_args(argv)
    try:
        return run(args, build_session("docquarry-cli"))
    except QuarryError as error:
        emit([{"error": str(error)}], args.json, sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
