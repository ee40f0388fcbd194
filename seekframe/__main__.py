"""Command line: python -m seekframe --home DIR COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from seekframe.engine import Engine, NotReady
from seekframe.session import session


def _parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="seekframe", description="Index and search code projects.")
    out.add_argument("--home", default=".seekframe", help="where indexes are kept")
    out.add_argument("--json", action="store_true", help="print rows as JSON lines")
    sub = out.add_subparsers(dest="command", required=True)
    add = sub.add_parser("add", help="register a folder")
    add.add_argument("name")
    add.add_argument("root")
    sub.add_parser("list", help="projects and their status")
    run = sub.add_parser("index", help="bring an index up to date")
    run.add_argument("project")
    run.add_argument("--rebuild", action="store_true")
    for name, told in (("search", "rank files and symbols"), ("symbols", "find symbols"), ("usages", "find relations")):
        ask = sub.add_parser(name, help=told)
        ask.add_argument("project")
        ask.add_argument("query")
        ask.add_argument("--limit", type=int)
        if name == "search":
            ask.add_argument("--explain", action="store_true", help="show what each signal adds")
            ask.add_argument("--git", action="store_true", help="let recent commits count")
    many = sub.add_parser("search-federated", help="rank files of several projects")
    many.add_argument("projects", help="names or ids with commas between them")
    many.add_argument("query")
    many.add_argument("--limit", type=int)
    context = sub.add_parser("context", help="fragments within a token budget")
    context.add_argument("project")
    context.add_argument("query")
    context.add_argument("--budget", type=int)
    context.add_argument("--git", action="store_true", help="add what the repository's history says")
    fair = sub.add_parser("context-federated", help="one token budget for several projects")
    fair.add_argument("projects", help="names or ids with commas between them")
    fair.add_argument("query")
    fair.add_argument("--budget", type=int)
    fair.add_argument("--shares", action="store_true", help="show what each project got instead")
    for name, told in (("import-json", "take symbols and relations from a JSON snapshot"), ("import-index", "take symbols and relations from a protobuf index")):
        take = sub.add_parser(name, help=told)
        take.add_argument("project")
        take.add_argument("file")
        take.add_argument("provider")
    sub.add_parser("health", help="whether projects failed or all are ready")
    sub.add_parser("files", help="a project's files").add_argument("project")
    sub.add_parser("inspect", help="counts of an index").add_argument("project")
    return out


def _show(result: DataFrame | dict | str, as_json: bool) -> None:
    if isinstance(result, DataFrame):
        for row in result.toLocalIterator():
            print(json.dumps(row.asDict(True), default=str) if as_json else "\t".join(str(x) for x in row))
    else:
        print(json.dumps(result) if as_json else result)


def _search(engine: Engine, args: argparse.Namespace) -> DataFrame:
    changes = engine.git(args.project)[0] if args.git else None
    found = engine.search(args.project, {1: args.query}, args.limit, changes).orderBy("rank")
    return found if args.explain else found.drop("explanation")


def main(argv: list[str] | None = None) -> int:
    """0: done, 1: the request was wrong or the project isn't ready."""
    args = _parser().parse_args(argv)
    engine = Engine(session("seekframe"), args.home)
    try:
        run = {
            "add": lambda: engine.add(args.name, args.root),
            "list": lambda: engine.projects().orderBy("name"),
            "index": lambda: engine.index(args.project, args.rebuild),
            "search": lambda: _search(engine, args),
            "search-federated": lambda: engine.search_federated(args.projects.split(","), {1: args.query}, args.limit).orderBy("place"),
            "symbols": lambda: engine.find_symbols(args.project, args.query, args.limit).orderBy("place"),
            "usages": lambda: engine.find_usages(args.project, args.query, args.limit),
            "context": lambda: engine.context(args.project, args.query, args.budget, (), *(engine.git(args.project) if args.git else ())).orderBy("part", "place"),
            "context-federated": lambda: engine.context_federated(args.projects.split(","), args.query, args.budget)[args.shares],
            "import-json": lambda: {"generation": engine.import_json(args.project, args.file, args.provider)},
            "import-index": lambda: {"generation": engine.import_index(args.project, args.file, args.provider)},
            "health": engine.health,
            "files": lambda: engine.files(args.project).drop("content"),
            "inspect": lambda: engine.inspect(args.project),
        }[args.command]
        _show(run(), args.json)
    except (ValueError, NotReady, AnalysisException) as e:
        print(str(e).splitlines()[0], file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
