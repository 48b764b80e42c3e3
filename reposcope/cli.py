"""Command line: python -m reposcope.cli status|tool-surface|index|context|grep|feedback|export|import|instruction"""

from __future__ import annotations

import argparse
import json
import math
import sys
from collections.abc import Sequence

from reposcope.config import Config, load


def _number(least: float, strict: bool):
    def parse(text: str) -> float:
        try:
            value = float(text)
        except ValueError:
            value = math.nan
        if not math.isfinite(value) or value < least or strict and value == least:
            raise argparse.ArgumentTypeError(f"must be a {'positive' if strict else 'non-negative'} number")
        return value

    return parse


def _text(value: str) -> str:
    if value.startswith("--"):
        raise argparse.ArgumentTypeError("requires text")
    return value


def context_parser(parser: argparse.ArgumentParser | None = None) -> argparse.ArgumentParser:
    """Arguments of ``context``: seeds or a question, a budget, weights."""
    parser = parser or argparse.ArgumentParser(prog="context")
    parser.add_argument("seeds", nargs="*")
    parser.add_argument("--question", type=_text)
    parser.add_argument("--root", type=_text)
    parser.add_argument("--budget", type=_number(0, True), default=4000)
    parser.add_argument("--structural-weight", type=_number(0, False))
    parser.add_argument("--cochange-weight", type=_number(0, False))
    parser.add_argument("--explain", action="store_true")
    parser.add_argument("--json", action="store_true")
    return parser


def parse_context(argv: Sequence[str]) -> argparse.Namespace:
    """Parsed arguments; what is wrong with them ends the program with a message, as does asking nothing."""
    parser = context_parser()
    found = parser.parse_intermixed_args(list(argv))
    if not found.seeds and found.question is None:
        parser.error("give at least one seed, or --question <text>")
    return found


def instruction(config: Config, symbols: int) -> str:
    """What an agent is told of the tools: nothing, one line, or one line with the number of calls that a
    repository of this size is worth."""
    if config.instruction_style == "off":
        return ""
    line = f"Tools: {', '.join(config.tools())}. Ask codebase_query first; prechange_impact before an edit, verify_change after it."
    if config.instruction_style == "short":
        return line
    calls = next((n for least, n in ((20_000, 4), (5_000, 3), (500, 2)) if symbols >= least), 1)
    return f"{line} About {symbols:,} symbols are indexed: {calls} call{'s' if calls > 1 else ''} should do."


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="reposcope")
    parser.add_argument("--config")
    parser.add_argument("--snapshots", help="where indexes are taken up from and saved to")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("tool-surface")
    for name in ("status", "index", "instruction"):
        commands.add_parser(name).add_argument("root")
    context_parser(commands.add_parser("context"))
    grep = commands.add_parser("grep")
    grep.add_argument("root")
    grep.add_argument("patterns", nargs="+")
    grep.add_argument("--mode", default="content", choices=("content", "files_with_matches", "count"))
    feedback = commands.add_parser("feedback")
    feedback.add_argument("answers")
    feedback.add_argument("outcomes")
    for name in ("export", "import"):
        own = commands.add_parser(name)
        own.add_argument("root")
        own.add_argument("path")
    return parser


def main(argv: Sequence[str] | None = None) -> int:
    arguments = _parser().parse_args(argv)
    config = load(arguments.config) if arguments.config else Config()
    if arguments.command == "tool-surface":
        print("\n".join(config.tools()))
        return 0
    from pyspark.sql import SparkSession

    from reposcope import tools
    from reposcope.operators import feedback, metrics
    from reposcope.sources import repository

    spark = SparkSession.builder.appName("reposcope").getOrCreate()
    if arguments.command == "feedback":
        rows = feedback.surfaces(spark.read.parquet(arguments.answers), spark.read.parquet(arguments.outcomes))
        print("\n".join(r["report"] for r in metrics.surface_report(rows).orderBy("surface").collect()))
        return 0
    if arguments.command == "import":
        found = repository.import_snapshot(spark, arguments.path)
        if found is None:
            print("not a snapshot of this version", file=sys.stderr)
            return 1
        repository.save_snapshot(found, arguments.root)
        return 0
    service = tools.Service(spark, config, snapshots=arguments.snapshots)
    root = arguments.root or "."
    workspace = service.workspace(root)
    if arguments.command == "context":
        if not arguments.seeds and arguments.question is None:
            print("give at least one seed, or --question <text>", file=sys.stderr)
            return 2
        weights = {k: v for k, v in (("structural_weight", arguments.structural_weight), ("cochange_weight", arguments.cochange_weight)) if v is not None}
        answer = tools.code_graph_context(workspace, arguments.seeds, arguments.question, int(arguments.budget), arguments.explain, **weights)
        print(answer if arguments.json else "\n".join(f"{s['id']} {s['file']}:{s['lines'][0]}" for s in json.loads(answer)["symbols"]))
    elif arguments.command == "grep":
        print(tools.instant_grep(workspace, arguments.patterns, arguments.mode))
    elif arguments.command == "export":
        repository.export_snapshot(workspace.relations, arguments.path)
    elif arguments.command == "instruction":
        print(instruction(config, workspace.index.size()))
    else:
        print(json.dumps(service.status(), indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
