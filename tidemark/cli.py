"""The command line: which of these pages can this change alter?

``python -m tidemark --root app --diff change.diff --anchor src/pages/Shop.tsx``

Ends with 0 if an anchor is affected, 1 if none is, 2 if there is no answer; with ``--json``, where
every anchor is answered for itself, with 0 as soon as there is an answer.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import report
from tidemark.plans.analyse import Change, analyse
from tidemark.plans.symbols import analyse_symbols
from tidemark.shared import cut
from tidemark.sources.config import CONFIG, ConfigError
from tidemark.sources.earlier import UnknownRevision, config_texts, git_files
from tidemark.sources.tree import read_tree


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description="Which anchors can a change reach?")
    p.add_argument("-a", "--anchor", action="extend", nargs="+", required=True, help="files to answer for")
    p.add_argument("-c", "--changed", action="extend", nargs="+", default=[], help="changed files, each of them as a whole")
    p.add_argument("-d", "--diff", help="a unified diff; - for standard input")
    p.add_argument("-b", "--base", help="a git revision to compare changed files with")
    p.add_argument("-r", "--root", default=".", help="the tree's folder")
    p.add_argument("-o", "--only", choices=("downstream", "upstream"), help="one direction only")
    p.add_argument("-g", "--granularity", choices=("file", "symbol"), default="file")
    p.add_argument("--include-types", action="store_true", help="changes of types count too")
    p.add_argument("--entry", action="extend", nargs="+", default=[], help="modules that the build starts from")
    p.add_argument("--config", default=CONFIG, help="name of the configuration files")
    shown = p.add_mutually_exclusive_group()
    shown.add_argument("-e", "--explain", action="store_true", help="show the way from the anchor to the change")
    shown.add_argument("--json", action="store_true", help="every anchor for itself, as JSON")
    p.add_argument("--unresolved", action="store_true", help="list what was asked for and not found")
    return p


def read_diff(name: str | None, stdin: TextIO) -> str:
    """The text of a diff: from a file, or from standard input if it is called ``-``."""
    if name is None:
        return ""
    if name == "-":
        return stdin.read()
    with open(name, encoding="utf-8", errors="surrogateescape", newline="") as f:
        return f.read()


def earlier_versions(spark: SparkSession, change: Change, root: str, revision: str) -> DataFrame:
    """(path, content) of the files that the change names, as the revision has them."""
    paths = {e.path for e in change.entries} | set(change.named) | change.gone
    return cut(git_files(spark.createDataFrame([(p,) for p in sorted(paths)], "path string"), root, revision).where("content is not null"))


def run(argv: Sequence[str], spark: SparkSession, out: Callable[[str], None] = print, stdin: TextIO = sys.stdin) -> int:
    """Answer one command line; what there is to say goes to ``out``, line by line."""
    args = parser().parse_args(argv)
    if args.json and args.unresolved:
        parser().error("--json tells of what was not found itself")
    try:
        change = Change.read(read_diff(args.diff, stdin), args.changed)
        before = earlier_versions(spark, change, args.root, args.base) if args.base else None
        more = {"earlier": config_texts(before) if before is not None else None, "before": before, "only": args.only, "config_name": args.config, "include_types": args.include_types}
        files = read_tree(spark, args.root)
        if args.granularity == "symbol":
            answers = analyse_symbols(files, change, args.anchor, entries=args.entry, **more)
        else:
            answers = analyse(files, change, args.anchor, **more)
        answers = cut(answers)
    except (ConfigError, UnknownRevision, OSError, ValueError) as e:
        out(f"no answer: {e}")
        return report.NO_ANSWER
    if args.json:
        out(report.render_json(answers, args.anchor, args.granularity))
        return report.AFFECTED
    affected, first = report.verdict_of_set(answers)
    shown = answers.where(answers["anchor"] == (first if affected else args.anchor[0]))
    for row in report.verdict_lines(shown, args.granularity, args.explain).orderBy("n").collect():
        out(row["line"])
    if args.unresolved:
        for line in report.unresolved_lines(answers):
            out(line)
    return report.exit_code(answers)


def main() -> int:
    spark = SparkSession.builder.appName("tidemark").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        return run(sys.argv[1:], spark)
    finally:
        spark.stop()
