"""Commands: extract, export, repo, diff.

``python -m edictum.cli extract program.cbl -I includes``
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable

from edictum.operators import export
from edictum.plans import canon
from edictum.sources.rule_reader import Extraction, extract
from edictum.sources.program_text import INCLUDES, read_source


def _read(path: str, folders: list[str]) -> Extraction:
    library = {}
    for folder in [*folders, os.path.dirname(os.path.abspath(path))]:
        for name in sorted(os.listdir(folder)):
            stem, ext = os.path.splitext(name)
            if ext.lower() in INCLUDES:
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    library.setdefault(stem.upper(), (name, f.read()))
    with open(path, "rb") as f:
        return extract(read_source(os.path.basename(path), f.read(), library))


def _write(text: str, out: str | None) -> None:
    if out:
        with open(out, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)


def _extract(a: argparse.Namespace) -> None:
    e = _read(a.program, a.include)
    _write(export.to_json(e.rules), a.out)
    for p in e.program.problems:
        print(p, file=sys.stderr)


def _export(a: argparse.Namespace) -> None:
    rules = _read(a.program, a.include).rules
    skipped: list[str] = []
    if a.format in ("pmml", "dmn"):
        text, skipped = (export.to_pmml if a.format == "pmml" else export.to_dmn)(rules)
    else:
        text = export.to_json(rules) if a.format == "json" else json.dumps(export.to_tree_json(rules), indent=2, default=str)
    _write(text, a.out)
    for s in skipped:
        print(f"left out {s}", file=sys.stderr)


def _repo(a: argparse.Namespace) -> None:
    from pyspark.sql import SparkSession

    from edictum.api import Workbench
    from edictum.operators import graph

    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    g, found = Workbench(spark, "unused").repository(a.folder)
    out = {n: [r.asDict() for r in df.collect()] for n, df in (("nodes", g.nodes), ("edges", g.edges), ("findings", g.findings))}
    if a.impact:
        kind, _, name = a.impact.partition(":")
        out["impact"] = {n: [r.asDict() for r in df.collect()] for n, df in graph.impact(g, found, kind, name).items()}
    _write(json.dumps(out, indent=2, default=str), a.out)


def _diff(a: argparse.Namespace) -> None:
    old, new = (_read(p, a.include).rules for p in (a.old, a.new))
    left = {r.rule_id: r for r in new}
    lines = []
    for r in old:
        same = next((n for n in left.values() if canon.rule_key(n) == canon.rule_key(r)), None)
        if same:
            del left[same.rule_id]
        else:
            lines.append(f"- {r.rule_id}: {export.describe_condition(r.conditions)}")
    lines += [f"+ {r.rule_id}: {export.describe_condition(r.conditions)}" for r in left.values()]
    _write("\n".join(lines) or "no rule changed", a.out)


def main(argv: list[str] | None = None) -> int:
    """Run a command."""
    parser = argparse.ArgumentParser(prog="edictum")
    sub = parser.add_subparsers(required=True)

    def command(name: str, run: Callable[[argparse.Namespace], None], *args: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for x in args:
            p.add_argument(x)
        p.add_argument("-I", "--include", action="append", default=[])
        p.add_argument("-o", "--out")
        p.set_defaults(run=run)
        return p

    command("extract", _extract, "program")
    command("export", _export, "program").add_argument("--format", choices=("json", "tree", "pmml", "dmn"), default="dmn")
    command("repo", _repo, "folder").add_argument("--impact")
    command("diff", _diff, "old", "new")
    a = parser.parse_args(argv)
    a.run(a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
