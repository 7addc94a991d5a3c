"""A workbench over the operators: the verbs of a rule service as methods that return DataFrames or documents."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edictum.functions.glossary import Glossary
from edictum.operators import algebra, boxes, export, export_sink, graph, index, search, store, verify
from edictum.plans.compile import score
from edictum.plans.evaluate import decide
from edictum.plans.ir import Rule, inputs, rule_from
from edictum.sources import programs
from edictum.sources.rule_reader import Extraction, extract
from edictum.sources.program_text import INCLUDES, read_source

Progress = Callable[[str, int, int], None]


def trace_lines(lines: DataFrame, start: int, end: int, context: int = 3) -> DataFrame:
    """Source lines (line, text) around a rule, with ``in_rule``."""
    return lines.filter(F.col("line").between(start - context, end + context)).select("line", "text", F.col("line").between(start, end).alias("in_rule")).orderBy("line")


def sort_rules(rules: Iterable[Rule]) -> list[Rule]:
    """By program, place and id: the order in which they run."""
    return sorted(rules, key=lambda r: (r.trace.program, r.trace.line_start, r.rule_id))


class Workbench:
    """Programs, rules and decisions in a store."""

    def __init__(self, spark: SparkSession, path: str, approvals: int = 1, glossary: Glossary | None = None):
        self.spark, self.store, self.glossary = spark, store.RuleStore(spark, path, approvals), glossary or Glossary()

    # programs
    def upload_program(self, program_id: str, file: str, files: dict[str, str]) -> str:
        """Keep the sources of a program: its file and its includes."""
        if file not in files or sum(map(len, files.values())) > 1_000_000:
            raise store.StoreError("INVALID_REQUEST", "the program's file must be there, and all at most 1,000,000 characters")
        self.store.add_program(program_id, file.rpartition(".")[0] or file, file, files)
        return program_id

    def program_source(self, program_id: str) -> dict[str, str]:
        """A program's files."""
        row = self.store.table("programs").filter(F.col("id") == program_id).orderBy(F.desc("created_at")).first()
        if row is None:
            raise store.StoreError("PROGRAM_NOT_FOUND", f"no program {program_id}")
        return {"__file__": row["program_file"]} | json.loads(row["files"])

    def extraction(self, program_id: str) -> Extraction:
        """What is read from a program."""
        files = self.program_source(program_id)
        file = files.pop("__file__")
        library = {n.rpartition("/")[2].partition(".")[0].upper(): (n, t) for n, t in files.items() if n != file}
        return extract(read_source(file, files[file], library), self.glossary.names())

    def extract_program(self, program_id: str, job: str | None = None, progress: Progress | None = None) -> dict[str, int]:
        """Extract, check and save a program's rules; stages go to the job's row and to ``progress``."""

        def tell(stage: str, done: int, total: int) -> None:
            if progress:
                progress(stage, done, total)
            if job:
                self.store.update_job(job, program_id=program_id, state="running", stage=stage, slices_done=done, slices_total=total)

        try:
            tell("extract", 0, 0)
            e = self.extraction(program_id)
            tell("verify", 0, len(e.rules))
            checked = [r.with_(unsupported=(*r.unsupported, "condition can never hold")) if verify.satisfiable(r) is False else r for r in e.rules]
            tell("save", len(checked), len(checked))
            out = self.store.save_rules(program_id, checked)
        except Exception as x:
            if job:
                self.store.update_job(job, program_id=program_id, state="failed", error=str(x)[:300])
            raise
        if job:
            self.store.update_job(job, state="done")
        return out

    # rules
    def rules(self, statuses: Iterable[str] | None = None, program: str | None = None) -> list[Rule]:
        """Current rules as objects, in the order in which they run."""
        df = self.store.latest_rules(program=program)
        df = df.filter(F.col("status").isin(list(statuses))) if statuses else df
        return sort_rules(rule_from(json.loads(r["document"]) | {"status": r["status"], "version": r["version"]}) for r in df.collect())

    def list_rules(self, question: str | None = None, page: int = 1, page_size: int = 50, user: str = "", groups: Iterable[str] = (), grants: list[dict] | None = None, **filters: Any) -> DataFrame:
        """A page of the rules that match filters and question and that the user may see."""
        rows = store.visible(self.store.latest_rules(**filters), user, groups, grants, "program_id", "name", "program_file")
        size = max(1, min(page_size, 200))
        return search.search(search.rule_rows(rows), question, size, (page - 1) * size)

    def write_index(self, path: str) -> index.Index:
        """An inverted index of all current rules, for stores in which a search shouldn't read every rule."""
        return index.Index.write(search.rule_rows(self.store.latest_rules()), path)

    def rule_trace(self, rule_id: str, context: int = 3) -> DataFrame:
        """The source around a rule."""
        rule, row = self.store.rule(rule_id)
        text = self.program_source(row["program_id"]).get(rule.trace.file, "")
        lines = self.spark.createDataFrame(list(enumerate(text.splitlines(), 1)), "line int, text string")
        return trace_lines(lines, rule.trace.line_start, rule.trace.line_end, context)

    def conflicts(self, df: DataFrame | None = None, bindings: Mapping[str, str | Column] | None = None) -> list[dict[str, Any]]:
        """Duplicates and conflicting writes among all current rules."""
        return algebra.conflicts(self.spark, self.rules(), df, dict(bindings) if bindings else None)

    def conflicts_table(self, numeric: Iterable[str] = ()) -> DataFrame:
        """Conflicting writes among all current rules as a table, without the driver; see boxes.conflicts()."""
        return boxes.each(boxes.conflicts_alike(self.store.latest_rules(), numeric))

    def export_files(self, path: str, kind: str) -> DataFrame:
        """A file of current rules a program, as their documents are in the store, written in tasks; the manifest."""
        rules = self.store.latest_rules().select(F.col("program_id").alias("rule_set"), F.regexp_extract("rule_id", r"(\d+)$", 1).try_cast("long").alias("seq"), "document")
        return export_sink.write_files(rules, path, kind)

    def export(self, kind: str, program: str | None = None) -> str:
        """Rules as json, tree, pmml or dmn."""
        rules = self.rules(program=program)
        return {"json": lambda: export.to_json(rules), "tree": lambda: json.dumps(export.to_tree_json(rules), default=str), "pmml": lambda: export.to_pmml(rules)[0], "dmn": lambda: export.to_dmn(rules)[0]}[kind]()

    # decisions
    def rule_set(self, program: str) -> list[Rule]:
        """The approved rules of a program."""
        rules = self.rules(("approved",), program)
        if not rules:
            raise store.StoreError("RULE_SET_NOT_FOUND", f"no approved rules of {program}")
        return rules

    def score(self, program: str, df: DataFrame, bindings: Mapping[str, str | Column] | None = None, defaults: Mapping[str, Any] | None = None) -> DataFrame:
        """Decisions of a program's approved rules over a table."""
        return score(df, self.rule_set(program), bindings, defaults)

    def score_one(self, program: str, values: Mapping[str, Any], defaults: Mapping[str, Any] | None = None) -> dict[str, Any]:
        """One decision, on the driver; values by business name."""
        rules = self.rule_set(program)
        names = {k: f["source_name"] for k, f in inputs(rules).items()}
        decision, fired = decide(rules, {names.get(k, k.upper().replace("_", "-")): v for k, v in values.items()}, defaults)
        return {"decision": decision, "fired_rules": fired}

    def rule_set_inputs(self, program: str) -> dict[str, dict[str, Any]]:
        """What a program's rules ask for."""
        return inputs(self.rule_set(program))

    def explain(self, program: str, output: str, n: int = 1500) -> list[tuple[str, float]]:
        """How much each input decides an output."""
        return verify.influence(self.rule_set(program), output, n)

    def drift(self, old_program: str, new_program: str) -> DataFrame:
        """What became of each rule between two uploaded versions."""
        a, b = (algebra.rule_keys(self.spark, self.extraction(p).rules) for p in (old_program, new_program))
        return algebra.drift(a, b)

    # repository
    def repository(self, folder: str) -> tuple[graph.Graph, DataFrame]:
        """The graph of all programs and jobs below a folder, and the extracted programs."""
        found = programs.extract_folder(self.spark, folder, self.glossary.names())
        return graph.build_graph(found, programs.read_jobs(self.spark, folder), programs.read_files(self.spark, folder, INCLUDES)), found

    def newest_backups(self, backups: DataFrame, keep: int) -> DataFrame:
        """Of backups (path, created_at) those to delete: all but the newest ``keep``."""
        order = Window.partitionBy(F.lit(1)).orderBy(F.desc("created_at"), "path")
        return backups.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") > keep).drop("__n")


