"""The graph between programs, includes, jobs, steps and data sets; and what a change reaches.

Nodes, edges and findings are joins and anti-joins over the extracted tables. Reachability is
an iterative join that keeps the least depth of each node, so cycles end it like anything else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edictum.workspace import discard, materialize, materialize_counted


@dataclass
class Graph:
    """Nodes (id, kind, label), edges (type, src, dst, via, file, line, dynamic), findings (kind, subject, detail)."""

    nodes: DataFrame
    edges: DataFrame
    findings: DataFrame

    def summary(self) -> DataFrame:
        """How many nodes of each kind."""
        return self.nodes.groupBy("kind").count()


def _id(kind: str, name: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(name) if isinstance(name, str) else name)


def _edge(df: DataFrame, kind: Column | str, src: Column, dst: Column, **more: Column) -> DataFrame:
    empty = {"via": F.lit(None).cast("string"), "file": F.lit(None).cast("string"), "line": F.lit(None).cast("int"), "dynamic": F.lit(False)}
    return df.select((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), src.alias("src"), dst.alias("dst"), *(c.alias(n) for n, c in (empty | more).items()))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def build_graph(programs: DataFrame, steps: DataFrame, includes: DataFrame) -> Graph:
    """``programs``: as extracted; ``steps``: of jobs; ``includes``: with a column stem."""
    known = programs.select(F.col("program").alias("known")).distinct()
    calls = programs.select("program", "file", F.explode("calls").alias("c")).select("program", "file", "c.*")
    called = calls.filter("resolved is not null").join(known, F.col("resolved") == F.col("known"), "left")
    included = programs.select("program", "file", F.explode("copybooks").alias("stem"))
    runs = steps.filter("pgm is not null and not utility").join(known, F.col("pgm") == F.col("known"), "left")
    builds = steps.select("job", "step", F.explode("members").alias("member")).join(known, F.col("member") == F.col("known"), "left_semi")
    files = programs.select(F.col("program").alias("pgm"), F.explode("files").alias("f")).select("pgm", "f.*")
    uses = runs.filter("known is not null").join(files, "pgm").withColumn("dd", F.get(F.filter("dds", lambda d: d["name"] == F.col("assign")), F.lit(0)))
    sets = uses.filter("dd is not null").withColumn("dsn", F.explode("dd.dsn")).withColumn("mode", F.explode(F.when(F.size("modes") > 0, F.col("modes")).otherwise(F.array(F.when(F.col("dd.disp").isin("NEW", "MOD"), F.lit("OUTPUT")).otherwise(F.lit("INPUT"))))))
    step = _id("step", F.concat_ws(".", "job", "step"))
    access = F.when(F.col("mode") == "INPUT", "READS").when(F.col("mode").isin("OUTPUT", "EXTEND"), "WRITES").otherwise("UPDATES")
    edges = _union([
        _edge(called, "CALLS", _id("program", "program"), _id("program", "resolved"), file=F.col("file"), line=F.col("line"), dynamic=F.col("dynamic")),
        _edge(included, "INCLUDES", _id("program", "program"), _id("copybook", "stem"), file=F.col("file")),
        _edge(steps.filter("step is not null"), "HAS_STEP", _id("job", "job"), step),
        _edge(builds, "BUILDS", step, _id("program", "member")),
        _edge(runs, "RUNS", step, _id("program", "pgm")),
        _edge(sets, access, _id("program", "pgm"), _id("dataset", "dsn"), via=F.concat(F.concat_ws(".", "job", "step"), F.lit(" DD "), F.col("dd.name")), file=F.col("select")),
    ])
    first = Window.partitionBy("type", "src", "dst", "via", "file").orderBy(F.col("line").asc_nulls_last(), "dynamic")
    edges = edges.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    node = lambda df, kind, name: df.select(_id(kind, name).alias("id"), F.lit(kind if kind != "external" else "external").alias("kind"), (F.col(name) if isinstance(name, str) else name).alias("label"))
    outside = called.filter("known is null").select(F.col("resolved").alias("name")).unionByName(runs.filter("known is null").select(F.col("pgm").alias("name")))
    nodes = _union([
        node(programs, "program", "program"),
        outside.select(_id("program", "name").alias("id"), F.lit("external").alias("kind"), F.col("name").alias("label")),
        node(included, "copybook", "stem"), node(includes, "copybook", "stem"), node(steps, "job", "job"),
        node(steps.filter("step is not null"), "step", F.concat_ws(".", "job", "step")), node(sets, "dataset", "dsn"),
    ]).distinct()
    finding = lambda df, kind, subject, detail: df.select(F.lit(kind).alias("kind"), F.col(subject).alias("subject"), detail.alias("detail"))
    twice = programs.groupBy("program").count().filter("count > 1")
    findings = _union([
        finding(twice, "duplicate_program_id", "program", F.format_string("%d sources define it", "count")),
        finding(calls.filter("resolved is null"), "unresolved_call", "program", F.format_string("CALL %s (line %d): the target is in a field without a value", "target", "line")),
        finding(called.filter("known is null"), "external_call", "program", F.format_string("CALL %s (line %d): not in the repository", "resolved", "line")),
        finding(programs.filter("error is not null"), "parse_error", "program", F.col("error")),
        finding(includes.select("stem").distinct().join(included, "stem", "left_anti"), "unused_copybook", "stem", F.lit("no program includes it")),
        finding(runs.filter("known is null"), "missing_program", "job", F.format_string("step %s runs %s, which is not in the repository", "step", "pgm")),
        finding(uses.filter("dd is null"), "missing_dd", "job", F.format_string("%s assigns %s to %s, but step %s has no such DD", "pgm", "select", "assign", "step")),
    ]).distinct()
    return Graph(nodes, edges, findings)


def closure(edges: DataFrame, start: DataFrame, max_depth: int = 1000) -> DataFrame:
    """``node``, ``depth`` of all nodes from which a start node is reached along src to dst; the start has depth 0.

    One join a level, over the frontier only; each level is written once, and its job counts it.
    ``edges`` has src and dst, ``start`` has node. Raises RuntimeError if nodes are left after
    ``max_depth`` levels, rather than return a part.
    """
    back = materialize(edges.select("src", "dst").distinct(), "edges")
    frontier, n = materialize_counted(start.select("node").distinct().withColumn("depth", F.lit(0)), "level")
    seen = frontier
    for depth in range(1, max_depth + 2):
        reached = frontier.join(back, F.col("node") == F.col("dst")).select(F.col("src").alias("node")).distinct()
        frontier, n = materialize_counted(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "level")
        if not n:
            discard(back)
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"there are nodes beyond depth {max_depth}")


def impact(graph: Graph, programs: DataFrame, kind: str, name: str) -> dict[str, DataFrame]:
    """What a change to a field, copybook, program or dataset reaches: ``programs`` (with depth), ``rules``, ``steps``, ``jobs``."""
    name = name.strip().upper()
    rules = programs.select("program", "file", F.explode("uses").alias("u")).select("program", "file", "u.*")
    how = F.lit(None).cast("string")
    if kind == "field":
        reads, writes = F.array_contains("reads", name), F.array_contains("writes", name)
        how = F.concat_ws(",", F.when(reads, "reads"), F.when(writes, "writes"))
        rules = rules.filter(reads | writes)
        start = rules.select(_id("program", "program").alias("node"))
    elif kind == "copybook":
        direct = programs.filter(F.array_contains("copybooks", name))
        rules = rules.join(direct.select("program", "file"), ["program", "file"], "left_semi")
        how = F.lit("included")
        start = direct.select(_id("program", "program").alias("node"))
    elif kind == "program":
        rules = rules.filter(F.lit(False))
        start = programs.sparkSession.range(1).select(F.lit(f"program:{name}").alias("node"))
    elif kind == "dataset":
        rules = rules.filter(F.lit(False))
        start = graph.edges.filter(F.col("type").isin("READS", "WRITES", "UPDATES") & (F.col("dst") == f"dataset:{name}")).select(F.col("src").alias("node"))
    else:
        raise ValueError(f"impact of {kind!r}: field, copybook, program or dataset")
    reached = closure(graph.edges.filter("type = 'CALLS'"), start)
    steps = graph.edges.filter("type = 'RUNS'").join(reached.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.substring_index("src", ":", -1).alias("step")).distinct()
    return {"programs": reached.select(F.substring_index("node", ":", -1).alias("program"), "depth"), "rules": rules.select("program", "file", "rule_id", "paragraph", how.alias("how")), "steps": steps, "jobs": steps.select(F.substring_index("step", ".", 1).alias("job")).distinct()}
