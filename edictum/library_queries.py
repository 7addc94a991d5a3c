"""Queries that run the library's own stores, graphs, readers, exports, solver and interpreter over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edictum.functions import pic, text
from edictum.functions.glossary import Glossary, rename, wording_issues
from edictum.operators import algebra, codec, export, graph, interpret, metrics, store, verify
from edictum.plans import canon, solver
from edictum.plans.ir import Action, Rule, Trace, leaf
from edictum.queries import _query, _t
from edictum.sources import program_text, programs, rule_reader
from edictum.workspace import fresh_path, spread


def _repository(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers as programs, orders as steps, nations as includes: tables as extraction gives them."""
    key = F.col("s_suppkey")
    called = F.when(key % 10 != 0, F.concat(F.lit("P"), (key * 2).cast("string")))
    p = _t(spark, sf_dir, "supplier").select(
        F.concat(F.lit("P"), key.cast("string")).alias("program"), F.concat(F.lit("p"), key.cast("string"), F.lit(".cbl")).alias("file"), F.lit(None).cast("string").alias("error"),
        F.array(F.struct(F.lit("WS-X").alias("target"), F.lit(True).alias("dynamic"), called.alias("resolved"), key.cast("int").alias("line"))).alias("calls"),
        F.array(F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))).alias("copybooks"),
        F.array(F.struct(F.lit("F1").alias("select"), F.lit("DD1").alias("assign"), F.array(F.when(F.col("s_acctbal") > 0, "INPUT").otherwise("EXTEND")).alias("modes"))).alias("files"),
        F.array(F.struct(F.concat(F.lit("P"), key.cast("string"), F.lit("-R001")).alias("rule_id"), F.lit("MAIN").alias("paragraph"), F.array(F.lit("BAL")).alias("reads"), F.array(F.lit("FLAG")).alias("writes"))).alias("uses"),
    )
    p = p.unionByName(p.filter(F.array_contains("copybooks", "N0")).withColumn("file", F.concat(F.lit("copy-"), "file")))
    o = _t(spark, sf_dir, "orders")
    dd = lambda name: F.array(F.struct(F.lit(name).alias("name"), F.array(F.concat(F.lit("D."), F.col("o_orderpriority"))).alias("dsn"), F.lit("SHR").alias("disp")))
    s = o.select(
        F.concat(F.lit("J"), F.col("o_custkey").cast("string")).alias("job"), F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("step"), F.concat(F.lit("P"), (F.col("o_custkey") % 400).cast("string")).alias("pgm"), F.lit(False).alias("utility"),
        F.when(F.col("o_orderstatus") == "P", F.array(F.concat(F.lit("P"), (F.col("o_custkey") % 50).cast("string")))).otherwise(F.array().cast("array<string>")).alias("members"), F.when(F.col("o_orderstatus") == "F", dd("DD2")).otherwise(dd("DD1")).alias("dds"),
    )
    return p, s, _t(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("stem"))


_REPO = """with p as (select 'P' || s_suppkey as program, 'N' || s_nationkey as stem, s_suppkey as k, case when s_suppkey % 10 <> 0 then 'P' || (s_suppkey * 2) end as called, case when s_acctbal > 0 then 'READS' else 'WRITES' end as access, s_nationkey as nk from supplier),
 s as (select 'J' || o_custkey as job, 'S' || o_orderkey as step, 'P' || (o_custkey % 400) as pgm, case when o_orderstatus = 'P' then 'P' || (o_custkey % 50) end as member, o_orderstatus = 'F' as lacks, 'D.' || o_orderpriority as dsn from orders)"""


@_query(_REPO + """ select 'CALLS' as type, 'program:' || program as src, 'program:' || called as dst from p where called is not null union select 'INCLUDES', 'program:' || program, 'copybook:' || stem from p
 union select 'HAS_STEP', 'job:' || job, 'step:' || job || '.' || step from s union select 'BUILDS', 'step:' || job || '.' || step, 'program:' || member from s where member in (select program from p)
 union select 'RUNS', 'step:' || job || '.' || step, 'program:' || pgm from s union select access, 'program:' || pgm, 'dataset:' || dsn from s join p on pgm = program where not lacks""")  # fmt: skip
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges between programs, includes, jobs, steps and data sets."""
    return graph.build_graph(*_repository(spark, sf_dir)).edges.select("type", "src", "dst").distinct()


@_query(_REPO + """ select kind, count(*) as n from (select 'program' as kind, program as id from p union select 'external', called from p where called not in (select program from p) union select 'external', pgm from s where pgm not in (select program from p)
 union select 'copybook', 'N' || n_nationkey from nation union select 'job', job from s union select 'step', job || '.' || step from s union select 'dataset', dsn from s join p on pgm = program where not lacks) group by 1""")  # fmt: skip
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes of each kind."""
    return graph.build_graph(*_repository(spark, sf_dir)).summary().withColumnRenamed("count", "n")


@_query(_REPO + """ select 'duplicate_program_id' as kind, program as subject, '2 sources define it' as detail from p where nk = 0 union select 'unresolved_call', program, 'CALL WS-X (line ' || k || '): the target is in a field without a value' from p where called is null
 union select 'external_call', program, 'CALL ' || called || ' (line ' || k || '): not in the repository' from p where called not in (select program from p) union select 'unused_copybook', 'N' || n_nationkey, 'no program includes it' from nation where 'N' || n_nationkey not in (select stem from p)
 union select 'missing_program', job, 'step ' || step || ' runs ' || pgm || ', which is not in the repository' from s where pgm not in (select program from p) union select 'missing_dd', job, pgm || ' assigns F1 to DD1, but step ' || step || ' has no such DD' from s where lacks and pgm in (select program from p)""")  # fmt: skip
def graph_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is defined twice, missing or unused."""
    return graph.build_graph(*_repository(spark, sf_dir)).findings


@_query(_REPO.replace("with p", "with recursive p") + """, r(name, depth) as (select 'P8', 0 union all select p.program, depth + 1 from r join p on p.called = r.name)
 select 'program' as what, name, depth from r union all select distinct 'step', job || '.' || step, null from s join r on pgm = r.name union all select distinct 'job', job, null from s join r on pgm = r.name union all select 'rule', program || '-R001', 0 from p where stem = 'N3'""")  # fmt: skip
def graph_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change to a program reaches, and the rules that a change to an include reaches."""
    p, s, i = _repository(spark, sf_dir)
    g = graph.build_graph(p, s, i)
    by_program, by_include = graph.impact(g, p, "program", "p8"), graph.impact(g, p, "copybook", "n3")
    row = lambda df, what, name, depth: df.select(F.lit(what).alias("what"), F.col(name).alias("name"), depth.cast("int").alias("depth"))
    parts = [row(by_program["programs"], "program", "program", F.col("depth")), row(by_program["steps"], "step", "step", F.lit(None)), row(by_program["jobs"], "job", "job", F.lit(None)), row(by_include["rules"], "rule", "rule_id", F.lit(0))]
    return reduce(DataFrame.unionByName, parts)


@_query("""select 'J' || o_custkey as job, 'S' || o_orderkey as step, (1 + 2 * row_number() over (partition by o_custkey order by o_orderkey))::int as line, case when o_custkey % 3 = 0 then 'IEWL' else 'P' || (o_custkey % 7) end as pgm, o_custkey % 3 = 0 as utility,
 'PROD.D' || (o_orderkey % 10) || '(M1)' as dsn, case when o_orderstatus = 'O' then 'OLD' else 'SHR' end as disp from orders""")  # fmt: skip
def job_steps_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member of job control for each customer, with a step an order, read back into rows."""
    o = _t(spark, sf_dir, "orders")
    pgm = F.when(F.col("o_custkey") % 3 == 0, "IEWL").otherwise(F.concat(F.lit("P"), (F.col("o_custkey") % 7).cast("string")))
    lines = F.format_string("//S%d EXEC PGM=%s\n//IN1 DD DSN=&HLQ..D%d(M1),DISP=(%s,KEEP)", F.col("o_orderkey"), pgm, F.col("o_orderkey") % 10, F.when(F.col("o_orderstatus") == "O", "OLD").otherwise("SHR"))
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", lines.alias("t")))), lambda x: x["t"]), "\n")
    members = o.groupBy("o_custkey").agg(own.alias("steps")).select(F.format_string("mem:/%d", "o_custkey").alias("path"), F.format_string("j%d.jcl", "o_custkey").alias("file"), F.format_string("//J%d JOB (A),'X'\n// SET HLQ=PROD\n%s", "o_custkey", "steps").alias("content"))
    out = programs.job_steps(members).select("job", "step", "line", "pgm", "utility", F.explode("dds").alias("d"))
    return out.select("job", "step", "line", "pgm", "utility", F.col("d.dsn")[0].alias("dsn"), F.col("d.disp").alias("disp"))


def _write(spark: SparkSession, path: str, content: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(sc._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(content.encode()))
    out.close()


_MEMBER = """IDENTIFICATION DIVISION.
PROGRAM-ID. NAT{0:03d}.
DATA DIVISION.
WORKING-STORAGE SECTION.
    COPY REG{1} REPLACING ==:P:== BY ==N==.
01 FLAG PIC X.
PROCEDURE DIVISION.
P1.
*> the limit of nation {0}
    IF N-AMT > {0}
       AND N-CODE = '{2}'
        MOVE 'Y' TO FLAG
    ELSE
        MOVE 'N' TO FLAG
    END-IF
    STOP RUN.
"""


@_query("select 'NAT' || lpad(n_nationkey::varchar, 3, '0') as program, 'NAT' || lpad(n_nationkey::varchar, 3, '0') || '-R001' as rule_id, n_nationkey::varchar as threshold, left(n_name, 3) as code, 'REG' || n_regionkey as copybook, 'FLAG' as writes, true as hashed from nation")
def programs_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files with includes that replace text, a program a nation, read from a folder into rules."""
    folder = fresh_path(spark, "sources")
    nations, regions = (_t(spark, sf_dir, t).collect() for t in ("nation", "region"))
    for n in nations:
        _write(spark, f"{folder}/nat{n['n_nationkey']}.cbl", _MEMBER.format(n["n_nationkey"], n["n_regionkey"], n["n_name"][:3]))
    for r in regions:
        _write(spark, f"{folder}/inc/reg{r['r_regionkey']}.cpy", "01 :P:-REC.\n   05 :P:-AMT PIC 9(5).\n   05 :P:-CODE PIC X(3).\n")
    read = programs.extract_folder(spark, folder)
    rules = programs.rules_of(read).select("rule_id", "document")
    own = read.select("program", F.col("copybooks")[0].alias("copybook"), F.col("sha256").startswith("sha256:").alias("hashed"), F.col("uses")[0]["rule_id"].alias("rule_id"), F.col("uses")[0]["writes"][0].alias("writes"))
    tests = F.from_json(F.get_json_object("document", "$.conditions.all"), "array<struct<value:string>>")
    return own.join(rules, "rule_id").select("program", "rule_id", tests[0]["value"].alias("threshold"), tests[1]["value"].alias("code"), "copybook", "writes", "hashed")


def _nations(spark: SparkSession, sf_dir: str) -> list:
    return _t(spark, sf_dir, "nation").orderBy("n_regionkey", "n_nationkey").collect()


def _chain(spark: SparkSession, sf_dir: str) -> list[Rule]:
    """A rule a nation; those of a region are a first-match chain in a paragraph of its own."""
    out: list[Rule] = []
    before: list = []
    for i, n in enumerate(_nations(spark, sf_dir)):
        if out and out[-1].trace.paragraph != f"R{n['n_regionkey']}":
            before = []
        own = leaf("KEY", "<=", int(n["n_nationkey"]))
        tests = [*({"not": b} for b in before), own]
        out.append(Rule(f"NAT-R{n['n_nationkey']:03d}", {"all": tests} if len(tests) > 1 else own, (Action("set", "score", "SCORE", int(n["n_nationkey"])),), title=n["n_name"], trace=Trace("NAT", "nat", f"R{n['n_regionkey']}", 10 * i + 1, 10 * i + 5)))
        before.append(own)
    return out


@_query("select 'NAT:R' || n_regionkey || '#1' as block, 'NAT-R' || lpad(n_nationkey::varchar, 3, '0') as rule_id, row_number() over (partition by n_regionkey order by n_nationkey) as place from nation")
def decision_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of all nations, as the decisions that they form."""
    blocks = export.rule_blocks(_chain(spark, sf_dir))
    return spark.createDataFrame([(k, r.rule_id, i) for k, b in blocks.items() for i, r in enumerate(b, 1)], "block string, rule_id string, place long")


@_query("select 'NAT-R' || lpad(n_nationkey::varchar, 3, '0') as rule_id, n_name as title, n_nationkey::varchar as value, 'set' as action from nation")
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON export of rules, read back."""
    doc = spark.createDataFrame([(export.to_json(_chain(spark, sf_dir)),)], "d string")
    each = doc.select(F.explode(F.from_json("d", "array<struct<rule_id:string,title:string,actions:array<struct<type:string,value:string>>>>")).alias("r"))
    return each.select("r.rule_id", "r.title", F.col("r.actions")[0]["value"].alias("value"), F.col("r.actions")[0]["type"].alias("action"))


@_query("select 'NAT:R' || n_regionkey || '#1' as rule_set, count(*) as tests, count(*) as leaves, min(n_nationkey) as root from nation group by 1")
def export_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees of all decisions: a ladder with a test and a leaf a rule."""

    def walk(t: dict | None) -> tuple[int, int]:
        if t is None:
            return 0, 0
        if "leaf" in t:
            return 0, 1
        a, b = walk(t["true_branch"]), walk(t["false_branch"])
        return 1 + a[0] + b[0], a[1] + b[1]

    trees = export.to_tree_json(_chain(spark, sf_dir))
    return spark.createDataFrame([(t["rule_set"], *walk(t["tree"]), int(t["tree"]["test"]["value"])) for t in trees], "rule_set string, tests long, leaves long, root long")


@_query("select n_nationkey::varchar as value, 1::bigint as predicates, true as valid from nation")
def export_pmml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates of the PMML export, found in it by paths."""
    xml, _ = export.to_pmml(_chain(spark, sf_dir))
    doc = spark.createDataFrame([(xml, not export.validate(xml, "pmml"))], "x string, valid boolean")
    at = F.expr("""xpath(x, "//*[local-name()='SimplePredicate']/@value")""")
    return doc.select(F.explode(at).alias("value"), "valid").groupBy("value", "valid").agg(F.count(F.lit(1)).alias("predicates")).select("value", "predicates", "valid")


@_query("select n_nationkey::varchar as result, true as valid from nation")
def export_dmn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the DMN export's tables, found in it by paths."""
    xml, _ = export.to_dmn(_chain(spark, sf_dir))
    doc = spark.createDataFrame([(xml, not export.validate(xml, "dmn"))], "x string, valid boolean")
    return doc.select(F.explode(F.expr("""xpath(x, "//*[local-name()='outputEntry']/*[local-name()='text']/text()")""")).alias("result"), "valid")


@_query("""select n_nationkey::bigint as k, '<= ' || n_nationkey as below, '[' || n_nationkey || '..' || (n_nationkey + 5) || ')' as span, 'not("' || n_name || '")' as other, 'n_' || n_nationkey as name,
 'key <= ' || n_nationkey || ' and (name is ''' || n_name || ''' or not key > 3)' as said, 'score := ' || n_nationkey as does, 2::bigint as ways from nation""")  # fmt: skip
def rule_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions and actions as text and as unary tests, and how many ways a condition has to hold."""
    rows = []
    for n in _nations(spark, sf_dir):
        k, name = int(n["n_nationkey"]), n["n_name"]
        c = {"all": [leaf("KEY", "<=", k), {"any": [leaf("NAME", "==", name), {"not": leaf("KEY", ">", 3)}]}]}
        span = export.unary_test([leaf("K", ">=", k), leaf("K", "<", k + 5)], {"K": "k"})
        rows.append((k, export.unary_test([leaf("K", "<=", k)], {"K": "k"}), span, export.unary_test([leaf("K", "!=", name)], {"K": "k"}), export.feel_name(f"N-{k}"), export.describe_condition(c), export.describe_action(Action("set", "score", "SCORE", k)), len(canon.disjuncts(c, 64))))
    return spark.createDataFrame(rows, "k long, below string, span string, other string, name string, said string, does string, ways long")


_SPANS = "(select n_nationkey as k, n_regionkey as r from nation)"


@_query(f"select 'S-R' || lpad(a.k::varchar, 3, '0') as rule_a, 'S-R' || lpad(b.k::varchar, 3, '0') as rule_b, true as in_both from {_SPANS} a join {_SPANS} b on a.k < b.k and b.k - a.k <= 3 and a.r <> b.r")
def conflicting_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rules that can fire together and write different values, each with an input that shows it."""
    rules = [Rule(f"S-R{int(n['n_nationkey']):03d}", leaf("KEY", "between", [int(n["n_nationkey"]), int(n["n_nationkey"]) + 3]), (Action("set", "region", "REGION", int(n["n_regionkey"])),), trace=Trace("S", "s", f"P{i}", i, i)) for i, n in enumerate(sorted(_nations(spark, sf_dir), key=lambda n: n["n_nationkey"]))]
    found = [c for c in algebra.conflicts(spark, rules) if c["kind"] == "conflict"]
    low = {r.rule_id: r.conditions["value"][0] for r in rules}
    rows = [(*sorted(c["rules"]), all(low[x] <= float(c["example"]["key"]) <= low[x] + 3 for x in c["rules"])) for c in found]
    return spark.createDataFrame(rows, "rule_a string, rule_b string, in_both boolean")


@_query("select n_nationkey::bigint as k, true as pushed, false as looser, n_nationkey::double as shown, true as possible, false as impossible, 1.0::double as same, 1.0::double as same_on_grid, true as alike from nation")
def equivalences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nation's limit: equivalent forms, an input that tells unequal ones apart, and what can't hold."""
    rows = []
    for n in _nations(spark, sf_dir):
        k = int(n["n_nationkey"])
        at_most, below = leaf("KEY", "<=", k), leaf("KEY", "<", k)
        looser, example = solver.equivalent(at_most, below, ["KEY"])
        pushed, _ = solver.equivalent(at_most, {"not": leaf("KEY", ">", k)}, ["KEY"])
        rule = Rule("E-R1", at_most, (Action("set", "f", "F", "Y"),))
        never = Rule("E-R2", {"all": [below, leaf("KEY", ">", k)]}, (Action("set", "f", "F", "Y"),))
        grid = verify.build_grid(spark, [at_most]).drop("row_id") if k == 0 else None
        alike = verify.behaves_alike(rule, rule.with_(conditions={"not": leaf("KEY", ">", k)}), [{"KEY": x} for x in (k - 1, k, k + 1)]) and not verify.behaves_alike(rule, rule.with_(conditions=below), [{"KEY": x} for x in (k - 1, k, k + 1)])
        rows.append((k, pushed, looser, float(next(iter(example.values()))), verify.satisfiable(rule), verify.satisfiable(never), verify.structural(at_most, {"not": leaf("KEY", ">", k)}), verify.structural(at_most, at_most, grid), alike))
    return spark.createDataFrame(rows, "k long, pushed boolean, looser boolean, shown double, possible boolean, impossible boolean, same double, same_on_grid double, alike boolean")


LOOP = """
IDENTIFICATION DIVISION.
PROGRAM-ID. SUMS.
DATA DIVISION.
WORKING-STORAGE SECTION.
01 LAST-ONE   PIC 9(3).
01 I          PIC 9(3).
01 TOTAL      PIC 9(5) VALUE 0.
01 ODD-ONES   PIC 9(5) VALUE 0.
01 KIND       PIC X(5) VALUE 'SMALL'.
PROCEDURE DIVISION.
MAIN-PARA.
    ACCEPT LAST-ONE
    PERFORM ADD-PARA VARYING I FROM 1 BY 1 UNTIL I > LAST-ONE
    IF TOTAL > 100 GO TO LARGE-PARA END-IF
    GO TO END-PARA.
ADD-PARA.
    ADD I TO TOTAL
    IF I > 10
        ADD 1 TO ODD-ONES
    END-IF.
LARGE-PARA.
    MOVE 'LARGE' TO KIND.
END-PARA.
    STOP RUN.
"""


@_query("select c_custkey, (c_nationkey * (c_nationkey + 1) // 2)::bigint as total, greatest(c_nationkey - 10, 0)::bigint as over_ten, case when c_nationkey * (c_nationkey + 1) // 2 > 100 then 'LARGE' else 'SMALL' end as kind, 'ok' as outcome from customer")
def program_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program with a loop and jumps, run for every customer."""
    read = rule_reader.extract(program_text.read_source("sums.cbl", LOOP))
    rows = spread(_t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("n")), "c_custkey")
    out = interpret.run_program(rows, read, {"LAST-ONE": "n"}, ["TOTAL", "ODD-ONES", "KIND"])
    return out.select("c_custkey", F.col("total").cast("decimal(9,0)").cast("long").alias("total"), F.col("odd_ones").cast("decimal(9,0)").cast("long").alias("over_ten"), F.btrim("kind").alias("kind"), "outcome")


@_query("""with r as (select n_nationkey as k, n_regionkey = 1 as changed from nation) select 'saved' as what, 'new' as name, count(*) as n from r union all select 'saved again', case when changed then 'new_version' else 'unchanged' end, count(*) from r group by changed
 union all select 'status', case when k = 0 then 'approved' when k = 1 then 'rejected' else 'candidate' end, count(*) from r group by 2 union all select 'versions', 'NAT-R002', case when changed then 3 else 2 end from r where k = 2 union all select 'queue', 'all', count(*) - 2 from r
 union all select 'latest', 'with a title of its own', count(*) filter (where changed and k <> 2) from r union all select * from (values ('queue', 'ann', 1), ('refused', 'SELF_APPROVAL', 1), ('refused', 'INVALID_STATE', 1), ('refused', 'RULE_NOT_FOUND', 1), ('audit', 'entries', 6), ('audit', 'whole', 1),
 ('audit', 'forged at', 2), ('audit', 'newest', 6), ('heard', 'ann', 2), ('heard', 'ann, unread', 1), ('programs', 'nat', 1), ('backup', 'complete', 1), ('backup', 'reviews', 6), ('purged', 'notifications', 2), ('vectors', 'kept', 1), ('bulk', 'ok', 2)) v""")  # fmt: skip
def store_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of every nation's rule: saved twice, reviewed, assigned, commented, audited, copied and purged."""
    s = store.RuleStore(spark, fresh_path(spark, "store"))
    rules = _chain(spark, sf_dir)
    region = {f"NAT-R{int(n['n_nationkey']):03d}": int(n["n_regionkey"]) for n in _nations(spark, sf_dir)}
    s.add_program("nat", "nat", "nat.cbl", {"nat.cbl": "text"})
    rows = [("saved", k, v) for k, v in s.save_rules("nat", rules).items() if v]
    changed = [r.with_(title=r.title + "!") if region[r.rule_id] == 1 else r for r in rules]
    rows += [("saved again", k, v) for k, v in s.save_rules("nat", changed).items() if v]
    for rule, action, user, changes in (("NAT-R000", "approve", "eva", None), ("NAT-R001", "reject", "eva", None), ("NAT-R002", "edit", "eva", {"title": "Edited"}), ("NAT-R001", "approve", "bob", None), ("NAT-R002", "approve", "eva", None), ("NAT-R999", "approve", "eva", None)):
        try:
            s.review(rule, action, "a reason", user, changes)
        except store.StoreError as e:
            rows.append(("refused", e.code, 1))
    s.assign("NAT-R003", "ann", "bob")
    s.add_comment("NAT-R003", "eva", "why?")
    rows += [("status", r["status"], r["count"]) for r in s.stats().collect()]
    rows += [("versions", "NAT-R002", s.history("NAT-R002").count()), ("queue", "all", s.review_queue().count()), ("queue", "ann", s.review_queue("ann").count()), ("latest", "with a title of its own", s.latest_rules(program="nat", status=None).filter(F.col("title").endswith("!")).filter("rule_id <> 'NAT-R001' or status = 'rejected'").count())]
    heard = s.notifications("ann").collect()
    s.mark_read(heard[0]["id"])
    rows += [("heard", "ann", len(heard)), ("heard", "ann, unread", s.notifications("ann", unread_only=True).count()), ("programs", "nat", s.programs().count())]
    done = s.bulk_review(["NAT-R004", "NAT-R005"], "reject", "all", "bob")
    rows.append(("bulk", "ok", sum(v == "ok" for v in done.values())))
    audit = s.verify_audit()
    log = s.table("reviews").withColumn("reason", F.when(F.col("id") == 2, "forged").otherwise(F.col("reason")))
    forged = store.verify_chain(log, "id", F.concat_ws("|", "rule_id", F.col("version").cast("string"), "action", "reason", "user", "changes", "ts")).first()
    rows += [("audit", "entries", audit["entries"]), ("audit", "whole", int(audit["ok"])), ("audit", "forged at", forged["broken_at"]), ("audit", "newest", s.audit_log(1).first()["id"])]
    s.put_embedding("NAT-R000", "h", [1.0, 0.0])
    s.put_embedding("NAT-R000", "h", [0.0, 1.0])
    rows.append(("vectors", "kept", s.table("embeddings").count()))
    copy = s.backup(fresh_path(spark, "backup"))
    rows += [("backup", "complete", int(copy["complete"] and copy["audit"]["ok"])), ("backup", "reviews", copy["rows"]["reviews"]), ("purged", "notifications", s.purge(0, -1)["notifications"])]
    return spark.createDataFrame(rows, "what string, name string, n long")


@_query("select p_partkey, upper(replace(p_name, ' ', '')) as canonical, length(p_name) - length(replace(p_name, ' ', '')) + 1 as n_words, lower(p_brand) like '%b%r%d%' as abbreviated, 'part_' || lower(split_part(p_brand, '#', 2)) as business from part")
def names_and_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical expressions, words, abbreviations and glossary names of every part."""
    names = Glossary({"P-NO": "part_number"}, {"BRAND": "part"})
    source = F.concat(F.lit("BRAND-"), F.substring_index("p_brand", "#", -1), F.lit("(3)"))
    return _t(spark, sf_dir, "part").select("p_partkey", text.canonical_expression(F.concat(F.lit("+ "), F.col("p_name"))).alias("canonical"), F.size(F.split(text.base(F.concat("p_name", F.lit(" (1)"))), " ")).cast("long").alias("n_words"), text.is_subsequence(F.lit("brd"), F.lower("p_brand")).alias("abbreviated"), names.column(source).alias("business"))


@_query("select l_orderkey, l_linenumber, true as same, l_quantity = 17 or l_quantity = 25 as grounded, l_extendedprice::decimal(15,2)::double as printed, abs(l_discount - 0.05) <= 0.010001 as near from lineitem")
def printed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed numbers read back, compared as bytes and as values, and held against what is allowed."""
    df = _t(spark, sf_dir, "lineitem")
    price, disc = F.col("l_extendedprice").cast("decimal(15,2)"), F.col("l_discount").cast("double")
    shown = F.concat(F.lit("PRICE= +"), price.cast("string"), F.lit("\nQTY="), F.col("l_quantity").cast("int").cast("string"))
    df, said = df.withColumn("said", codec.printed_map(shown)), F.col("said")  # two values are taken of one map
    return df.select("l_orderkey", "l_linenumber", codec.same_bytes(F.concat(F.lit(" 0"), price.cast("string")), price.cast("string")).alias("same"), text.grounded(F.concat(F.lit("limit "), said["QTY"]), F.array(F.lit(17.0), F.lit(0.25))).alias("grounded"), codec.printed_number(said["PRICE"], pic.parse_picture("9(11)V99")).cast("double").alias("printed"), verify.same_value(disc, F.lit(0.05), 0.010001).alias("near"))


@_query("""with s as (select l_orderkey, l_linenumber as n, epoch(l_shipdate)::bigint // 86400 as a from lineitem), p as (select x.l_orderkey as k, x.n as g, y.n as p, round((30 - abs(x.a - y.a) + 1) / (30.0 + abs(x.a - y.a) + 1), 9) as o from s x join s y on x.l_orderkey = y.l_orderkey and abs(x.a - y.a) <= 30 and x.n <> y.n)
 select k as l_orderkey, g as n, p as nearest, round(o, 6) as overlap from p where o >= 0.5 qualify row_number() over (partition by k, g order by o desc, p) = 1""")  # fmt: skip
def nearest_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each line of an order the other line whose days overlap its own most, if by half."""
    day = F.unix_date(F.to_date("l_shipdate"))
    t = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), day.alias("line_start"), (day + 30).alias("line_end"))
    # a line is no candidate for itself: candidates of each line are those of its order but itself
    own = t.select(F.concat_ws(":", "o", "n").alias("program"), F.concat_ws(":", "o", "n").alias("rule_id"), "line_start", "line_end", "o", "n")
    others = t.alias("x").join(t.alias("y"), (F.col("x.o") == F.col("y.o")) & (F.col("x.n") != F.col("y.n"))).select(F.concat_ws(":", "x.o", "x.n").alias("program"), F.col("y.n").cast("string").alias("rule_id"), F.col("y.n").cast("long").alias("seq"), "y.line_start", "y.line_end")
    out = algebra.nearest_by_lines(own, others, 0.5)
    return out.select(F.split("gold_id", ":")[0].cast("long").alias("l_orderkey"), F.split("gold_id", ":")[1].cast("int").alias("n"), F.col("pred_id").cast("int").alias("nearest"), F.round("overlap", 6).alias("overlap"))


@_query("""with n as (select o_orderpriority as p, o_orderkey as k, row_number() over (partition by o_orderpriority, o_orderstatus = 'F' order by o_orderkey) as nth, o_orderstatus = 'F' as f from orders) select a.k as rule_id, b.k as gold_id from n a join n b on a.p = b.p and a.nth = b.nth and a.f and not b.f""")
def paired_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two sides with equal keys, the first with the first, and so on."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("rule_key"), F.col("o_orderkey").alias("rule_id"), F.col("o_orderkey").alias("seq"), "o_orderstatus")
    return algebra.pair_rules(o.filter("o_orderstatus = 'F'").drop("o_orderstatus"), o.filter("o_orderstatus <> 'F'").drop("o_orderstatus"))


@_query("select c_custkey, case when c_acctbal <= 0 then 0.1 when c_acctbal <= 5000 then round(0.1 + 0.5 * c_acctbal / 5000, 4) when c_acctbal <= 9000 then round(0.6 + 0.3 * (c_acctbal - 5000) / 4000, 4) else 0.9 end::double as p from customer")
def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability that knots give for every balance."""
    return _t(spark, sf_dir, "customer").select("c_custkey", metrics.interpolate(F.col("c_acctbal").cast("double"), [(0.0, 0.1), (5000.0, 0.6), (9000.0, 0.9)]).cast("double").alias("p"))


@_query("select n_nationkey::bigint as k, true as kept_logic, 'limit_' || n_nationkey as field, false as clear, true as wrong from nation")
def renamed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with other business names keep their logic; intents that contradict them are found."""
    rows = []
    for n in _nations(spark, sf_dir):
        k = int(n["n_nationkey"])
        rule = Rule("N-R1", leaf("KEY", ">=", k), (Action("set", "f", "F", "Y"),))
        new = rename(rule, {"KEY": f"Limit {k}", "F": "hidden"}, ["KEY"])
        rows.append((k, canon.rule_key(new) == canon.rule_key(rule), new.conditions["field"], bool(wording_issues(f"a key of at least {k}", [rule.conditions])), bool(wording_issues(f"a key over {k}", [rule.conditions]))))
    return spark.createDataFrame(rows, "k long, kept_logic boolean, field string, clear boolean, wrong boolean")
