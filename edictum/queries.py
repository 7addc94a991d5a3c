"""Queries over the driver's tables that exercise the operators, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edictum.functions import pic, text
from edictum.operators import algebra, codec, metrics, search, store, verify
from edictum.operators import graph as graphs
from edictum.plans import compile as rc
from edictum.plans.ir import Action, Condition, Rule, Trace, leaf
from edictum.sources import rule_reader, program_text, program_tree

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _all(*c: Condition) -> Condition:
    return {"all": list(c)}


def _any(*c: Condition) -> Condition:
    return {"any": list(c)}


def _not(c: Condition) -> Condition:
    return {"not": c}


def _set(name: str, value=None, expr: str | None = None) -> Action:
    return Action("set", name.lower().replace("-", "_"), name, value, expr)


def _compute(name: str, expr: str) -> Action:
    return Action("compute", name.lower().replace("-", "_"), name, None, expr)


MONEY = "decimal(15,2)"
AMOUNT, PRIORITY, STATUS, BALANCE, SEGMENT = "ORD-AMT", "ORD-PRIO", "ORD-STAT", "CUST-BAL", "CUST-SEG"


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    df = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return df, {AMOUNT: F.col("o_totalprice").cast(MONEY), PRIORITY: "o_orderpriority", STATUS: "o_orderstatus", BALANCE: F.col("c_acctbal").cast(MONEY), SEGMENT: "c_mktsegment"}


_HIGH, _MID = leaf(AMOUNT, ">", 250000), leaf(AMOUNT, ">", 100000)
CHAIN = [
    Rule("CHAIN-R001", _all(_HIGH, leaf(BALANCE, "<", 0)), (_set("DECISION", "R"),), trace=Trace("CHAIN", "chain", "DECIDE", 1, 3)),
    Rule("CHAIN-R002", _all(_not(_all(_HIGH, leaf(BALANCE, "<", 0))), _MID), (_set("DECISION", "M"), _compute("FEE", "ORD-AMT * 0.015")), trace=Trace("CHAIN", "chain", "DECIDE", 4, 6)),
    Rule("CHAIN-R003", _all(_not(_all(_HIGH, leaf(BALANCE, "<", 0))), _not(_MID)), (_set("DECISION", "A"), _compute("FEE", "ORD-AMT * 0.01 + 5")), trace=Trace("CHAIN", "chain", "DECIDE", 7, 9)),
]
FEE = {"FEE": pic.parse_picture("9(7)V99"), "DECISION": pic.parse_picture("X")}
_OC = "(select o.*, c.* from orders o join customer c on o_custkey = c_custkey)"
_AMT, _BAL = "o_totalprice::decimal(15,2)", "c_acctbal::decimal(15,2)"


@_query(f"""select o_orderkey, case when {_AMT} > 250000 and {_BAL} < 0 then 'R' when {_AMT} > 100000 then 'M' else 'A' end as decision,
 (case when {_AMT} > 250000 and {_BAL} < 0 then 0 when {_AMT} > 100000 then trunc({_AMT} * 0.015, 2) else trunc({_AMT} * 0.01 + 5, 2) end)::decimal(9,2)::double as fee,
 case when {_AMT} > 250000 and {_BAL} < 0 then 'CHAIN-R001' when {_AMT} > 100000 then 'CHAIN-R002' else 'CHAIN-R003' end as fired from {_OC}""")
def score_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first-match chain with a truncated fee over all orders."""
    df, b = _orders(spark, sf_dir)
    out = rc.score(df, CHAIN, b, {"FEE": 0, "DECISION": " "}, FEE)
    return out.select("o_orderkey", "decision", F.col("fee").cast("decimal(9,2)").cast("double").alias("fee"), F.array_join("fired_rules", ",").alias("fired"))


@_query(f"select o_orderkey, case when o_orderpriority = '1-URGENT' then 'Y' else 'N' end as flag, case when {_AMT} >= 200000 then 'BIG' else 'SMALL' end as size_band from orders")
def score_if_else(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent rules with else-actions."""
    rules = [Rule("IF-R001", leaf(PRIORITY, "==", "1-URGENT"), (_set("FLAG", "Y"),), (_set("FLAG", "N"),)), Rule("IF-R002", leaf(AMOUNT, ">=", 200000), (_set("SIZE-BAND", "BIG"),), (_set("SIZE-BAND", "SMALL"),))]
    df = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rc.score(df, rules, {PRIORITY: "o_orderpriority", AMOUNT: F.col("o_totalprice").cast(MONEY)}).select("o_orderkey", "flag", "size_band")


@_query(f"select o_orderkey, case when c_mktsegment = 'BUILDING' then case when {_AMT} > 150000 then 'B1' else 'B2' end when {_BAL} < 0 then 'X1' else '-' end as band from {_OC}")
def score_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested decisions, as path rules."""
    seg, big = leaf(SEGMENT, "==", "BUILDING"), leaf(AMOUNT, ">", 150000)
    rules = [Rule("N-R001", _all(seg, big), (_set("BAND", "B1"),)), Rule("N-R002", _all(seg, _not(big)), (_set("BAND", "B2"),)), Rule("N-R003", _all(_not(seg), leaf(BALANCE, "<", 0)), (_set("BAND", "X1"),))]
    df, b = _orders(spark, sf_dir)
    return rc.score(df, rules, b, {"BAND": "-"}).select("o_orderkey", "band")


MIXED = [
    Rule("MX-R001", _any(leaf(STATUS, "==", "F"), leaf(PRIORITY, "in", ["1-URGENT", "2-HIGH"])), (_set("ROUTE", "FAST"),)),
    Rule("MX-R002", leaf(AMOUNT, "between", [50000, 60000]), (_set("CHECK", "Y"),)),
    Rule("MX-R003", _not(leaf(SEGMENT, "in", ["BUILDING", "MACHINERY"])), (_set("DESK", "GENERAL"),)),
    Rule("MX-R004", leaf(BALANCE, "is_negative"), (_set("HOLD", "Y"),)),
    Rule("MX-R005", leaf(AMOUNT, ">", ref=BALANCE), (_set("COVER", "N"),)),
]


@_query(f"""select o_orderkey, concat_ws(',', case when o_orderstatus = 'F' or o_orderpriority in ('1-URGENT', '2-HIGH') then 'MX-R001' end, case when {_AMT} between 50000 and 60000 then 'MX-R002' end,
 case when c_mktsegment not in ('BUILDING', 'MACHINERY') then 'MX-R003' end, case when {_BAL} < 0 then 'MX-R004' end, case when {_AMT} > {_BAL} then 'MX-R005' end) as fired from {_OC}""")
def score_mixed_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of five kinds of rules fire."""
    df, b = _orders(spark, sf_dir)
    return rc.score(df, MIXED, b).select("o_orderkey", F.array_join("fired_rules", ",").alias("fired"))


@_query(f"""with a as (select o_orderkey, {_AMT} as amt, trunc({_AMT} / 1000, 0) as points from orders), b as (select *, case when points > 200 then 'GOLD' else 'BASE' end as tier from a)
 select o_orderkey, points::bigint as points, tier, (case when tier = 'GOLD' then trunc(points * 1.5, 0) else points end)::bigint as bonus from b""")
def score_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later rules read what earlier ones wrote."""
    always = {"all": []}
    rules = [Rule("S-R001", always, (_compute("POINTS", "ORD-AMT / 1000"),)), Rule("S-R002", leaf("POINTS", ">", 200), (_set("TIER", "GOLD"),), (_set("TIER", "BASE"),)), Rule("S-R003", leaf("TIER", "==", "GOLD"), (_compute("BONUS", "POINTS * 1.5"),), (_compute("BONUS", "POINTS"),))]
    p = {"POINTS": pic.parse_picture("9(7)"), "BONUS": pic.parse_picture("9(7)"), "TIER": pic.parse_picture("X(4)")}
    out = rc.score(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), rules, {AMOUNT: F.col("o_totalprice").cast(MONEY)}, None, p)
    return out.select("o_orderkey", F.col("points").cast("long").alias("points"), "tier", F.col("bonus").cast("long").alias("bonus"))


@_query(f"select c_custkey, case when c_mktsegment <> 'AUTOMOBILE' then '?' when {_BAL} > 5000 then 'HIGH' else 'LOW' end as grade from customer")
def score_context_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out of its context a rule does nothing, not even its else-actions."""
    rules = [Rule("C-R001", leaf(BALANCE, ">", 5000), (_set("GRADE", "HIGH"),), (_set("GRADE", "LOW"),), context=leaf(SEGMENT, "==", "AUTOMOBILE"))]
    df = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return rc.score(df, rules, {SEGMENT: "c_mktsegment", BALANCE: F.col("c_acctbal").cast(MONEY)}, {"GRADE": "?"}).select("c_custkey", "grade")


@_query(f"select c_custkey, case when {_BAL} * 2 + 10 > 9000 then 'A' else 'C' end as decision from customer")
def score_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field that the program computes before it is tested."""
    rules = [Rule("D-R001", leaf("WS-SCORE", ">", 9000), (_set("DECISION", "A"),), (_set("DECISION", "C"),), derivations={"WS-SCORE": "CUST-BAL * 2 + 10"})]
    return rc.score(_t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), rules, {BALANCE: F.col("c_acctbal").cast(MONEY)}).select("c_custkey", "decision")


@_query("select event_id, case when event_type = 'purchase' and value > 50 then 'Y' else 'N' end as flag, case when value > 50 then 1 else 0 end::int as over_50 from (select event_id, event_type, case when event_type = 'view' then null else value end as value from events)")
def score_defaults_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing operands make a leaf false, and its negation true; outputs begin at their defaults."""
    df = _t(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_type") != "view", F.col("value")).alias("value"))
    rules = [Rule("E-R001", _all(leaf("EV-TYPE", "==", "purchase"), leaf("EV-VAL", ">", 50)), (_set("FLAG", "Y"),)), Rule("E-R002", _not(leaf("EV-VAL", ">", 50)), (_set("OVER-50", 0),))]
    out = rc.score(df, rules, {"EV-TYPE": "event_type", "EV-VAL": "value"}, {"FLAG": "N", "OVER-50": 1})
    return out.select("event_id", "flag", F.col("over_50").cast("int").alias("over_50"))


def _condition_query(table: str, key: list[str], bindings: dict, **conditions: Condition) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _t(spark, sf_dir, table)
        scope = rc.Scope.of(df, {k: F.expr(v) for k, v in bindings.items()})
        return df.select(*key, *(rc.condition(c, scope).alias(n) for n, c in conditions.items()))

    return run


def _add(name: str, f: Query, sql: str) -> None:
    f.__name__ = name
    QUERIES[name], ORACLES[name] = f, sql


_LINE = {"QTY": "cast(l_quantity as decimal(15,2))", "PRICE": "cast(l_extendedprice as decimal(15,2))", "DISC": "cast(l_discount as decimal(15,2))", "FLAG": "l_returnflag", "TAX": "cast(l_tax as decimal(15,2))"}
_KEY = ["l_orderkey", "l_linenumber"]
_add("op_between_in_notin", _condition_query("lineitem", _KEY, _LINE, b=leaf("QTY", "between", [10, 20]), i=leaf("FLAG", "in", ["A", "R"]), n=leaf("FLAG", "not_in", ["A"]), m=leaf("QTY", "in", [1, 2, "3"])), "select l_orderkey, l_linenumber, l_quantity between 10 and 20 as b, l_returnflag in ('A', 'R') as i, l_returnflag <> 'A' as n, l_quantity in (1, 2, 3) as m from lineitem")
_add("op_relations", _condition_query("lineitem", _KEY, _LINE, eq=leaf("QTY", "==", 17), ne=leaf("QTY", "!=", 17), lt=leaf("DISC", "<", 0.05), le=leaf("DISC", "<=", 0.05), gt=leaf("DISC", ">", 0.05), ge=leaf("DISC", ">=", 0.05)), "select l_orderkey, l_linenumber, l_quantity = 17 as eq, l_quantity <> 17 as ne, l_discount::decimal(15,2) < 0.05 as lt, l_discount::decimal(15,2) <= 0.05 as le, l_discount::decimal(15,2) > 0.05 as gt, l_discount::decimal(15,2) >= 0.05 as ge from lineitem")
_add("op_groups", _condition_query("lineitem", _KEY, _LINE, none={"any": []}, every={"all": []}, both=_all(leaf("QTY", ">", 10), leaf("FLAG", "==", "N")), either=_any(leaf("QTY", ">", 40), leaf("FLAG", "==", "R")), neither=_not(_any(leaf("QTY", ">", 40), leaf("FLAG", "==", "R")))), "select l_orderkey, l_linenumber, false as none, true as every, l_quantity > 10 and l_returnflag = 'N' as both, l_quantity > 40 or l_returnflag = 'R' as either, not (l_quantity > 40 or l_returnflag = 'R') as neither from lineitem")
_add("op_sign", _condition_query("customer", ["c_custkey"], {"BAL": "cast(c_acctbal as decimal(15,2))"}, p=leaf("BAL", "is_positive"), n=leaf("BAL", "is_negative"), z=leaf("BAL", "is_zero")), "select c_custkey, c_acctbal > 0 as p, c_acctbal < 0 as n, c_acctbal = 0 as z from customer")
_add("op_ref_compare", _condition_query("lineitem", _KEY, _LINE, less=leaf("DISC", "<", ref="TAX"), sum=leaf("DISC + TAX", ">", 0.1)), "select l_orderkey, l_linenumber, l_discount::decimal(15,2) < l_tax::decimal(15,2) as less, l_discount::decimal(15,2) + l_tax::decimal(15,2) > 0.1 as sum from lineitem")
_add("op_arith_operand", _condition_query("lineitem", _KEY, _LINE, net=leaf("PRICE * (1 - DISC)", ">", 30000), sq=leaf("QTY ** 2", ">=", 400)), "select l_orderkey, l_linenumber, l_extendedprice::decimal(15,2) * (1 - l_discount::decimal(15,2)) > 30000 as net, l_quantity * l_quantity >= 400 as sq from lineitem")
_add("op_divzero", _condition_query("lineitem", _KEY, _LINE, d=leaf("PRICE / DISC", ">", 500000), z=leaf("PRICE / 0", "==", 0)), "select l_orderkey, l_linenumber, coalesce(l_extendedprice::decimal(15,2) / nullif(l_discount::decimal(15,2), 0), 0) > 500000 as d, true as z from lineitem")
_add("op_is_numeric", _condition_query("events", ["event_id"], {"DIGITS": "get_json_object(props, '$.k')", "WORD": "event_type", "MIXED": "props"}, d=leaf("DIGITS", "is_numeric"), w=leaf("WORD", "is_numeric"), m=leaf("MIXED", "is_numeric")), "select event_id, coalesce(regexp_full_match(json_extract_string(props, '$.k'), '[0-9]+'), false) as d, regexp_full_match(event_type, '[0-9]+') as w, regexp_full_match(props, '[0-9]+') as m from events")
_add("op_is_alphabetic", _condition_query("part", ["p_partkey"], {"NAME": "p_name", "BRAND": "p_brand", "SIZE": "p_partkey"}, n=leaf("NAME", "is_alphabetic"), b=leaf("BRAND", "is_alphabetic"), s=leaf("SIZE", "is_alphabetic")), "select p_partkey, regexp_full_match(p_name, '[\\p{L} ]*') as n, regexp_full_match(p_brand, '[\\p{L} ]*') as b, false as s from part")
_add("op_text_number", _condition_query("orders", ["o_orderkey"], {"PRIO": "substring(o_orderpriority, 1, 1)", "STAT": "o_orderstatus"}, text_two=leaf("PRIO", "==", "2"), num_two=leaf("PRIO", "==", 2), gt=leaf("PRIO", ">", 2.5), pad=leaf("STAT", "==", "F   ")), "select o_orderkey, o_orderpriority[1] = '2' as text_two, o_orderpriority[1]::int = 2 as num_two, o_orderpriority[1]::int > 2.5 as gt, o_orderstatus = 'F' as pad from orders")


@_query("select l_orderkey, l_linenumber, trunc(l_extendedprice::decimal(15,2) * l_discount::decimal(15,2), 2)::decimal(9,2)::double as cut, (-((l_extendedprice::decimal(15,2) * 100)::bigint // 7) / 100.0)::decimal(9,2)::double as neg from lineitem")
def pic_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores cut digits toward zero, with and without a sign."""
    df = _t(spark, sf_dir, "lineitem")
    price, disc = F.col("l_extendedprice").cast(MONEY), F.col("l_discount").cast(MONEY)
    return df.select(*_KEY, pic.store_number(price * disc, pic.parse_picture("9(7)V99")).cast("double").alias("cut"), pic.store_number(-price / 7, pic.parse_picture("S9(7)V99")).cast("double").alias("neg"))


@_query("select c_custkey, (abs(trunc(c_acctbal::decimal(15,2), 0)) % 1000)::bigint as wrapped, abs(c_acctbal::decimal(15,2))::double as unsigned_bal from customer")
def pic_wrap_unsigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits beyond the picture are lost, and so is the sign where there is none."""
    b = F.col("c_acctbal").cast(MONEY)
    return _t(spark, sf_dir, "customer").select("c_custkey", pic.store_number(b, pic.parse_picture("9(3)")).cast("long").alias("wrapped"), pic.store_number(b, pic.parse_picture("9(7)V99")).cast("double").alias("unsigned_bal"))


@_query("select c_custkey, rtrim(left(c_mktsegment, 4)) as short, rtrim(left(c_name || '      ', 30)) as padded from customer")
def pic_text_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text is cut to its length and loses blanks at its end."""
    df = _t(spark, sf_dir, "customer")
    return df.select("c_custkey", pic.store_text(F.col("c_mktsegment"), pic.parse_picture("X(4)")).alias("short"), pic.store_text(F.concat("c_name", F.lit("      ")), pic.parse_picture("X(30)")).alias("padded"))


RATE_TABLE = """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. SEGRATE.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01 CUST-SEG          PIC X(10).
       01 CUST-BAL          PIC S9(7)V99.
       01 WS-RATE           PIC 9V999 VALUE 0.
       01 WS-FOUND          PIC X VALUE 'N'.
       01 RATE-VALUES.
          05 FILLER         PIC X(14) VALUE 'BUILDING  0015'.
          05 FILLER         PIC X(14) VALUE 'MACHINERY 0025'.
          05 FILLER         PIC X(14) VALUE 'HOUSEHOLD 0040'.
       01 RATE-TABLE REDEFINES RATE-VALUES.
          05 RATE-ROW OCCURS 3 TIMES INDEXED BY RX.
             10 R-SEG       PIC X(10).
             10 R-RATE      PIC 9V999.
       PROCEDURE DIVISION.
       MAIN-PARA.
           SET RX TO 1
           SEARCH RATE-ROW
               AT END
                   MOVE 0.05 TO WS-RATE
               WHEN R-SEG(RX) = CUST-SEG
                   MOVE R-RATE(RX) TO WS-RATE
                   MOVE 'Y' TO WS-FOUND
           END-SEARCH
           STOP RUN.
"""


@lru_cache(maxsize=4)
def _extracted(source: str) -> rule_reader.Extraction:
    return rule_reader.extract(program_text.read_source("query.cbl", source))


@_query("select c_custkey, coalesce(r.rate, 0.050)::double as ws_rate, case when r.rate is null then 'N' else 'Y' end as ws_found from customer left join (values ('BUILDING', 0.015), ('MACHINERY', 0.025), ('HOUSEHOLD', 0.040)) r(seg, rate) on c_mktsegment = seg")
def lookup_search_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of a table in a program's data, extracted to rules and scored; no match takes its end."""
    e = _extracted(RATE_TABLE)
    df = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    out = rc.score(df, e.rules, {SEGMENT: "c_mktsegment"}, e.defaults(), e.pictures())
    return out.select("c_custkey", F.col("ws_rate").cast("decimal(4,3)").cast("double").alias("ws_rate"), "ws_found")


@_query("select 'SEGRATE-R' || lpad((case c_mktsegment when 'BUILDING' then 1 when 'MACHINERY' then 2 when 'HOUSEHOLD' then 3 else 4 end)::varchar, 3, '0') as rule_id, count(*) as n from customer group by 1")
def lookup_at_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each row of the searched table decides, and its end."""
    e = _extracted(RATE_TABLE)
    out = rc.score(_t(spark, sf_dir, "customer").select("c_mktsegment"), e.rules, {SEGMENT: "c_mktsegment"}, e.defaults())
    return out.select(F.explode("fired_rules").alias("rule_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


LOAN = """
IDENTIFICATION DIVISION.
PROGRAM-ID. ORDCHK.
DATA DIVISION.
WORKING-STORAGE SECTION.
01 ORD-REC.
   05 ORD-AMT      PIC 9(9)V99.
   05 ORD-STAT     PIC X.
      88 ORD-OPEN  VALUE 'O' 'P'.
   05 CUST-BAL     PIC S9(7)V99.
01 WS-VALID        PIC X VALUE 'Y'.
01 WS-SCORE        PIC S9(9)V99.
01 BAND            PIC X(4) VALUE 'NONE'.
PROCEDURE DIVISION.
MAIN-PARA.
    ACCEPT ORD-REC
    COMPUTE WS-SCORE = ORD-AMT / 100 + CUST-BAL
    EVALUATE TRUE
        WHEN ORD-OPEN AND WS-SCORE > 5000
            MOVE 'HIGH' TO BAND
        WHEN ORD-OPEN
            MOVE 'OPEN' TO BAND
        WHEN WS-SCORE NOT > 0
            MOVE 'LOW' TO BAND
        WHEN OTHER
            MOVE 'REST' TO BAND
    END-EVALUATE
    STOP RUN.
"""


@_query(f"select o_orderkey, case when o_orderstatus in ('O', 'P') and s > 5000 then 'HIGH' when o_orderstatus in ('O', 'P') then 'OPEN' when s <= 0 then 'LOW' else 'REST' end as band from (select *, {_AMT} / 100 + {_BAL} as s from {_OC})")
def extract_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From source text to rules with derivations, scored over all orders."""
    e = _extracted(LOAN)
    df, b = _orders(spark, sf_dir)
    return rc.score(df, e.rules, {"ORD-AMT": b[AMOUNT], "ORD-STAT": "o_orderstatus", "CUST-BAL": b[BALANCE]}, e.defaults()).select("o_orderkey", "band")


@_query(f"with f as (select case when {_AMT} > 250000 and {_BAL} < 0 then 'CHAIN-R001' when {_AMT} > 100000 then 'CHAIN-R002' else 'CHAIN-R003' end as rule_id from {_OC}) select rule_id, count(*) as n, round(count(*) / (select count(*) from f), 6) as share from f group by 1")
def rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule fires, and its share."""
    df, b = _orders(spark, sf_dir)
    fired = rc.score(df, CHAIN, b).select(F.explode("fired_rules").alias("rule_id"))
    counts = fired.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


CHAIN_B = [CHAIN[0].with_(conditions=_all(leaf(AMOUNT, ">", 240000), leaf(BALANCE, "<", 0))), CHAIN[1].with_(conditions=_all(_not(_all(leaf(AMOUNT, ">", 240000), leaf(BALANCE, "<", 0))), leaf(AMOUNT, ">=", 100000))), CHAIN[2].with_(conditions=_all(_not(_all(leaf(AMOUNT, ">", 240000), leaf(BALANCE, "<", 0))), _not(leaf(AMOUNT, ">=", 100000))))]
_DIFF = f"(select o_orderkey, case when {_AMT} > 250000 and {_BAL} < 0 then 'R' when {_AMT} > 100000 then 'M' else 'A' end as out_a, case when {_AMT} > 240000 and {_BAL} < 0 then 'R' when {_AMT} >= 100000 then 'M' else 'A' end as out_b from {_OC})"


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, b = _orders(spark, sf_dir)
    return verify.differential(df, CHAIN, CHAIN_B, "decision", b, {"DECISION": " "})


@_query(f"select o_orderkey, out_a, out_b from {_DIFF} where out_a <> out_b")
def diff_two_rulesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders on which two versions of a rule set differ."""
    return _diff(spark, sf_dir).filter("not agree").select("o_orderkey", "out_a", "out_b")


@_query(f"select case out_a when 'R' then 'CHAIN-R001' when 'M' then 'CHAIN-R002' else 'CHAIN-R003' end as rule_id, count(*) as n, round(avg((out_a = out_b)::int), 6) as agreement from {_DIFF} group by 1")
def agreement_per_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement by the rule that fired in the first version."""
    return verify.agreement_by_rule(_diff(spark, sf_dir)).select("rule_id", "n", F.round("agreement", 6).alias("agreement"))


def _some_rules() -> list[Rule]:
    t = lambda n, p="P1": Trace("PRG", "prg", p, n, n + 2)
    return [
        Rule("PRG-R001", leaf("AGE", "in", [17, 18]), (_set("F", "Y"),), trace=t(10)), Rule("PRG-R002", _any(leaf("AGE", "==", 18), leaf("AGE", "==", 17.0)), (_set("F", "Y"),), trace=t(20)),
        Rule("PRG-R003", _not(_any(leaf("AGE", ">", 65), leaf("SEX", "==", "M"))), (_set("F", "N"),), trace=t(30)), Rule("PRG-R004", _all(leaf("SEX", "!=", "M"), leaf("AGE", "<=", 65)), (_set("F", "N "),), trace=t(40)),
        Rule("PRG-R005", leaf("AGE", "between", [1, 9]), (_set("G", 1),), trace=t(50, "P2")),
    ]


@_query("select * from (values ('PRG-R001', 'PRG-R002'), ('PRG-R003', 'PRG-R004')) t(first, rule_id)")
def rule_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that say the same in other words."""
    return algebra.duplicates(algebra.rule_keys(spark, _some_rules()))


@_query("select * from (values ('PRG-R001', 'PRG-R001', 'unchanged'), ('PRG-R002', 'PRG-R002', 'unchanged'), ('PRG-R003', 'PRG-R003', 'moved'), ('PRG-R004', null, 'removed'), ('PRG-R005', 'PRG-R005', 'changed'), (null, 'PRG-R009', 'added')) t(old_id, new_id, kind)")
def rule_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each rule in a new version."""
    old = _some_rules()
    new = [*old[:2], old[2].with_(trace=Trace("PRG", "prg", "P1", 31, 33)), old[4].with_(conditions=leaf("AGE", "between", [1, 10])), Rule("PRG-R009", leaf("ZONE", "==", 7), (_compute("H", "ZONE * 2"),), trace=Trace("PRG", "prg", "P9", 90, 91))]
    return algebra.drift(algebra.rule_keys(spark, old), algebra.rule_keys(spark, new)).select("old_id", "new_id", "kind")


@_query("select 5::bigint as n_gold, 5::bigint as n_pred, 3::bigint as tp, 4::bigint as logic_tp, 0.6::double as precision, 0.6::double as recall, 0.6::double as f1, 0.75::double as traceability")
def rule_match_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted against expected rules: one moved too far, one with another condition."""
    gold = _some_rules()
    pred = [*gold[:3], gold[3].with_(trace=Trace("PRG", "prg", "P1", 400, 402)), gold[4].with_(conditions=leaf("AGE", "between", [2, 9]))]
    out = algebra.match_summary(algebra.match_rules(algebra.rule_keys(spark, pred), algebra.rule_keys(spark, gold)))
    return out.select(*(F.col(c).cast("long").alias(c) for c in ("n_gold", "n_pred", "tp", "logic_tp")), *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "traceability")))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", "n_chars").join(_t(spark, sf_dir, "labels"), "doc_id").withColumn("p", F.least(F.col("n_chars") / 5000, F.lit(1.0)))


_SCORED = "(select quality, least(n_chars / 5000.0::double, 1.0::double) as p from documents join labels using (doc_id))"


@_query(f"with c as (select sum((p >= 0.5 and quality = 1)::int) as tp, sum((p >= 0.5 and quality = 0)::int) as fp, sum((p < 0.5 and quality = 1)::int) as fn, sum((p < 0.5 and quality = 0)::int) as tn from {_SCORED}) select tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from c")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, precision, recall and F1 of a threshold."""
    out = metrics.confusion(_scored(spark, sf_dir), F.col("p") >= 0.5, F.col("quality") == 1)
    return out.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@_query(f"with b as (select least(floor(p * 10), 9) as bin, count(*) as n, avg(p) as p, avg(quality) as y, sum((p - quality) * (p - quality)) as sq from {_SCORED} group by 1) select round(sum(n * abs(p - y)) / sum(n), 6) as ece, round(sum(sq) / sum(n), 6) as brier from b")
def ece_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration error and Brier score."""
    return metrics.calibration_error(_scored(spark, sf_dir), F.col("p"), F.col("quality")).select(F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"))


@_query(f"with s as (select p, sum(quality) as pos, sum(1 - quality) as neg from {_SCORED} group by 1), w as (select *, coalesce(sum(neg) over (order by p rows between unbounded preceding and 1 preceding), 0) as below from s) select round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) as auroc from w")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking quality by rank sums."""
    return metrics.auroc(_scored(spark, sf_dir), F.col("p"), F.col("quality") == 1).select(F.round("auroc", 6).alias("auroc"))


@_query(f"""with s as (select round(p, 2) as x, sum(quality)::double as s, count(*)::double as w from {_SCORED} group by 1),
 c as (select x, sum(s) over (order by x) as s1, sum(w) over (order by x) as w1, sum(s) over (order by x) - s as s0, sum(w) over (order by x) - w as w0 from s),
 spans as (select a.x as a, b.x as b, (b.s1 - a.s0) / (b.w1 - a.w0) as m from c a join c b on a.x <= b.x),
 low as (select i.x, a, min(m) as m from c i join spans on a <= i.x and b >= i.x group by 1, 2), fit as (select x, round(max(m), 9) as y from low group by 1),
 ends as (select y, min(x) as lo, max(x) as hi from fit group by 1) select lo as x, round(y, 6) as y from ends union select hi, round(y, 6) from ends""")
def calibration_knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The isotonic fit of quality to score, against the formula of least and greatest means."""
    knots = metrics.isotonic_knots(_scored(spark, sf_dir), F.round("p", 2), F.col("quality"))
    return knots.select("x", F.round("y", 6).alias("y"))


@_query("""with w as (select doc_id, list_distinct(list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: case when length(x) > 3 and x like '%s' then x[:-2] else x end)) as b, list_distinct(regexp_extract_all(lower(lang || ' ' || source), '[a-z0-9]+')) as t from documents)
 select doc_id, (case when list_contains(t, 'en') then 2 when list_contains(b, 'en') then 1 else 0 end + case when list_contains(t, 'the') then 2 when list_contains(b, 'the') then 1 else 0 end)::double as score from w where score > 0 order by score desc, doc_id limit 20""")
def search_keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ranked by words: two in titles, one in bodies."""
    score = search.keyword_score({"en", "the"}, [], F.concat_ws(" ", "lang", "source"), None, F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(20)


@_query("select * from (values ('F-R1', 4.0::double), ('F-R2', 1.0::double)) t(rule_id, score)")
def search_number_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number with a relation: the same comparison counts more than the same number."""
    rules = [Rule("F-R1", leaf("LIMIT-X", "<", 18), (_set("F", "Y"),)), Rule("F-R2", leaf("LIMIT-X", ">=", 18), (_set("F", "N"),)), Rule("F-R3", leaf("LIMIT-X", ">", 99), (_set("F", "N"),))]
    return search.search(search.rules_table(spark, rules), "all under 18").select("rule_id", "score")


@_query("with q as (select embedding as e from embeddings where vec_id = 7) select vec_id, round(list_cosine_similarity(embedding::double[], q.e::double[]), 6) as score from embeddings, q order by list_cosine_similarity(embedding::double[], q.e::double[]) desc, vec_id limit 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to one."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = F.broadcast(e.filter("vec_id = 7").limit(1).select(F.col("embedding").alias("q")))
    return e.crossJoin(q).select("vec_id", search.cosine(F.col("embedding"), F.col("q")).alias("s")).orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.round("s", 6).alias("score"))


_SETS = "(select a.item_id, list_distinct(regexp_extract_all(lower(a.text), '[a-z0-9]+')) as x, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) as y from benchmark a join benchmark b on b.item_id = a.item_id + 1)"


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _t(spark, sf_dir, "benchmark")
    return b.select("item_id", metrics.token_set(F.col("text")).alias("x")).join(b.select((F.col("item_id") - 1).alias("item_id"), metrics.token_set(F.col("text")).alias("y")), "item_id")


@_query(f"select item_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) as jaccard from {_SETS}")
def concept_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard of neighbouring items' words."""
    return _sets(spark, sf_dir).select("item_id", F.round(metrics.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@_query(f"select item_id, round(2 * len(list_intersect(x, y)) / (len(x) + len(y)), 6) as f1 from {_SETS}")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of neighbouring items' words."""
    return _sets(spark, sf_dir).select("item_id", F.round(metrics.token_f1(F.col("x"), F.col("y")), 6).alias("f1"))


@_query("""with recursive e(src, dst) as (select 'nation:' || n_nationkey, 'region:' || n_regionkey from nation union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey from supplier union all select 'customer:' || c_custkey, 'nation:' || c_nationkey from customer union all select 'region:1', 'nation:1'),
 r(node, depth) as (select 'region:1', 0 union select e.src, r.depth + 1 from r join e on e.dst = r.node where r.depth < 6) select node, min(depth) as depth from r group by 1""")
def impact_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that reaches a node of a graph with a cycle, with its distance."""
    edge = lambda df, a, b: df.select(F.concat(F.lit(a[0]), F.col(a[1])).alias("src"), F.concat(F.lit(b[0]), F.col(b[1])).alias("dst"))
    e = edge(_t(spark, sf_dir, "nation"), ("nation:", "n_nationkey"), ("region:", "n_regionkey")).unionByName(edge(_t(spark, sf_dir, "supplier"), ("supplier:", "s_suppkey"), ("nation:", "s_nationkey"))).unionByName(edge(_t(spark, sf_dir, "customer"), ("customer:", "c_custkey"), ("nation:", "c_nationkey")))
    e = e.unionByName(spark.range(1).select(F.lit("region:1").alias("src"), F.lit("nation:1").alias("dst")))
    return graphs.closure(e, spark.range(1).select(F.lit("region:1").alias("node")))


@_query("select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer."""
    return store.latest(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@_query("select le, n::bigint as n from (select unnest(['5', '10', '50', '100', '+Inf']) as le, unnest([sum((value <= 5)::int), sum((value <= 10)::int), sum((value <= 50)::int), sum((value <= 100)::int), count(value)]) as n from events)")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative buckets of event values."""
    return metrics.histogram(_t(spark, sf_dir, "events"), F.col("value"), (5.0, 10.0, 50.0, 100.0)).select("le", "n")


@_query("select value from (select value, row_number() over (order by value) as rn, count(*) over () as n from events where value is not null) where rn = greatest(floor(n * 0.95), 1)")
def p95_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile by index."""
    return metrics.percentile_by_index(_t(spark, sf_dir, "events"), F.col("value"))


RECORD = """
IDENTIFICATION DIVISION.
PROGRAM-ID. CUSTREC.
DATA DIVISION.
WORKING-STORAGE SECTION.
01 CUST-RECORD.
   05 C-CUSTKEY    PIC 9(8).
   05 C-ACCTBAL    PIC S9(6)V99.
   05 C-PARTS REDEFINES C-ACCTBAL.
      10 C-WHOLE   PIC X(6).
      10 C-CENTS   PIC X(2).
   05 C-MKTSEGMENT PIC X(12).
   05 FILLER       PIC X(2).
"""


@lru_cache(maxsize=2)
def _layout() -> codec.Layout:
    program: program_tree.Program = _extracted(RECORD).program
    return codec.Layout(program.dictionary)


@_query("""select c_custkey, lpad(c_custkey::varchar, 8, '0') || lpad(b[:-2], 7, '0') || case when c_acctbal < 0 then translate(b[-1:], '0123456789', 'pqrstuvwxy') else b[-1:] end || rpad(c_mktsegment, 12, ' ') || '  ' as record,
 c_acctbal::decimal(8,2)::double as acctbal, lpad(b[:-3], 6, '0') as whole from (select *, lpad((abs(c_acctbal::decimal(15,2)) * 100)::bigint::varchar, 8, '0') as b from customer)""")
def record_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to fixed-width records and back, with a second view of the balance's bytes."""
    layout = _layout()
    df = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast(MONEY).alias("c_acctbal"), "c_mktsegment")
    out = codec.encode_records(df, layout, "CUST-RECORD").select(F.col("c_custkey").alias("key"), "record")
    out = codec.decode_records(out, layout, "CUST-RECORD", "record")
    return out.select(F.col("key").alias("c_custkey"), "record", F.col("c_acctbal").cast("double").alias("acctbal"), F.col("c_whole").alias("whole"))


@_query()
def boundary_grid_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated grid, with what two rule sets decide on it."""
    pictures = {AMOUNT: pic.parse_picture("9(9)V99"), BALANCE: pic.parse_picture("S9(7)V99")}
    grid = verify.build_grid(spark, [r.conditions for r in CHAIN], pictures)
    return verify.differential(grid, CHAIN, CHAIN_B, "decision", {c: F.col(f"`{c}`") for c in grid.columns if c != "row_id"}, {"DECISION": " "}).select("row_id", "out_a", "out_b", "agree")


@_query("""with t as (select l_orderkey, l_linenumber as n, epoch(l_shipdate)::bigint // 86400 as a, epoch(l_shipdate)::bigint // 86400 + 30 as b from lineitem)
 select x.l_orderkey, x.n, y.n as m, round(greatest(0, least(x.b, y.b) - greatest(x.a, y.a) + 1) / (greatest(x.b, y.b) - least(x.a, y.a) + 1), 6) as overlap from t x join t y on x.l_orderkey = y.l_orderkey and x.n < y.n where least(x.b, y.b) >= greatest(x.a, y.a)""")
def trace_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of spans of days within an order."""
    day = F.unix_date(F.to_date("l_shipdate"))
    t = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("program"), F.col("l_linenumber").alias("n"), day.alias("line_start"), (day + 30).alias("line_end"))
    x, y = t.alias("x"), t.alias("y")
    meets = (F.col("x.program") == F.col("y.program")) & (F.col("x.n") < F.col("y.n")) & (F.col("x.line_start") <= F.col("y.line_end")) & (F.col("y.line_start") <= F.col("x.line_end"))
    return x.join(y, meets).select(F.col("x.program").alias("l_orderkey"), F.col("x.n").alias("n"), F.col("y.n").alias("m"), F.round(algebra.overlap_column("x", "y"), 6).alias("overlap"))


@_query("select c_custkey, case c_mktsegment when 'MACHINERY' then 0.9625 else 1.0 end::double as score, case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'needs_review' else 'candidate' end as status from customer")
def confidence_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores over what is measured, and where rules go."""
    none, unknown = F.array().cast("array<string>"), F.lit(None).cast("boolean")
    diff = F.when(F.col("c_mktsegment") == "MACHINERY", 0.9).when(F.col("c_mktsegment") != "BUILDING", 1.0)
    df = _t(spark, sf_dir, "customer").select("c_custkey", F.lit(1.0).alias("structural"), diff.alias("differential"), F.lit(None).cast("double").alias("consistency"), F.lit(1.0).alias("naming"), none.alias("unsupported"), none.alias("wording"), F.lit(False).alias("external_dependency"), F.lit(True).alias("reachable"), unknown.alias("satisfiable"), unknown.alias("grounded"), unknown.alias("enrichment_error"), F.lit("candidate").alias("status"))
    return verify.route(df).select("c_custkey", "score", "status")


@_query("select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') as snake from part")
def business_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snake_case names."""
    return _t(spark, sf_dir, "part").select("p_partkey", text.snake(F.col("p_name")).alias("snake"))


@_query("select change, count(*) as n, max(version) as version from (select case when a.k is null then 'new' when a.h = b.h then 'unchanged' else 'new_version' end as change, case when a.k is null then 1 when a.h = b.h then 3 else 4 end as version from (select o_orderkey as k, o_orderpriority as h from orders) b left join (select o_orderkey as k, case when o_orderstatus = 'F' then 'x' else o_orderpriority end as h from orders where o_orderpriority <> '5-LOW') a on a.k = b.k) group by 1")
def merge_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What saving does to each of many rules: the store lacks some, and has others with older content."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rule_id"), F.col("o_orderpriority").alias("content_hash"), F.lit("candidate").alias("status"), "o_orderstatus")
    old = o.filter("content_hash <> '5-LOW'").withColumn("content_hash", F.when(F.col("o_orderstatus") == "F", "x").otherwise(F.col("content_hash"))).withColumn("version", F.lit(3))
    return store.merge_versions(old, o).groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("version"))


@_query("select c_custkey from customer where c_mktsegment ilike 'build%' or c_name ilike '%0000001_'")
def visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a user's grants show."""
    grants = [{"user": "ann", "programs": ["build*"]}, {"group": "audit", "programs": ["*0000001?"]}, {"user": "bob", "programs": ["*"]}]
    return store.visible(_t(spark, sf_dir, "customer"), "ann", ["audit"], grants, "c_mktsegment", "c_name").select("c_custkey")


@_query("select event_id, list_sort(list_distinct(regexp_extract_all(lower(event_type || ' ' || props), '[a-z0-9]+')))::varchar as words, len(regexp_extract_all(props, '[0-9]+')) as numbers from events")
def words_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and numbers of a text."""
    e = _t(spark, sf_dir, "events")
    words = metrics.token_set(F.concat_ws(" ", "event_type", "props"))
    return e.select("event_id", F.concat(F.lit("["), F.array_join(F.array_sort(words), ", "), F.lit("]")).alias("words"), F.size(text.numbers(F.col("props"))).cast("long").alias("numbers"))


@_query("select part, n from (select unnest(['exact', 'f1', 'concepts', 'grounded']) as part, unnest([round(avg((a.role = b.role)::int), 6), round(avg(case when a.role = b.role then 1.0 else 0.0 end), 6), round(avg((a.role = b.role)::int), 6), round(avg((a.turn % 2 = 0)::int), 6)]) as n from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)")
def enrichment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of names against expected ones: exact, by tokens, by concepts, and grounded."""
    from edictum.functions.glossary import enrichment_scores

    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("expected_name"))
    df = c.join(nxt, ["conv_id", "turn"]).select(F.col("role").alias("name"), "expected_name", F.array("role").alias("concepts"), F.array("expected_name").alias("expected_concepts"), (F.col("turn") % 2 == 0).alias("grounded"))
    s = enrichment_scores(df)
    return s.select(F.explode(F.array(*(F.struct(F.lit(n).alias("part"), F.round(c, 6).alias("n")) for n, c in (("exact", "exact"), ("f1", "token_f1"), ("concepts", "concepts"), ("grounded", "grounded"))))).alias("r")).select("r.part", "r.n")


@_query("select user_id as key, count(*) as n, least(count(*), 120) as allowed from events group by 1")
def burst_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All requests of a user at one moment: as many as the bucket holds are allowed."""
    from edictum.streaming.limits import limit_requests

    e = _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.lit("write").alias("kind"), F.lit(0.0).alias("at"))
    return limit_requests(e).groupBy(F.col("key").cast("long").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("allowed").cast("long")).alias("allowed"))


GENERATED_SEEDS = 24


@_query(f"select {GENERATED_SEEDS}::bigint as programs, true as all_read, true as all_in_place")
def generated_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs made from specifications, read in tasks: the rules are those that were meant."""
    import random

    from edictum.plans import canon
    from edictum.sources import generator, programs

    specs = [generator.sample(f"GEN{i:03d}", random.Random(i)) for i in range(GENERATED_SEEDS)]
    rows = [(f"mem:/{s.program}.cbl", f"{s.program}.cbl", generator.render(s), None) for s in specs]
    source = spark.createDataFrame(rows, "path string, file string, content string, library array<struct<name:string,file:string,content:string>>")
    read = programs.rules_of(programs.extract_programs(source)).select("rule_id", F.sha2("document", 256).alias("h"))
    want = spark.createDataFrame([(r.rule_id, canon.rule_key(r)) for s in specs for r in generator.expected_rules(s)], "rule_id string, rule_key string")
    both = read.join(want, "rule_id", "full_outer")
    n = programs.extract_programs(source).agg(F.count_distinct("program").alias("programs"), F.max(F.size("problems")).alias("p"))
    return n.crossJoin(both.agg((F.count("h") == F.count(F.lit(1))).alias("a"), (F.count("rule_key") == F.count(F.lit(1))).alias("b"))).select("programs", (F.col("a") & (F.col("p") == 0)).alias("all_read"), F.col("b").alias("all_in_place"))
