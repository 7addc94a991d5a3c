"""A versioned store of rules as Parquet tables: saving, reviewing, auditing, searching who may see what.

Each table is a sequence of snapshots in numbered folders; a change is a plan over the last
snapshot, written to the next one, and readers always see a whole snapshot. Reviews are an
append-only log whose rows hold the hash of the row before, so it is verified row by row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edictum.operators.ordered import previous
from edictum.plans.ir import Rule, rule_from

#: States from which an action is allowed; fields that an edit can't change; the first hash.
ALLOWED = {"approve": ("candidate", "needs_review"), "reject": ("candidate", "needs_review", "approved"), "edit": ("candidate", "needs_review", "approved", "rejected")}
PROTECTED = ("rule_id", "version", "trace", "provenance", "status", "confidence")
GENESIS = "0" * 64
CONTENT = ("title", "intent", "domain", "conditions", "actions", "else_actions", "context", "derivations", "lookup", "concepts")

SCHEMAS = {
    "programs": "id string, name string, program_file string, files string, sha256 string, status string, report string, created_at timestamp",
    "rules": "rule_id string, version int, program_id string, document string, status string, confidence double, concepts array<string>, domain string, title string, content_hash string, created_at timestamp, is_latest boolean",
    "reviews": "id bigint, rule_id string, version int, action string, reason string, user string, changes string, ts string, prev_hash string, hash string",
    "approvals": "rule_id string, version int, user string, ts timestamp",
    "assignments": "rule_id string, assignee string, assigned_by string, ts timestamp",
    "comments": "id bigint, rule_id string, version int, user string, text string, ts timestamp",
    "notifications": "id bigint, user string, kind string, rule_id string, text string, ts timestamp, read boolean",
    "jobs": "id string, program_id string, state string, stage string, slices_total int, slices_done int, error string, created_at timestamp, updated_at timestamp",
    "embeddings": "rule_id string, content_hash string, vector array<float>, ts timestamp",
}


class StoreError(ValueError):
    """What the store refuses; ``code`` names the reason."""

    def __init__(self, code: str, text: str):
        super().__init__(text)
        self.code = code


def content_hash(rule: Rule) -> str:
    """Hash of what a rule says, apart from its state."""
    d = rule.document()
    return hashlib.sha256(json.dumps({k: d.get(k) for k in CONTENT}, sort_keys=True, default=str).encode()).hexdigest()


def link_hash(prev: Column, payload: Column) -> Column:
    """Hash of a log row after the one before."""
    return F.sha2(F.concat(prev, payload), 256)


def verify_chain(log: DataFrame, order: str, payload: Column, prev: str = "prev_hash", own: str = "hash", genesis: str = GENESIS) -> DataFrame:
    """``entries``, ``ok``, ``broken_at`` (the first row that doesn't fit). Every row is checked by itself; only the link looks one row back."""
    linked = previous(log, order, own, "__before")
    bad = (F.col(prev) != F.coalesce("__before", F.lit(genesis))) | (F.col(own) != link_hash(F.col(prev), payload))
    return linked.agg(F.count(F.lit(1)).alias("entries"), F.min(F.when(bad, F.col(order))).alias("broken_at")).withColumn("ok", F.col("broken_at").isNull())


def merge_versions(latest: DataFrame, incoming: DataFrame) -> DataFrame:
    """What saving does with each rule: new, unchanged (keeps version and decision) or new_version (supersedes an approved one).

    ``latest``: the current version of each rule; ``incoming``: rule_id, content_hash and state.
    """
    a = latest.select(F.col("rule_id").alias("__id"), F.col("version").alias("old_version"), F.col("content_hash").alias("old_hash"), F.col("status").alias("old_status"))
    j = incoming.join(a, F.col("rule_id") == F.col("__id"), "left")
    kind = F.when(F.col("__id").isNull(), "new").when(F.col("old_hash") == F.col("content_hash"), "unchanged").otherwise("new_version")
    version = F.when(kind == "unchanged", F.col("old_version")).otherwise(F.coalesce("old_version", F.lit(0)) + 1)
    status = F.when((kind == "unchanged") & F.col("old_status").isin("approved", "rejected"), F.col("old_status")).otherwise(F.col("status"))
    return j.withColumns({"change": kind, "version": version, "status": status, "supersedes": (kind == "new_version") & (F.col("old_status") == "approved")}).drop("__id", "old_version", "old_hash", "old_status")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("__n = 1").drop("__n")


def glob_pattern(pattern: str) -> str:
    """A shell pattern as a regular expression that ignores letter case."""
    import fnmatch

    return "(?is)" + fnmatch.translate(pattern).replace("(?s:", "(?:").replace(r"\Z", "$").replace(r"\z", "$")


def visible(df: DataFrame, user: str, groups: Iterable[str], grants: list[dict[str, Any]] | None, *names: str) -> DataFrame:
    """Rows of which a name matches what the user is granted; without a list of grants, or with ``*``, all."""
    if grants is None:
        return df
    mine = {user, *groups}
    patterns = [p for g in grants if g.get("user") in mine or g.get("group") in mine for p in g.get("programs", ())]
    if "*" in patterns:
        return df
    hit = F.lit(False)
    for p in patterns:
        for n in names:
            hit = hit | F.coalesce(F.col(n).rlike(glob_pattern(p)), F.lit(False))
    return df.filter(hit)


class RuleStore:
    """The store in a folder that Spark can write to. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, approvals: int = 1):
        self.spark, self.path, self.approvals = spark, path.rstrip("/"), approvals

    def _fs(self, path: str) -> tuple[Any, Any]:
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def _snapshot(self, name: str) -> int:
        fs, p = self._fs(f"{self.path}/{name}")
        numbers = [int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit() and fs.exists(self._fs(f"{self.path}/{name}/{s.getPath().getName()}/_SUCCESS")[1])] if fs.exists(p) else []
        return max(numbers, default=-1)

    def table(self, name: str) -> DataFrame:
        """A table as it is now."""
        n = self._snapshot(name)
        return self.spark.createDataFrame([], SCHEMAS[name]) if n < 0 else self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}/{n}")

    def _put(self, name: str, df: DataFrame) -> None:
        cols = self.spark.createDataFrame([], SCHEMAS[name]).columns
        df.select(*cols).write.mode("overwrite").parquet(f"{self.path}/{name}/{self._snapshot(name) + 1}")

    def _append(self, name: str, rows: list[tuple]) -> None:
        # files are added to the table as it is: nothing that is there is read or written again
        self.spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}/{max(self._snapshot(name), 0)}")

    @staticmethod
    def _now() -> datetime:
        return datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0)

    # programs and rules
    def add_program(self, program_id: str, name: str, file: str, files: dict[str, str]) -> None:
        """Keep a program's sources with their hash."""
        text = json.dumps(files, sort_keys=True)
        self._append("programs", [(program_id, name, file, text, hashlib.sha256(text.encode()).hexdigest(), "uploaded", None, self._now())])

    def programs(self) -> DataFrame:
        """Programs, the newest first."""
        return self.table("programs").orderBy(F.desc("created_at"), "id")

    def save_rules(self, program_id: str, rules: list[Rule]) -> dict[str, int]:
        """Save rules; how many are new, unchanged and new versions."""
        rows = [(r.rule_id, content_hash(r), r.status, json.dumps(r.document(), default=str), r.confidence.get("score"), list(r.concepts), r.domain, r.title) for r in rules]
        incoming = self.spark.createDataFrame(rows, "rule_id string, content_hash string, status string, document string, confidence double, concepts array<string>, domain string, title string")
        now = self.table("rules")
        merged = merge_versions(now.filter("is_latest"), incoming).withColumn("program_id", F.lit(program_id)).withColumn("is_latest", F.lit(True)).withColumn("created_at", F.lit(self._now())).cache()
        touched = merged.select("rule_id", "change", "version", F.col("supersedes").alias("sup"))
        kept = now.join(touched.withColumnRenamed("version", "__v"), "rule_id", "left").filter("not (is_latest and change = 'unchanged') or change is null")
        kept = kept.withColumn("status", F.when(F.col("is_latest") & F.coalesce("sup", F.lit(False)), "superseded").otherwise(F.col("status"))).withColumn("is_latest", F.col("is_latest") & F.col("change").isNull())
        counts = {r["change"]: r["count"] for r in merged.groupBy("change").count().collect()}
        self._put("rules", kept.select(*now.columns).unionByName(merged.select(*now.columns)))
        merged.unpersist()
        return {k: counts.get(k, 0) for k in ("new", "unchanged", "new_version")}

    def latest_rules(self, program: str | None = None, status: str | None = None, domain: str | None = None, min_confidence: float | None = None, concept: str | None = None) -> DataFrame:
        """Current rules by optional filters, by rule_id; a missing confidence counts as 0."""
        p = self.table("programs").select(F.col("id").alias("program_id"), "name", "program_file")
        out = self.table("rules").filter("is_latest").join(p, "program_id")
        if program:
            out = out.filter((F.col("program_id") == program) | (F.col("program_file") == program) | (F.col("name") == program) | F.col("rule_id").startswith(f"{program.partition('.')[0]}-R"))
        if status:
            out = out.filter(F.col("status") == status)
        if domain:
            out = out.filter(F.col("domain") == domain)
        if min_confidence is not None:
            out = out.filter(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
        if concept:
            out = out.filter(F.exists("concepts", lambda x: F.lower(x).contains(concept.lower())))
        return out.orderBy("rule_id")

    def rule(self, rule_id: str, version: int | None = None) -> tuple[Rule, dict[str, Any]]:
        """A rule and its row."""
        df = self.table("rules").filter(F.col("rule_id") == rule_id)
        row = df.filter(F.col("is_latest") if version is None else F.col("version") == version).first()
        if row is None:
            raise StoreError("RULE_NOT_FOUND", f"no rule {rule_id}")
        return rule_from(json.loads(row["document"])), row.asDict()

    def stats(self) -> DataFrame:
        """Current rules by status."""
        return self.table("rules").filter("is_latest").groupBy("status").count().orderBy("status")

    def history(self, rule_id: str) -> DataFrame:
        """Versions with their reviews, in order."""
        log = self.table("reviews").groupBy("rule_id", "version").agg(F.array_sort(F.collect_list(F.struct("id", "action", "user", "reason", "ts"))).alias("reviews"))
        return self.table("rules").filter(F.col("rule_id") == rule_id).join(log, ["rule_id", "version"], "left").orderBy("version")

    # reviews
    def _log(self, rule_id: str, version: int, action: str, reason: str, user: str, changes: dict[str, Any]) -> None:
        self._log_all([(rule_id, version, action, reason, user, changes)])

    def _log_all(self, entries: list[tuple[str, int, str, str, str, dict[str, Any]]]) -> None:
        last = self.table("reviews").agg(F.max_by("hash", "id").alias("h"), F.max("id").alias("i")).first()
        number, prev, ts, rows = last["i"] or 0, last["h"] or GENESIS, self._now().isoformat(), []
        for rule_id, version, action, reason, user, changes in entries:
            text = json.dumps(changes, sort_keys=True)
            own = hashlib.sha256((prev + "|".join([rule_id, str(version), action, reason, user, text, ts])).encode()).hexdigest()
            number += 1
            rows.append((number, rule_id, version, action, reason, user, text, ts, prev, own))
            prev = own
        if rows:
            self._append("reviews", rows)

    def verify_audit(self) -> dict[str, Any]:
        """Whether the log is whole, and where it breaks."""
        payload = F.concat_ws("|", "rule_id", F.col("version").cast("string"), "action", "reason", "user", "changes", "ts")
        return verify_chain(self.table("reviews"), "id", payload).first().asDict()

    def audit_log(self, limit: int = 100) -> DataFrame:
        """The newest entries."""
        return self.table("reviews").orderBy(F.desc("id")).limit(limit)

    def review(self, rule_id: str, action: str, reason: str, user: str, changes: dict[str, Any] | None = None) -> Rule:
        """Approve, reject or edit the current version."""
        if action not in ALLOWED:
            raise StoreError("INVALID_REQUEST", f"unknown action {action!r}")
        rule, row = self.rule(rule_id)
        if row["status"] not in ALLOWED[action]:
            raise StoreError("INVALID_STATE", f"a rule that is {row['status']} can't be {action}ed")
        rules, version, log = self.table("rules"), row["version"], dict(changes or {})
        this = (F.col("rule_id") == rule_id) & (F.col("version") == version)
        if action == "edit":
            if not changes or set(changes) & set(PROTECTED):
                raise StoreError("INVALID_REQUEST", f"an edit needs changes, and not of {', '.join(PROTECTED)}")
            status = "needs_review" if row["status"] in ("approved", "rejected") else row["status"]
            rule = rule_from(rule.document() | changes | {"version": version + 1, "status": status, "provenance": rule.provenance | {"edited_by": user}})
            new = self.spark.createDataFrame([(rule_id, version + 1, row["program_id"], json.dumps(rule.document(), default=str), status, row["confidence"], list(rule.concepts), rule.domain, rule.title, content_hash(rule), self._now(), True)], SCHEMAS["rules"])
            self._put("rules", rules.withColumn("is_latest", F.col("is_latest") & ~this).unionByName(new))
            version += 1
        else:
            status: str | None = "rejected"
            if action == "approve":
                if rule.provenance.get("edited_by") == user:
                    raise StoreError("SELF_APPROVAL", "who edited a rule can't approve it")
                done = self.table("approvals").filter((F.col("rule_id") == rule_id) & (F.col("version") == version))
                if done.filter(F.col("user") == user).count():
                    raise StoreError("ALREADY_APPROVED", f"{user} has approved version {version}")
                self._append("approvals", [(rule_id, version, user, self._now())])
                have = self.table("approvals").filter((F.col("rule_id") == rule_id) & (F.col("version") == version)).agg(F.count_distinct("user")).first()[0]
                log["approvals"] = f"{have}/{self.approvals}"
                status = "approved" if have >= self.approvals else None
            if status:
                rule = rule.with_(status=status)
                self._put("rules", rules.withColumn("document", F.when(this, F.lit(json.dumps(rule.document(), default=str))).otherwise(F.col("document"))).withColumn("status", F.when(this, status).otherwise(F.col("status"))))
        self._log(rule_id, version, action, reason, user, log)
        return rule

    def bulk_review(self, rule_ids: list[str], action: str, reason: str, user: str) -> dict[str, str]:
        """Approve or reject up to 500 rules, in one write; for each ``ok`` or the reason it was refused."""
        if len(rule_ids) > 500:
            raise StoreError("INVALID_REQUEST", "at most 500 rules at once")
        if action == "edit":
            raise StoreError("INVALID_REQUEST", "edits are made one by one")
        if action not in ALLOWED:
            raise StoreError("INVALID_REQUEST", f"unknown action {action!r}")
        asked = list(dict.fromkeys(rule_ids))
        rules = self.table("rules")
        rows = {r["rule_id"]: r for r in rules.filter(F.col("is_latest") & F.col("rule_id").isin(asked)).collect()}
        approvers: dict[tuple[str, int], set[str]] = {}
        for r in self.table("approvals").filter(F.col("rule_id").isin(asked)).collect():
            approvers.setdefault((r["rule_id"], r["version"]), set()).add(r["user"])
        out, changed, approved, log = {}, [], [], []
        for rule_id in asked:
            row, changes, status = rows.get(rule_id), {}, "rejected"
            rule = rule_from(json.loads(row["document"])) if row else None
            have = approvers.get((rule_id, row["version"]), set()) if row else set()
            if row is None:
                out[rule_id] = "RULE_NOT_FOUND"
            elif row["status"] not in ALLOWED[action]:
                out[rule_id] = "INVALID_STATE"
            elif action == "approve" and rule.provenance.get("edited_by") == user:
                out[rule_id] = "SELF_APPROVAL"
            elif action == "approve" and user in have:
                out[rule_id] = "ALREADY_APPROVED"
            else:
                out[rule_id] = "ok"
                if action == "approve":
                    approved.append((rule_id, row["version"], user, self._now()))
                    changes["approvals"] = f"{len(have) + 1}/{self.approvals}"
                    status = "approved" if len(have) + 1 >= self.approvals else None
                if status:
                    changed.append((rule_id, row["version"], status, json.dumps(rule.with_(status=status).document(), default=str)))
                log.append((rule_id, row["version"], action, reason, user, changes))
        if approved:
            self._append("approvals", approved)
        if changed:  # at most 500 rows, so one write serves all
            new = F.broadcast(self.spark.createDataFrame(changed, "rule_id string, version int, new_status string, new_document string"))
            now = rules.join(new, ["rule_id", "version"], "left")
            self._put("rules", now.withColumn("status", F.coalesce("new_status", "status")).withColumn("document", F.coalesce("new_document", "document")))
        self._log_all(log)
        return out

    def review_queue(self, assignee: str | None = None) -> DataFrame:
        """Rules to review, the least sure first."""
        a = latest(self.table("assignments"), "rule_id", "ts").select("rule_id", "assignee")
        out = self.table("rules").filter("is_latest and status in ('candidate', 'needs_review')").join(a, "rule_id", "left")
        out = out.filter(F.col("assignee") == assignee) if assignee else out
        return out.orderBy(F.coalesce("confidence", F.lit(0.0)), "rule_id")

    # people
    def _notify(self, users: Iterable[str], kind: str, rule_id: str, text: str) -> None:
        last = self.table("notifications").agg(F.max("id")).first()[0] or 0
        rows = [(last + i, u, kind, rule_id, text, self._now(), False) for i, u in enumerate(sorted(users), 1)]
        if rows:
            self._append("notifications", rows)

    def assign(self, rule_id: str, assignee: str, by: str) -> None:
        """Give a rule to somebody; the last assignment counts."""
        _, row = self.rule(rule_id)
        self._put("assignments", self.table("assignments").filter(F.col("rule_id") != rule_id).unionByName(self.spark.createDataFrame([(rule_id, assignee, by, self._now())], SCHEMAS["assignments"])))
        self._log(rule_id, row["version"], "assign", "", by, {"assignee": assignee})
        self._notify({assignee} - {by}, "assigned", rule_id, f"{by} assigned {rule_id} to you")

    def add_comment(self, rule_id: str, user: str, text: str) -> None:
        """Comment on a rule; assignee and earlier commenters hear of it."""
        _, row = self.rule(rule_id)
        involved = self.table("comments").filter(F.col("rule_id") == rule_id).select("user").union(self.table("assignments").filter(F.col("rule_id") == rule_id).select("assignee")).distinct()
        users = {r[0] for r in involved.collect()} - {user}
        last = self.table("comments").agg(F.max("id")).first()[0] or 0
        self._append("comments", [(last + 1, rule_id, row["version"], user, text, self._now())])
        self._notify(users, "comment", rule_id, f"{user} commented on {rule_id}")

    def notifications(self, user: str, unread_only: bool = False) -> DataFrame:
        """The newest 200."""
        out = self.table("notifications").filter(F.col("user") == user)
        return (out.filter("not read") if unread_only else out).orderBy(F.desc("id")).limit(200)

    def mark_read(self, notification: int) -> None:
        """Mark a notification as read."""
        self._put("notifications", self.table("notifications").withColumn("read", F.col("read") | (F.col("id") == notification)))

    # upkeep
    def put_embedding(self, rule_id: str, content: str, vector: list[float]) -> None:
        """Keep the vector of a rule's content; the last one counts."""
        old = self.table("embeddings").filter((F.col("rule_id") != rule_id) | (F.col("content_hash") != content))
        self._put("embeddings", old.unionByName(self.spark.createDataFrame([(rule_id, content, [float(v) for v in vector], self._now())], SCHEMAS["embeddings"])))

    def update_job(self, job: str, **values: Any) -> None:
        """Begin or change a background job's row."""
        jobs = self.table("jobs")
        old = jobs.filter(F.col("id") == job).first()
        base = old.asDict() if old else dict.fromkeys(jobs.columns) | {"id": job, "created_at": self._now()}
        row = base | values | {"updated_at": self._now()}
        self._put("jobs", jobs.filter(F.col("id") != job).unionByName(self.spark.createDataFrame([tuple(row[c] for c in jobs.columns)], SCHEMAS["jobs"])))

    def purge(self, jobs_days: int, notifications_days: int) -> dict[str, int]:
        """Delete finished jobs and notifications older than so many days; how many of each."""
        out = {}
        for name, days, keep in (("jobs", jobs_days, ~F.col("state").isin("done", "failed")), ("notifications", notifications_days, F.lit(False))):
            df = self.table(name)
            at = F.col("updated_at" if name == "jobs" else "ts")
            kept = df.filter(F.coalesce(keep, F.lit(True)) | (at >= F.current_timestamp() - F.make_dt_interval(F.lit(days))))
            out[name] = df.count() - kept.count()
            self._put(name, kept)
        return out

    def backup(self, target: str) -> dict[str, Any]:
        """Copy all tables as they are now, count them there, and verify the log."""
        counts = {}
        for name in SCHEMAS:
            self.table(name).write.mode("overwrite").parquet(f"{target}/{name}/0")
            counts[name] = self.spark.read.schema(SCHEMAS[name]).parquet(f"{target}/{name}/0").count()
        same = all(counts[n] == self.table(n).count() for n in SCHEMAS)
        return {"rows": counts, "complete": same, "audit": RuleStore(self.spark, target).verify_audit()}
