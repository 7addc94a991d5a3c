"""Exports of very many rule sets: a file a set, written in tasks, and a manifest of them.

A set's file is made from its rules in one task, which writes it under a name of its own and renames it when it is
whole, so a lost executor leaves no half file behind and a repeated task does no harm. Tasks write and read the files by
path: the driver lists, renames and plans none of them. Files are opened by Arrow's file systems (local, HDFS, object stores);
below a path that only a Spark connector can open, Spark's own writer and reader serve. The manifest tells each file's size
and digest; files that are missing or not what was written show when they are read back.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edictum.operators import export
from edictum.plans.ir import rule_from
from edictum.shipping import ship_package
from edictum.workspace import materialize, spread

KINDS = ("json", "trees", "pmml", "dmn")
#: Characters of texts that a task holds before it hands them on.
HELD = 1 << 24
#: What folder names of a partition column write as % and a code.
_ESCAPED = re.compile(r"""[\x00-\x1f\x7f"#%'*/:=?\\{\[\]^]""")
_SETS = pa.schema([("rule_set", pa.string()), ("rules", pa.int64()), ("content", pa.string()), ("problems", pa.list_(pa.string()))])
_MANIFEST = pa.schema([("rule_set", pa.string()), ("rules", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("problems", pa.list_(pa.string()))])
_READ = pa.schema([("rule_set", pa.string()), ("content", pa.string()), ("whole", pa.bool_())])


def _content(kind: str, rules: list) -> tuple[str, list[str]]:
    """A file's text, and what is wrong with it."""
    if kind == "json":
        return export.to_json(rules), []
    if kind == "trees":
        return json.dumps(export.to_tree_json(rules), default=str), []
    text, skipped = (export.to_pmml if kind == "pmml" else export.to_dmn)(rules)
    return text, [*skipped, *(export.validate(text, kind) if text else ["nothing can be expressed"])]


def _sets(rules: DataFrame, kind: str) -> DataFrame:
    """``rule_set`` and ``documents``, in order, a row a set."""
    if kind not in KINDS:
        raise ValueError(f"unknown export {kind!r}")
    ship_package(rules.sparkSession)
    named = rules.filter("rule_set is not null and document is not null").select(F.col("rule_set").cast("string"), "seq", F.col("document").cast("string"))
    own = F.array_sort(F.collect_list(F.struct(F.col("seq").isNull().alias("last"), "seq", "document")))
    return spread(named, "rule_set").groupBy("rule_set").agg(F.transform(own, lambda x: x["document"]).alias("documents"))


def _made(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[str, int, str, list[str]]]:
    """Of each set in a batch its name, number of rules, text and problems."""
    for name, docs in zip(batch.column(0), batch.column(1)):
        own = docs.as_py()
        yield name.as_py(), len(own), *_content(kind, [rule_from(json.loads(d)) for d in own])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _in_parts(rows: Iterator[tuple], schema: pa.Schema, at: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches that hold HELD characters of a column about."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[at] or "")
        if size > HELD:
            yield _batch(held, schema)
            held, size = [], 0
    yield _batch(held, schema)


def contents(rules: DataFrame, kind: str) -> DataFrame:
    """``rule_set``, ``rules`` (their number), ``content`` and ``problems`` for each set of a table of rule_set, seq and document (JSON).

    Rules are in the order of seq, then of their document. A set is made in one task: a file holds it whole. Null sets and documents are left out.
    """
    return _sets(rules, kind).mapInArrow(lambda batches: (b for batch in batches for b in _in_parts(_made(batch, kind), _SETS, 2)), "rule_set string, rules long, content string, problems array<string>")


def _folder(path: str, name: str) -> str:
    """A set's folder, as Spark names folders of a partition column."""
    return f"{path}/files/rule_set={_ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', name)}"


def _opened(path: str) -> tuple[pa.fs.FileSystem, str] | None:
    """Arrow's file system of a path, and the path in it; None if it has none."""
    try:
        return (pa.fs.LocalFileSystem(), path) if path.startswith("/") else pa.fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError):
        return None


def _absolute(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Spark understands it; local ones without."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(where)
    return full.toUri().getPath() if full.toUri().getScheme() == "file" else full.toString()


def write_files(rules: DataFrame, path: str, kind: str) -> DataFrame:
    """Write a file a set below ``path``/files and the manifest to ``path``/manifest, which is returned: rule_set, rules, bytes, sha256, problems."""
    spark = rules.sparkSession
    at = _absolute(spark, path)
    if _opened(at) is None:
        made = materialize(contents(rules, kind), "exports", "zstd")
        made.select("rule_set", "content").write.partitionBy("rule_set").mode("overwrite").text(f"{path}/files")
        whole = F.concat("content", F.lit("\n"))  # the writer ends a text with a new line
        manifest = made.select("rule_set", "rules", F.octet_length(whole).cast("long").alias("bytes"), F.sha2(whole, 256).alias("sha256"), "problems")
    else:
        sets = _sets(rules, kind)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/files")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)  # files of an earlier export

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = _opened(at)
            for batch in batches:
                rows = []
                for name, n, text, problems in _made(batch, kind):
                    data = text.encode() + b"\n"
                    folder = _folder(root, name)
                    fs.create_dir(folder, recursive=True)
                    part = f"{folder}/.{uuid.uuid4().hex}"
                    with fs.open_output_stream(part) as out:
                        out.write(data)
                    fs.move(part, f"{folder}/part-0.txt")
                    rows.append((name, n, len(data), hashlib.sha256(data).hexdigest(), problems))
                yield _batch(rows, _MANIFEST)

        manifest = sets.mapInArrow(write, "rule_set string, rules long, bytes long, sha256 string, problems array<string>")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``rule_set``, ``content`` and ``whole`` (as the manifest has it) of every set in the manifest; content is null where there is no file."""
    at = _absolute(spark, path)
    manifest = spark.read.parquet(f"{path}/manifest").select("rule_set", "sha256")
    if _opened(at) is None:
        files = spark.read.schema("content string, rule_set string").text(f"{path}/files", wholetext=True)
        met = manifest.join(files, "rule_set", "left")
        return met.select("rule_set", "content", F.coalesce(F.sha2("content", 256) == F.col("sha256"), F.lit(False)).alias("whole"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(at)

        def each(batch: pa.RecordBatch) -> Iterator[tuple[str, str | None, bool]]:
            for name, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with fs.open_input_file(f"{_folder(root, name)}/part-0.txt") as f:
                        data = f.read()
                except FileNotFoundError:
                    yield name, None, False
                else:
                    yield name, data.decode(errors="replace"), hashlib.sha256(data).hexdigest() == digest

        for batch in batches:
            yield from _in_parts(each(batch), _READ, 1)

    ship_package(spark)
    return spread(manifest, "rule_set").mapInArrow(read, "rule_set string, content string, whole boolean")
