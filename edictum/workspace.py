"""Where intermediate tables and files go: the folder that all executors share.

A written table cuts lineage (a lost executor costs a re-read, not a re-run) and gives the
optimizer true sizes. The folder is the one named in ``spark.checkpoint.dir``. Only in a session
on one machine, as in tests, is a temporary folder made where that is unset; on a cluster the
executors could not read it, so there it is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, without a slash at the end. Raises RuntimeError on a cluster that names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="edictum-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _delete(sc: SparkContext, path: str) -> None:
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses yet, in a folder of the application that goes when the driver ends."""
    sc = spark.sparkContext
    own = f"{shared_dir(spark)}/edictum/{sc.applicationId}"
    if getattr(sc, "_edictum_folder", None) != own:
        sc._edictum_folder = own

        def clean() -> None:
            with contextlib.suppress(Exception):  # the JVM may have ended first
                _delete(sc, own)

        atexit.register(clean)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt out by a hash of columns over all cores, for work that is heavy a row: a small file may be one part."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, by the session's compression or another, and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._edictum_path = path
    return out


def materialize_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The same, with the number of rows, which the writing job counts."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def discard(df: DataFrame | None) -> None:
    """Delete a materialized table that nothing will read again."""
    path = getattr(df, "_edictum_path", None)
    if path:
        _delete(df.sparkSession.sparkContext, path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows; else as it is, so that the join shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
