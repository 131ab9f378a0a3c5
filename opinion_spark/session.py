"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "opinion-spark", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """A session with adaptive execution on; ``conf`` wins over the defaults here.

    Shuffle partitions are left to the cluster's own setting, which adaptive
    execution coalesces at run time.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **(conf or {}),
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def reach_workers(spark: SparkSession) -> None:
    """Let local Python workers import this package; on a cluster it is installed or sent with --py-files."""
    context = spark.sparkContext
    if context.master.startswith("local"):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        known = context.environment.get("PYTHONPATH", "")
        if root not in known.split(os.pathsep):
            context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder, with a
    warning; on a cluster a machine-local folder would lose staged tables with
    its executor, so the setting is required there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="opinion-spark-")
    warnings.warn(f"spark.checkpoint.dir is not set; staged tables go to {folder}", stacklevel=2)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_staged: dict[tuple[str, int], list[str]] = {}


def _own(spark: SparkSession) -> list[str]:
    """What this thread has staged: others may stage and drop theirs meanwhile."""
    return _staged.setdefault((spark.sparkContext.applicationId, threading.get_ident()), [])


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Used where several jobs read the same costly result: the table outlives
    lost executors, cuts the lineage and keeps column pruning and pushdown. It
    stays until ``drop_staged``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    _own(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_paths(spark: SparkSession) -> list[str]:
    """Tables that this thread of the application has staged and not dropped, oldest first."""
    return list(_own(spark))


def drop_staged(spark: SparkSession, since: int = 0, until: int | None = None) -> int:
    """Delete the staged tables from number ``since`` of ``staged_paths`` on, and say how many.

    ``until``: up to that number, -1: all but the last.

    For a caller that has written or collected its result: results that are
    still lazy may read them.
    """
    paths = _own(spark)
    gone, paths[since:until] = paths[since:until], []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in gone:
        place = hadoop(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(gone)
