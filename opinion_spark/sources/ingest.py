"""Review files parsed once: a Parquet copy that later sessions read instead."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from opinion_spark.sources.reviews import read_reviews
from opinion_spark.sources.versions import commit, current, drop_versions, new_folder


def ingest_reviews(spark: SparkSession, path: str, store: str, keep: int = 2, **options) -> DataFrame:
    """The table that ``read_reviews(spark, path, **options)`` gives, from its copy under ``store``.

    The copy counts as long as the files' names, sizes and times and the
    options are those it was made with; otherwise the files are parsed anew
    into the next version, and who reads the old one goes on with it. Files
    that change while they are parsed make no version and fail. Different options
    have copies of their own. The newest ``keep`` versions of each stay.
    """
    told = json.dumps(options, sort_keys=True, default=lambda v: v.json() if isinstance(v, T.DataType) else list(v))
    place = f"{store.rstrip('/')}/{hashlib.sha256(json.dumps([path, told]).encode()).hexdigest()[:32]}"
    files = fingerprint(spark, path)
    version = current(spark, place)
    if version is None or version.settings["files"] != files:
        folder = new_folder(place)
        read_reviews(spark, path, **options).write.parquet(folder)
        if fingerprint(spark, path) != files:
            raise RuntimeError(f"{path} changed while it was read")
        version = commit(spark, place, folder, {"files": files, "path": path, "options": told})
        drop_versions(spark, place, keep)
    return spark.read.parquet(version.folder)


def fingerprint(spark: SparkSession, path: str) -> str:
    """One digest of names, sizes and times of the files that ``path``, a file, folder or pattern, stands for."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(place)
    if not found:
        raise FileNotFoundError(path)
    seen = []
    for status in found:
        files = fs.listFiles(status.getPath(), True)
        while files.hasNext():
            file = files.next()
            name = file.getPath().toString()
            # As Spark's readers do: names that begin so hold no rows.
            if not file.getPath().getName().startswith(("_", ".")):
                seen.append((name, file.getLen(), file.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(seen)).encode()).hexdigest()
