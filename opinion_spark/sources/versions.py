"""Versions of what is stored under a path, each whole for its readers.

A version is written to a folder of its own. It counts from the moment its
manifest stands beside it: a small file of the next number, made only if there
is none, with the folder and the settings. Readers take the manifest of the
highest number that is whole, so that they see the old version or the new one
and never parts of both, and an interrupted write changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

MANIFESTS = "_versions"


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    settings: dict = field(default_factory=dict)


def new_folder(path: str) -> str:
    """Where the next version's data go; nobody reads it before ``commit``."""
    return f"{path.rstrip('/')}/data-{uuid.uuid4().hex}"


def commit(spark: SparkSession, path: str, folder: str, settings: dict | None = None) -> Version:
    """Make ``folder``, written under ``path``, its current version.

    Of two writers one gets the number, the other the next one.
    """
    text = json.dumps({"folder": folder.rstrip("/").rsplit("/", 1)[1], "settings": settings or {}})
    number = max(_numbers(spark, path), default=0) + 1
    while True:
        place, fs = _place(spark, _manifest(path, number))
        try:
            out = fs.create(place, False)
        except Py4JJavaError:
            if not fs.exists(place):
                raise
            number += 1
            continue
        out.write(bytearray(text.encode()))
        out.close()
        return Version(number, folder, settings or {})


def versions(spark: SparkSession, path: str) -> list[Version]:
    """Whole versions under ``path``, oldest first."""
    found = (_read(spark, path, n) for n in sorted(_numbers(spark, path)))
    return [v for v in found if v is not None]


def current(spark: SparkSession, path: str) -> Version | None:
    """The newest whole version; None where there is none, as in a folder written without versions."""
    for number in sorted(_numbers(spark, path), reverse=True):
        if (version := _read(spark, path, number)) is not None:
            return version
    return None


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the newest ``keep`` versions, and say how many.

    Tables that still read an older version lose it: keep as many as are
    written while one reader is at work.
    """
    if keep < 1:
        raise ValueError("the current version stays: keep must be at least 1")
    gone = versions(spark, path)[:-keep]
    for version in gone:
        for name in (_manifest(path, version.number), version.folder):
            place, fs = _place(spark, name)
            fs.delete(place, True)
    return len(gone)


def _place(spark: SparkSession, name: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifest(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/{MANIFESTS}/{number:012d}.json"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    place, fs = _place(spark, f"{path.rstrip('/')}/{MANIFESTS}")
    if not fs.exists(place):
        return []
    names = (status.getPath().getName() for status in fs.listStatus(place))
    return [int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit()]


def _read(spark: SparkSession, path: str, number: int) -> Version | None:
    """A manifest, or None while it is being written or after its deletion."""
    place, fs = _place(spark, _manifest(path, number))
    try:
        stream = fs.open(place)
    except Py4JJavaError:
        if fs.exists(place):
            raise
        return None
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        told = json.loads(text)
    except json.JSONDecodeError:
        return None
    return Version(number, f"{path.rstrip('/')}/{told['folder']}", told["settings"])
