"""Small things that need the file system itself: a pointer that is replaced in one step, and removing folders.

They go through the session's Hadoop file systems, so every store that Spark reads will do.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str) -> JavaObject:
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str) -> JavaObject:
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, path: str, value: dict[str, Any]) -> None:
    """Make ``value`` the content of the pointer ``path``. A reader finds the old content or the new, never a part.

    On stores without a rename that replaces, this holds as far as their rename does.
    """
    system, made = _system(spark, path), f"{path}.{uuid.uuid4().hex}"
    out = system.create(_path(spark, made), False)
    try:
        out.write(bytearray(json.dumps(value).encode()))
    finally:
        out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(_path(spark, made), _path(spark, path), options)


def pointed(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """The content of a pointer, None where none was published."""
    system = _system(spark, path)
    if not system.exists(_path(spark, path)):
        return None
    data = system.open(_path(spark, path))
    try:
        return json.loads(bytes(data.readAllBytes()))
    finally:
        data.close()


def _names(spark: SparkSession, path: str, of_folders: bool) -> list[str]:
    system = _system(spark, path)
    if not system.exists(_path(spark, path)):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(_path(spark, path)) if s.isDirectory() == of_folders)


def folders(spark: SparkSession, path: str, name: str) -> list[str]:
    """Values of the partition folders ``<name>=<value>`` directly below a folder; all folders' names without a name."""
    start = f"{name}=" if name else ""
    return [f.removeprefix(start) for f in _names(spark, path, True) if f.startswith(start)]


def files(spark: SparkSession, path: str) -> list[str]:
    return _names(spark, path, False)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file; the target's folder is made if it is missing."""
    system = _system(spark, source)
    system.mkdirs(_path(spark, target).getParent())
    if not system.rename(_path(spark, source), _path(spark, target)):
        raise OSError(f"cannot move {source} to {target}")


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder or file that a job made or replaced; a missing one is no error."""
    _system(spark, path).delete(_path(spark, path), True)
