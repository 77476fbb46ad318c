"""Small texts in a folder that driver and executors share: listed, read, and created by exactly one writer."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names in a folder; none where it isn't there."""
    p, fs = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def age_hours(spark: SparkSession, path: str) -> float:
    p, fs = _at(spark, path)
    return (spark._jvm.java.lang.System.currentTimeMillis() - fs.getFileStatus(p).getModificationTime()) / 3_600_000


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with a text, whole or not at all; False if it is there already.

    The text is written beside it and moved to its name, which the file system
    refuses where the name is taken.  A local one replaces the file instead, so
    there the name is a second link to it, which can be made only once.
    """
    folder, _, name = path.rpartition("/")
    temporary = f"{folder}/_{name}-{uuid.uuid4().hex}"
    p, fs = _at(spark, temporary)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    to, _ = _at(spark, path)
    if fs.getUri().getScheme() != "file":
        moved = not fs.exists(to) and fs.rename(p, to)
        if not moved:
            fs.delete(p, False)
        return moved
    local = lambda x: spark._jvm.java.io.File(x.toUri().getPath()).toPath()
    try:
        spark._jvm.java.nio.file.Files.createLink(local(to), local(p))
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception):
            raise
        return False
    finally:
        fs.delete(p, False)
