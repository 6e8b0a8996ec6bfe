"""Publishing a set of tables as one generation: readers see all of it or none, and no writer overwrites what another did meanwhile.

A root holds folders of data, written once, and a log with a file for each version that
lists the folder of every table. A version is made by creating its file, which fails
where another writer made it first. The file system must create files exclusively: HDFS
and local disks do; an object store needs conditional writes. Reaches the file system
through the JVM, so it works in classic sessions, not over Spark Connect.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from py4j.protocol import Py4JJavaError

Tables = dict[str, DataFrame]


class Conflict(Exception):
    """Another writer published first."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _create(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file that isn't there; False if it is."""
    p, fs = _fs(spark, path)
    fs.mkdirs(p.getParent())
    try:
        if fs.getUri().getScheme() == "file":  # Hadoop's local file system looks first and creates then
            nio = spark.sparkContext._jvm.java.nio.file
            options = spark.sparkContext._gateway.new_array(nio.OpenOption, 2)
            options[0], options[1] = nio.StandardOpenOption.CREATE_NEW, nio.StandardOpenOption.WRITE
            nio.Files.write(nio.Paths.get(fs.makeQualified(p).toUri()), bytearray(content.encode()), options)
            return True
        out = fs.create(p, False)
        out.write(bytearray(content.encode()))
        out.close()
    except (Py4JJavaError, PySparkException) as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    return True


def head(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and content of the version in force; 0 and no tables where nothing is published."""
    log, fs = _fs(spark, f"{root}/log")
    numbers = sorted((int(f.getPath().getName()) for f in fs.listStatus(log) if f.getPath().getName().isdigit()), reverse=True) if fs.exists(log) else []
    for n in numbers:
        lines = spark.read.text(f"{root}/log/{n:012d}", wholetext=True).collect()
        try:
            return n, json.loads(lines[0][0])
        except (IndexError, ValueError):  # just being written
            continue
    return 0, {"generation": None, "tables": {}}


def publish(spark: SparkSession, root: str, tables: Tables, validate: Callable[[Tables], None] | None = None, after: int | None = None) -> str:
    """Write ``tables`` as a new generation below ``root``, check it whole, and make it the version in force.

    Tables that aren't given stay as they are. ``validate`` gets all tables of the new
    generation as they were written; if writing or the check fails, the version before
    stays in force. With ``after``, the number of the version that the work is based on,
    a later version of another writer raises :class:`Conflict`; without it the tables
    replace whatever is there, as one version after it.
    """
    generation = uuid.uuid4().hex[:16]
    for name, df in tables.items():
        df.write.parquet(f"{root}/generation={generation}/{name}")
    while True:
        n, base = head(spark, root)
        if after is not None and n != after:
            raise Conflict(f"version {n} was published after {after}")
        now = {**base["tables"], **{name: f"generation={generation}/{name}" for name in tables}}
        if validate:
            validate({name: spark.read.parquet(f"{root}/{path}") for name, path in now.items()})
        if _create(spark, f"{root}/log/{n + 1:012d}", json.dumps({"generation": generation, "tables": now})):
            return generation


def commit(spark: SparkSession, root: str, build: Callable[[Tables], Tables], validate: Callable[[Tables], None] | None = None, tries: int = 5) -> str:
    """Publish what ``build`` makes of the tables in force; where another writer came first, build again on what it left."""
    for left in reversed(range(tries)):
        n, base = head(spark, root)
        try:
            return publish(spark, root, build({name: spark.read.parquet(f"{root}/{path}") for name, path in base["tables"].items()}), validate, after=n)
        except Conflict:
            if not left:
                raise
    raise ValueError("tries must be positive")


def current(spark: SparkSession, root: str) -> str | None:
    """The generation in force."""
    return head(spark, root)[1]["generation"]


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the version in force."""
    n, base = head(spark, root)
    if not n:
        raise ValueError(f"nothing is published at {root}")
    return spark.read.parquet(f"{root}/{base['tables'][name]}")
