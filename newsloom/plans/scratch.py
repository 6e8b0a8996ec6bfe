"""Intermediate tables in the folder that the driver and all executors share.

Iterative plans cut their lineage here: a lost executor costs a re-read, not a
recomputation, and no block lives on one machine only.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """URI of this application's folder below ``spark.checkpoint.dir``.

    The setting is read from the session. Only where it is unset, as in tests on
    one machine, a temporary folder is made and set.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='spark-newsloom-')}"
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(base)
        _ROOTS[sc.applicationId] = root = f"{base.rstrip('/')}/newsloom-{sc.applicationId}"
        atexit.register(_remove, spark, root)
    return _ROOTS[sc.applicationId]


def _remove(spark: SparkSession, root: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    df.write.parquet(path := scratch_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)
