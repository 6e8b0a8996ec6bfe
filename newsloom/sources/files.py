"""Texts as files of given names, written by tasks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_files(files: DataFrame, folder: str) -> int:
    """Write ``files (file, content)`` into a folder that all executors share; the number of files.

    A name counts once, with the least content of several, and replaces a file that is
    there. Each file is written under another name and moved, so that a lost task
    leaves no half of one, and a repeated one the same. Null names are left out.
    """
    once = files.where("file is not null").groupBy("file").agg(F.coalesce(F.min("content"), F.lit("")).alias("content"))

    def write(batches):
        import pyarrow.fs as pafs
        from pyspark import TaskContext

        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        mark = TaskContext.get().taskAttemptId()
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_output_stream(f"{base}/.{name}-{mark}") as f:
                    f.write(content.encode())
                fs.move(f"{base}/.{name}-{mark}", f"{base}/{name}")
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["n"])

    return once.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
