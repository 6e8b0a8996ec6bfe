"""Hashes over the sorted members of groups of any size."""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def member_digests(rows: DataFrame, group: str, member: str, separator: str = ",") -> DataFrame:
    """``group, digest, members``: the SHA-256 of each group's distinct members as text, sorted and joined by ``separator``, and their number.

    Equal to hashing the joined array, but no array is made: a task sorts its rows, by
    disk where need be, and feeds a running hash, so a group of any size takes constant
    memory. A hash is serial; a group's ids, not its rows, pass through one task. Null
    groups and members are left out.
    """
    kind = dict(rows.dtypes)[group]
    own = rows.select(F.col(group).alias("g"), F.col(member).cast("string").alias("m")).where("g is not null and m is not null").repartition("g").sortWithinPartitions("g", "m")
    between = separator.encode()

    def run(batches):
        now, sha, n, last = None, None, 0, None
        for b in batches:
            groups, members = b.column(0), b.column(1).cast(pa.binary()).to_pylist()
            done = ([], [], [])
            at = 0
            for g, some in groupby(groups.to_pylist()):
                size = sum(1 for _ in some)
                if sha is None or g != now:
                    if sha is not None:
                        for out, x in zip(done, (now, sha.hexdigest(), n), strict=True):
                            out.append(x)
                    now, sha, n, last = g, hashlib.sha256(), 0, None
                fresh = [m for m, _ in groupby(members[at : at + size])]
                fresh = fresh[1:] if n and fresh[0] == last else fresh
                if fresh:
                    sha.update((between if n else b"") + between.join(fresh))
                    n, last = n + len(fresh), fresh[-1]
                at += size
            yield pa.record_batch([pa.array(done[0], groups.type), pa.array(done[1], pa.string()), pa.array(done[2], pa.int64())], names=["group", "digest", "members"])
        if sha is not None:
            yield pa.record_batch([pa.array([now], groups.type), pa.array([sha.hexdigest()]), pa.array([n], pa.int64())], names=["group", "digest", "members"])

    return own.mapInArrow(run, f"group {kind}, digest string, members long")
