"""The sets that share most members with each set, without making all pairs of sets."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.plans.scratch import materialize

#: Sets that may hold a member for its pairs to be made; doubled at each level.
LONGEST = 1_000
#: Members from which a set is a long one, long sets in a block, members in a slab of a matrix.
LONG, BLOCK, SLAB = 256, 1_024, 4_096


def top_overlaps(sets: DataFrame, top: int, longest: int = LONGEST) -> DataFrame:
    """``item, other, shared`` of ``sets (item, member)``: for each item the ``top`` others that share most members, the least of equal ones.

    Members of at most ``longest`` items have their pairs counted. For the others, items
    are classes by the set of these frequent members alone, and the same question is
    asked of the classes: an item that shares nothing rarer can only be among the best
    if it is among the best by frequent members, and of equal ones only the least ids
    count. Rows grow with the entries times ``longest`` (twice that at each level, of
    ever fewer classes), not with the square of a member's items. Null items and members
    are left out, repeated rows count once.
    """
    own = materialize(sets.select("item", "member").where("item is not null and member is not null").distinct(), "sets")
    best = _best(own, own.select("item", F.col("item").alias("id")).distinct(), top + 1, longest)  # an item is among its own best
    return _first(best.where("item <> id"), top).withColumnRenamed("id", "other")


def _first(rows: DataFrame, k: int) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("shared"), "id"))
    return rows.withColumn("at", at).where(F.col("at") <= k).select("item", "id", "shared")


def rare_pairs(marked: DataFrame, longest: int) -> DataFrame:
    """``item, other, rare`` of all pairs, an item with itself included, that share members of at most ``longest`` items of ``marked (item, member, n)``.

    Pairs of long sets, which share many members each, are counted by products of
    matrices, so that they make no row for each member that they share.
    """
    rare = marked.where(F.col("n") <= longest).select("item", "member")
    long = materialize(rare.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= LONG).select("item", F.monotonically_increasing_id().alias("at")), "long-sets")
    meets = lambda a, b: a.join(b.select(F.col("item").alias("other"), F.col("at").alias("with"), "member"), "member").groupBy("item", "other", "with").agg(F.count("*").alias("rare"))
    if long.isEmpty():
        return meets(rare, rare.withColumn("at", F.lit(None).cast("long"))).select("item", "other", "rare")
    own = materialize(rare.join(long, "item", "left"), "rare")
    short = materialize(meets(own.where("at is null"), own), "short-pairs")
    turned = short.where("with is not null").select(F.col("other").alias("item"), F.col("item").alias("other"), "rare")
    return short.select("item", "other", "rare").unionByName(turned).unionByName(_long_pairs(own.where("at is not null"), long))


def _long_pairs(own: DataFrame, long: DataFrame) -> DataFrame:
    """``item, other, rare`` of all pairs of the sets ``own (item, member, at)``, numbered by ``long (item, at)``.

    Sets fall into blocks, members into slabs; a task holds the slab of two blocks as
    matrices and adds up their products slab by slab.
    """
    members = materialize(own.select("member").distinct().withColumn("code", F.monotonically_increasing_id()), "long-members")
    blocks, slabs = -(-long.count() // BLOCK), -(-members.count() // SLAB)
    share = max(1, 2 * own.sparkSession.sparkContext.defaultParallelism // (blocks * (blocks + 1) // 2))
    cell = own.join(members, "member").groupBy("at", F.pmod(F.xxhash64("code"), F.lit(slabs)).alias("slab")).agg(F.collect_list("code").alias("codes")).withColumn("block", F.pmod(F.xxhash64("at"), F.lit(blocks)))
    cell = materialize(cell, "long-cells")
    shape = lambda side, i, j: cell.select(i.alias("i"), j.alias("j"), F.pmod("slab", F.lit(share)).alias("part"), "slab", F.lit(side).alias("side"), "at", "codes")
    left = shape(0, F.col("block"), F.explode(F.sequence("block", F.lit(blocks - 1).cast("long"))))
    right = shape(1, F.explode(F.sequence(F.lit(0).cast("long"), "block")), F.col("block")).where("i < j")
    rows = left.unionByName(right).repartition("i", "j", "part").sortWithinPartitions("i", "j", "part", "slab", "side")

    def product(cells: list, sides: tuple[dict, dict], total: np.ndarray, same: bool) -> np.ndarray:
        """``total`` and the members that the sets of the two sides share in one slab."""
        _, code = np.unique(np.concatenate([c for _, _, c in cells]), return_inverse=True)
        width, at, sets = int(code.max()) + 1, 0, ([], [])
        for side, key, codes in cells:
            row = np.zeros(width, np.float32)
            row[code[at : at + len(codes)]] = 1
            at += len(codes)
            sets[side].append((sides[side].setdefault(key, len(sides[side])), row))
        if same:
            sides, sets = (sides[0], sides[0]), (sets[0], sets[0])
        if not sets[0] or not sets[1]:
            return total
        need = [max(len(sides[k]), total.shape[k]) for k in (0, 1)]
        if tuple(need) != total.shape:
            grown = np.zeros(need, np.int64)
            grown[: total.shape[0], : total.shape[1]] = total
            total = grown
        a, b = (np.stack([row for _, row in x]) for x in sets)
        total[np.ix_([n for n, _ in sets[0]], [n for n, _ in sets[1]])] += (a @ b.T).astype(np.int64)  # exact below 2 ** 24
        return total

    def result(sides: tuple[dict, dict], total: np.ndarray, same: bool):
        one, two = np.array(list(sides[0]), np.int64), np.array(list(sides[0] if same else sides[1]), np.int64)
        x, y = np.nonzero(total)
        a, b, n = one[x], two[y], total[x, y]
        for k in range(0, len(a), 200_000):
            c = slice(k, k + 200_000)
            yield pa.record_batch([pa.array(a[c]), pa.array(b[c]), pa.array(n[c])], names=["a", "b", "rare"])
            if not same:
                yield pa.record_batch([pa.array(b[c]), pa.array(a[c]), pa.array(n[c])], names=["a", "b", "rare"])

    def run(batches):
        rows = (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in range(6)], [b.column(6)[k].values.to_numpy() for k in range(b.num_rows)], strict=True))
        for (i, j, _), group in groupby(rows, key=lambda r: r[:3]):
            sides, total = ({}, {}), np.zeros((0, 0), np.int64)
            for _, slab in groupby(group, key=lambda r: r[3]):
                total = product([r[4:] for r in slab], sides, total, i == j)
            yield from result(sides, total, i == j)

    n = rows.mapInArrow(run, "a long, b long, rare long").groupBy("a", "b").agg(F.sum("rare").alias("rare"))
    side = lambda c, name: long.select(F.col("at").alias(c), F.col("item").alias(name))
    return n.join(side("a", "item"), "a").join(side("b", "other"), "b").select("item", "other", "rare")


def _best(own: DataFrame, ids: DataFrame, k: int, longest: int) -> DataFrame:
    """``item, id, shared``: of all ``ids (item, id)`` the ``k`` whose items share most with each item of ``own (item, member)``."""
    marked = materialize(own.join(own.groupBy("member").agg(F.count("*").alias("n")), "member"), "sized")
    pairs = rare_pairs(marked, longest)
    of_other = ids.select(F.col("item").alias("other"), "id")
    frequent = marked.where(F.col("n") > longest)
    if frequent.isEmpty():
        return _first(pairs.join(of_other, "other").select("item", "id", F.col("rare").alias("shared")), k)
    held = frequent.groupBy("item").agg(F.sort_array(F.collect_set("member")).alias("held"))
    of = materialize(held.join(held.groupBy("held").agg(F.min("item").alias("class")), "held"), "classes")
    class_ids = of.join(ids, "item").select(F.col("class").alias("item"), "id", F.lit(0).alias("shared"))
    above = _best(of.where(F.col("item") == F.col("class")).select("item", F.explode("held").alias("member")), _first(class_ids, k).select("item", "id"), k, 2 * longest)
    by_class = of.select("item", "class").join(above.select(F.col("item").alias("class"), "id", "shared"), "class").select("item", "id", "shared")
    both = pairs.join(of.select("item", "held"), "item", "left").join(of.select(F.col("item").alias("other"), F.col("held").alias("others")), "other", "left")
    more = F.coalesce(F.size(F.array_intersect("held", "others")), F.lit(0))
    by_pair = both.select("item", "other", (F.col("rare") + F.when(F.col("held").isNotNull() & F.col("others").isNotNull(), more).otherwise(0)).alias("shared"))
    found = by_pair.join(of_other, "other").select("item", "id", "shared").unionByName(by_class)
    return _first(found.groupBy("item", "id").agg(F.max("shared").alias("shared")), k)
