"""Mixing sources to target weights, with DataFrame functions only.

Documents of a source fall into blocks by hash. A source's target is its whole passes
and a rest; the rest takes the blocks of a hashed permutation that still fit, past
those that do not, then single documents of further blocks in the same way. Where
whole documents end more than ``MISS`` of the target short of it, as in a source whose
words lie mostly in one long document, one document is taken in part.

The block copies that a source owes (its quota) are split among output shards by a
binary tree: at each node a uniformly drawn half of the node's block copies goes
left, so that the counts by source follow the multivariate hypergeometric
distribution and every quota is met exactly. Each unit of a quota is the next block
of its source's permutation, so shards hold disjoint draws. Rows are then ordered by
hash within their shard.

No step passes all sources or all block copies through one task: sources are ranked
by ranges, the common level of the targets comes from aggregates, and the tree ranks
its draws by ranges of their hashes. What is broadcast is counted first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import small_table
from newsloom.plans.scratch import materialize

#: Weights by rank of the source, times its size that a target may reach; blocks in all and log2 of shards at least, words of a block and of a shard at most (about), rows that may be broadcast;
#: share of a target by which whole documents may stay below it, fillings planned at a time, ranges of hashes at a node of the tree.
WEIGHTS, MOST, BLOCKS, LEVELS, BLOCK_WORDS, SHARD_WORDS, BROADCAST_ROWS, MISS, PASSES, RANGE_BITS = (5, 2, 1), 3, 16_384, 4, 4_000_000, 64_000_000, 200_000, 0.005, 4, 10
SEED = 7
_WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its ``n``-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + _WORD), F.lit(0)), F.lit(1), n.cast("int")), "")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, docs, source_size, target`` from ``sizes (doc_id, source, size)``.

    Sources by code point, null last, take ``weights`` in turn. Targets share the sum
    of all sizes by weight; none passes ``most`` times its source's size, and what is
    over goes to the others by weight, until none is above.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    by_name = F.col("source").asc_nulls_last()
    per = materialize(materialize(per, "source-sizes").repartitionByRange(by_name).withColumn("range", F.spark_partition_id()), "source-ranges")
    before, so_far = [], 0
    for r in sorted(per.groupBy("range").agg(F.count("*").alias("n")).collect()):  # a row for each partition
        before.append((r["range"], so_far))
        so_far += r["n"]
    ranked = per.join(F.broadcast(small_table(per.sparkSession, range=[r for r, _ in before], before=[b for _, b in before])), "range")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(by_name)) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    per = materialize(ranked.select("source", "docs", "source_size", weight.alias("w"), (F.lit(most) * F.col("source_size")).alias("cap")), "weights")
    total, w = per.agg(F.sum("source_size"), F.sum("w")).first()
    level, capped = (total or 0) / (w or 1), None
    while True:  # each turn settles at least one source more
        over = F.col("cap") < F.lit(level) * F.col("w")
        n, full, w = per.agg(F.count_if(over), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("w")))).first()
        if n == capped or not w:
            return per.select("source", "docs", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("w")).alias("target"))
        level, capped = (total - (full or 0)) / w, n


def _keyed(docs: DataFrame) -> Column:
    """What tells documents apart: id and text, where there is one."""
    return F.col("__key") if "__key" in docs.columns else F.xxhash64("doc_id", "text") if "text" in docs.columns else F.xxhash64("doc_id")


def _block(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col("key"), F.lit(seed)), F.col("blocks"))


def _of_source(df: DataFrame, other: DataFrame, few: bool, how: str = "inner", *also: str) -> DataFrame:
    """Join on source, where null equals null, and the columns ``also``; ``other``, which is broadcast if it has few rows, gives its further columns."""
    side = other.select(F.col("source").alias("__s"), *[F.col(c).alias(f"__{c}") for c in also], *[c for c in other.columns if c != "source" and c not in also])
    on = F.col("source").eqNullSafe(F.col("__s"))
    for c in also:
        on = on & (F.col(c) == F.col(f"__{c}"))
    out = df.join(F.broadcast(side) if few else side, on, how)
    return out.drop("__s", *[f"__{c}" for c in also])


def filled(items: DataFrame, passes: int = PASSES) -> DataFrame:
    """``items (source, at, size, gap)`` with ``taken``, and with ``gap`` as it is left.

    In the order of ``at`` the items up to one that is too large for the gap are
    taken; then in the same way those behind that still fit, ``passes`` times.
    """
    upto = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("source")
    out = items.withColumn("taken", F.lit(False))
    for _ in range(passes):
        out = out.withColumn("could", ~F.col("taken") & F.col("size").between(1, F.col("gap")))
        out = out.withColumn("now", F.col("could") & (F.sum(F.when(F.col("could"), F.col("size")).otherwise(0)).over(upto) <= F.col("gap")))
        out = out.withColumn("gap", F.col("gap") - F.sum(F.when(F.col("now"), F.col("size")).otherwise(0)).over(whole)).withColumn("taken", F.col("taken") | F.col("now"))
    return out.drop("could", "now")


def extent(words: int) -> tuple[int, int]:
    """Blocks and levels of the tree for so many words: blocks and shards have a bounded size, whatever the input."""
    return max(BLOCKS, -(-words // BLOCK_WORDS)), max(LEVELS, (-(-words // SHARD_WORDS) - 1).bit_length())


def plan(sizes: DataFrame, seed: int = SEED, levels: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Sources (with targets and numbers of blocks), block copies by shard, documents that the rest takes singly or in part, and whether sources and blocks are few enough to be broadcast.

    The third has ``key, source, cut``: the words that are taken of a document, null for all.
    """
    src = targets(sizes).withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int"))
    n, total = src.agg(F.count("*"), F.sum("source_size")).first()
    wanted, depth = extent(total or 0)
    levels = depth if levels is None else levels
    few = n + wanted <= BROADCAST_ROWS  # a row for each source, and at most so many blocks more
    share = F.ceil(F.lit(wanted / (total or 1)) * F.col("source_size"))
    src = src.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    src = materialize(src.withColumn("blocks", F.least("docs", F.greatest(F.lit(1), share)).cast("long")), "sources")
    placed = _of_source(sizes.select("source", "size", _keyed(sizes).alias("key")), src.select("source", "blocks", "passes", "rest"), few).withColumn("block", _block(seed))
    blocks = placed.groupBy("source", "block").agg(F.sum("size").alias("size"), F.first("passes").alias("passes"), F.first("rest").alias("gap"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("source", "block", F.lit(seed + 1)), "block")
    blocks = materialize(filled(materialize(blocks.withColumn("at", F.row_number().over(order)), "blocks")), "blocks")
    near = src.select("source", (F.lit(MISS) * F.col("target")).alias("near"))
    gaps = materialize(_of_source(blocks.groupBy("source").agg(F.first("gap").alias("gap")), near, few).where("gap >= 1"), "gaps")
    # the rest of the rest: documents of blocks left
    open_ = _of_source(blocks.where("not taken").select("source", "block"), gaps.select("source"), few)
    own = _of_source(placed.select("source", "size", "key", "block"), open_, few, "inner", "block")
    own = materialize(own.where("size > 0").groupBy("key", "source", "block").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "left")  # rows with one key go together
    singles = None
    left = lambda: own if singles is None else own.join(singles.select(F.col("key").alias("k"), F.col("source").alias("s")), (F.col("key") == F.col("k")) & F.col("source").eqNullSafe(F.col("s")), "left_anti")
    while True:
        fit = materialize(_of_source(left(), gaps, few).where("size <= gap"), "fitting")
        if fit.isEmpty():
            break
        most = Window.partitionBy("source").orderBy(F.desc("size"), "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        best = fit.groupBy("source", "block").agg(F.sum("size").alias("size"), F.first("gap").alias("gap")).withColumn("cum", F.sum("size").over(most))
        best = best.where(F.col("cum") - F.col("size") < F.col("gap")).select("source", "block")  # mostly one; more where none has enough
        hashed = Window.partitionBy("source").orderBy(F.xxhash64("key", F.lit(seed + 2)), "key")
        one = filled(_of_source(fit, best, few, "inner", "block").withColumn("at", F.row_number().over(hashed)))
        one = materialize(one.where("taken").select("key", "source", "gap"), "round")
        now = one.select("key", "source", F.lit(None).cast("long").alias("cut"))
        singles = now if singles is None else singles.unionByName(now)
        after = one.groupBy("source").agg(F.first("gap").alias("after"))
        gaps = materialize(_of_source(gaps, after, few, "left").select("source", F.coalesce("after", "gap").alias("gap"), "near").where("gap >= 1"), "gaps")
    # where whole documents don't come near, the least one left, which is larger than the gap, in part
    part = _of_source(left(), gaps.where("gap > near"), few).groupBy("source").agg(F.min(F.struct("size", "key", "n", "gap")).alias("r"))
    part = part.select("r.key", "source", F.greatest(F.lit(1), F.floor(F.col("r.gap") / F.col("r.n"))).cast("long").alias("cut"))
    singles = materialize(part if singles is None else singles.unionByName(part), "singles")
    # quotas: unit j of a source is the j-th block of its permutation, pass by pass; the singles are one unit more
    units = blocks.select("source", "block", F.explode(F.sequence(F.lit(0), F.col("passes"))).alias("copy"), "passes", "taken").where("copy < passes or taken").select("source", "block", "copy")
    units = units.unionByName(singles.select("source").distinct().select("source", F.lit(-1).cast("long").alias("block"), F.lit(0).alias("copy")))
    units = materialize(units.withColumn("node", F.lit(0)), "units")
    for level in range(levels):
        units = materialize(_halved(units, seed + 10 + level, max(0, RANGE_BITS - level)), "units")
    return src, materialize(units.groupBy("source", "block").agg(F.sort_array(F.collect_list("node")).alias("shards")), "units"), singles, few


def _halved(units: DataFrame, seed: int, bits: int = RANGE_BITS) -> DataFrame:
    """One level of the tree: of each node's units a drawn half goes left, in the order of their hashes.

    Ranks come from counts by range of the hashes (1,024 at a level, or one a node, which are broadcast) and from windows within a range.
    """
    drawn = units.withColumn("draw", F.xxhash64("source", "block", "copy", F.lit(seed))).withColumn("range", F.shiftright("draw", 64 - bits) if bits else F.lit(0).cast("long"))
    counts = drawn.groupBy("node", "range").agg(F.count("*").alias("m"))
    node = Window.partitionBy("node")
    counts = counts.select("node", "range", (F.sum("m").over(node.orderBy("range")) - F.col("m")).alias("before"), F.ceil(F.sum("m").over(node) / 2).alias("half"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("node", "range").orderBy("draw", "source", "block", "copy"))
    return drawn.join(F.broadcast(counts), ["node", "range"]).select("source", "block", "copy", (2 * F.col("node") + (rank > F.col("half")).cast("int")).alias("node"))


def draws(docs: DataFrame, sizes: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with ``__source_size, __target``, ``__shards``: the shard of each copy that the mix takes, none for a document that it leaves, and
    ``__cut``: the words that are taken of the last copy, null for all.

    ``sizes (doc_id, source, size)`` are those of the same rows.
    """
    src, units, singles, few = plan(sizes, seed)
    rows = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("source"), _keyed(docs).alias("key"))
    out = _of_source(rows, src.select("source", "source_size", "target", "blocks"), few).withColumn("block", _block(seed))
    out = _of_source(out, units.where("block >= 0").select("source", "block", F.col("shards").alias("own")), few, "left", "block")
    more = _of_source(singles, units.where("block = -1").select("source", F.col("shards").alias("more")), few)
    out = _of_source(out, more.select("source", "key", "more", "cut"), singles.count() <= BROADCAST_ROWS, "left", "key")
    none = F.array().cast("array<int>")
    shards = F.concat(F.coalesce("own", none), F.coalesce("more", none))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), shards.alias("__shards"), F.col("cut").alias("__cut"))


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` and a key, counted once and written."""
    return materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"), _keyed(docs).alias("__key")), "sizes")


def mix_digest(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, shards`` of each row of ``docs (doc_id, source, text)``.

    A null text has size 0; a null source is the last one; sources without words get
    target 0. Rows that share doc_id, text and source are drawn alike. A document of
    any length is one item, taken whole or, at most once in a source, in part. An
    empty table gives no rows. Other columns are ignored.
    """
    sizes = sized(docs.select("doc_id", "source", "text"))
    n = F.size("__shards")
    taken = F.col("size") * (n - F.col("__cut").isNotNull().cast("int")) + F.when(F.col("__cut").isNotNull(), F.least("__cut", "size")).otherwise(0)
    return draws(sizes, sizes, seed).select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken.alias("taken"), n.cast("long").alias("copies"), F.col("__shards").alias("shards"))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: ``docs`` in the columns they have, each row as often as it is taken, shard by shard in hashed order.

    A copy that is taken in part has the text up to its last word taken, and its
    length as ``n_chars``, where there is such a column. For nulls, repeated rows,
    long texts and empty tables see :func:`mix_digest`.
    """
    drawn = draws(docs, sized(docs.select("doc_id", "source", "text")), seed)
    out = drawn.select(F.struct(*docs.columns).alias("row"), F.posexplode("__shards").alias("copy", "shard"), F.when(F.col("__cut").isNotNull(), F.size("__shards") - 1).alias("last"), "__cut")
    out = out.withColumn("text", F.when(F.col("copy") == F.col("last"), first_words(F.col("row.text"), F.col("__cut"))).otherwise(F.col("row.text")))
    key = F.xxhash64("row.doc_id", "text", "copy", F.lit(seed + 3))
    out = out.repartition("shard", F.pmod(key, F.lit(64))).sortWithinPartitions("shard", key)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("copy") == F.col("last"), F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
