"""Jaccard self-join on word shingles by vertical partitioning.

The global order puts shingles that a bounded sample shows to be frequent last, and
orders the rest by hash. The order decides speed only; any order gives the same
links.

1. One scan gives each document the size of its set, a signature of the whole set
   (equal sets are one class from here on) and its prefix, the shingles of which two
   sets at the threshold must share one.
2. Prefixes meet by shingle. Small groups give their pairs. Shingles that the sample
   shows to be frequent aren't gathered: they make large groups from the start. A
   large group gives each set one pair, with the group's pivot, the set whose prefix lies most in large
   groups: of near copies, the one that the others were made from.
3. The order is cut into fragments. A compact row of each set's sizes by cell of the
   order bounds the overlap of a pair; pairs that can still reach the threshold count
   their partial overlaps fragment by fragment, and the sums decide.
4. Sets that this leaves outside their pivot's component meet all sets of the same
   pivot in blocks of bounded size. First only sizes by cell are sent: they leave a
   set few possible partners, which are counted like other pairs, or many, as among
   near copies; only then whole sets are sent, and a block returns a spanning forest
   of its exact links.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import HASHES, SHINGLE, forest, lists, shingles, slices, texts, utf8
from newsloom.plans.components import connected_components
from newsloom.plans.scratch import materialize

#: Sampled documents for frequent shingles, their least number of documents there and how many at most; sets of a group that are all paired, outside sets and sets of a block, partners up to which an outside set's pairs are counted one by one;
#: shingles in a cell (about) of those whose sizes bound an overlap, fragments that count it; candidate ids that may be broadcast; pairs that a task gathers before it passes them on.
SAMPLE_DOCS, HOT_DOCS, HOT, SMALL, OUTSIDE, BLOCK, FEW, IN_CELL, FRAGMENTS, BROADCAST_IDS, PAIRS = 4_000, 8, 50_000, 8, 256, 1_024, 4, 2, 8, 1_000_000, 500_000


def frequent_shingles(docs: DataFrame, k: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of shingles that at least ``HOT_DOCS`` of about ``SAMPLE_DOCS`` sampled documents hold; at most ``HOT``."""
    step = max(1, docs.count() // SAMPLE_DOCS)

    def count(batches):
        got = [shingles(t, HASHES, k) for b in batches for t in utf8(b.column(0))]
        if got:
            s, n = np.unique(np.concatenate(got), return_counts=True)
            yield pa.record_batch({"s": pa.array(s.view(np.int64)), "n": pa.array(n)})

    drawn = texts(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select("text")
    top = drawn.mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_DOCS).orderBy(F.desc("n"), "s").limit(HOT)
    return np.sort(np.array([r["s"] for r in top.toLocalIterator()], np.int64).view(np.uint64))


def prefix_size(n: int, percent: int) -> int:
    """Of two sets with Jaccard at the threshold, the first so many in the global order share one."""
    return n - -(-percent * n // 100) + 1


def _split(s: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that aren't frequent, and those that are."""
    if not len(hot) or not len(s):
        return s, s[:0]
    is_hot = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
    return s[~is_hot], s[is_hot]


def set_signature(s: np.ndarray) -> int:
    """64-bit signature of a whole set, as a signed number."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def cell_sizes(s: np.ndarray) -> bytes:
    """How many shingles lie in each of 2^k equal cells of the hash range, with about ``IN_CELL`` in one; 255 stands for more too."""
    bits = max(0, (len(s) // IN_CELL).bit_length() - 1)
    cell = (s >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(s), np.int64)
    return np.minimum(np.bincount(cell, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def overlap_bounds(a: list[bytes], b: list[bytes], na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Upper bounds of overlaps from the sizes of cells; the finer cells of a pair are summed to the coarser."""
    out = np.minimum(na, nb)
    width = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    for wa, wb in np.unique(width, axis=0):
        at = np.flatnonzero((width == (wa, wb)).all(1))
        x, y = (np.frombuffer(b"".join([c[i] for i in at]), np.uint8).reshape(len(at), -1) for c in (a, b))
        full = (x == 255).any(1) | (y == 255).any(1)
        w = min(wa, wb)
        x, y = (c.reshape(len(at), w, -1).sum(2, dtype=np.int64) for c in (x, y))
        out[at] = np.where(full, out[at], np.minimum(x, y).sum(1))
    return out


def text_hash(text: str) -> Column:
    """With the doc_id, what tells rows apart; of a null text as of an empty one."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def signatures(docs: DataFrame, hot: np.ndarray, percent: int, k: int = SHINGLE) -> DataFrame:
    """``doc_id, n, sig, prefix, common, cells, text_hash``; prefix and cells only where a task first meets a set, and null for an empty one.

    ``common`` are the frequent shingles of the prefix, the last in the order; ``prefix`` are the others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        met: set[int] = set()
        for b in slices(batches):
            n, sig, prefix, common, cells = [], [], [], [], []
            for t in utf8(b.column(1)):
                s = shingles(t, HASHES, k)
                n.append(len(s))
                sig.append(h := set_signature(s))
                first = len(s) > 0 and h not in met
                met.add(h)
                rare, often = _split(s, shared.value) if first else (s[:0], s[:0])
                most = prefix_size(len(s), percent)
                prefix.append(rare[:most])
                common.append(often[: max(0, most - len(rare))])
                cells.append(cell_sizes(s) if first else None)
            yield pa.record_batch({"doc_id": b.column(0), "n": pa.array(n, pa.int64()), "sig": pa.array(sig, pa.int64()), "prefix": lists(prefix), "common": lists(common), "cells": pa.array(cells, pa.binary()), "text_hash": b.column(2)})

    return texts(docs, text_hash("text").alias("text_hash")).mapInArrow(run, "doc_id long, n long, sig long, prefix array<long>, common array<long>, cells binary, text_hash long")


def _meet(prefixes: DataFrame, percent: int) -> DataFrame:
    """Prefix rows ``s, sig, n`` by shingle: pairs ``a, b`` (n: null), or members of large groups (a: set, b: shingle, n: size).

    Spark sorts each partition; a task holds one small group and some pairs at a time, and passes a large group on as it comes.
    """

    def run(batches):
        def groups():  # sorted rows in whole small groups; a group that has become large comes in parts
            held, large, last = [np.empty(0, np.int64)] * 3, None, None
            for b in itertools.chain(batches, [None]):
                s, sig, n = held if b is None else (np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate(held))
                if not len(s):
                    continue
                keep = np.r_[last != (s[0], sig[0]), (s[1:] != s[:-1]) | (sig[1:] != sig[:-1])]
                s, sig, n = s[keep], sig[keep], n[keep]
                if not len(s):
                    held = [s, sig, n]
                    continue
                starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                size = np.diff(np.r_[starts, len(s)])
                is_large = (size > SMALL) | ((s[starts] == large) if large is not None else False)
                end = len(s) if b is None or is_large[-1] else starts[-1]
                held = [s[end:], sig[end:], n[end:]]
                if end == len(s):
                    large, last = s[-1], (s[-1], sig[-1])
                    yield s, sig, n, starts, size, is_large
                elif end:
                    yield s[:end], sig[:end], n[:end], starts[:-1], size[:-1], is_large[:-1]

        def flush(found):
            pairs = np.unique(np.concatenate(found), axis=0)
            for lo in range(0, len(pairs), 50_000):
                x = pairs[lo : lo + 50_000]
                yield pa.record_batch({"a": pa.array(np.ascontiguousarray(x[:, 0])), "b": pa.array(np.ascontiguousarray(x[:, 1])), "n": pa.nulls(len(x), pa.int64())})

        found, many = [], 0
        for s, sig, n, starts, size, is_large in groups():
            if is_large.any():
                x = np.flatnonzero(np.repeat(is_large, size))
                yield pa.record_batch({"a": pa.array(sig[x]), "b": pa.array(s[x]), "n": pa.array(n[x])})
            for m in np.unique(size[~is_large & (size > 1)]).tolist():
                at = starts[~is_large & (size == m)]
                i, j = np.triu_indices(m, 1)  # all pairs of all small groups of this size at once
                left, right = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                fits = 100 * np.minimum(n[left], n[right]) >= percent * np.maximum(n[left], n[right])
                if fits.any():
                    found.append(np.stack([sig[left[fits]], sig[right[fits]]], 1))
                    many += len(found[-1])
            if many > PAIRS:
                yield from flush(found)
                found, many = [], 0
        if found:
            yield from flush(found)

    return prefixes.repartition("s").sortWithinPartitions("s", "sig").select("s", "sig", "n").mapInArrow(run, "a long, b long, n long")


def possible(pairs: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose sizes by cell still allow the threshold, with both sizes. Saturated cells count as whole sets."""
    left = cells.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("cells").alias("ca"))
    right = cells.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("cells").alias("cb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ca", "cb")

    def run(batches):
        for p in batches:
            if not p.num_rows:
                continue
            na, nb = p.column(2).to_numpy(), p.column(3).to_numpy()
            bound = overlap_bounds(p.column(4).to_pylist(), p.column(5).to_pylist(), na, nb)
            yield pa.RecordBatch.from_arrays(p.columns[:4], ["a", "b", "na", "nb"]).filter(pa.array(100 * bound >= percent * (na + nb - bound)))

    return both.mapInArrow(run, "a long, b long, na long, nb long")


def _fragments(docs: DataFrame, ids: DataFrame, k: int, fragments: int = FRAGMENTS) -> DataFrame:
    """``sig, f, part``: the shingles of candidate sets, cut at fixed points of the order; ``fragments`` is a power of two."""
    cuts = np.arange(1, fragments, dtype=np.uint64) << np.uint64(65 - fragments.bit_length())

    def run(batches):
        for c in slices(batches):
            sig, f, part = [], [], []
            for h, t in zip(c.column(0).to_pylist(), utf8(c.column(1)), strict=True):
                s = shingles(t, HASHES, k)
                if set_signature(s) != h:  # another text under the same doc_id
                    continue
                for i, x in enumerate(np.split(s, np.searchsorted(s, cuts))):
                    if len(x):
                        sig.append(h)
                        f.append(i)
                        part.append(x)
            if sig:
                yield pa.record_batch({"sig": pa.array(sig, pa.int64()), "f": pa.array(f, pa.int32()), "part": lists(part)})

    small = ids.count() <= BROADCAST_IDS
    ids = ids.withColumnRenamed("doc_id", "of")
    found = texts(docs).join(F.broadcast(ids) if small else ids, F.col("doc_id").eqNullSafe(F.col("of"))).select("sig", "text")
    return found.mapInArrow(run, "sig long, f int, part array<long>")


def exact_overlaps(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """Pairs ``a, b, na, nb`` with their exact overlap: partial counts by fragment, then their sum."""
    wanted = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
    parts = materialize(_fragments(docs, materialize(reps.join(wanted, "sig").select("doc_id", "sig"), "candidates"), k), "fragments")
    left = parts.select(F.col("sig").alias("a"), "f", F.col("part").alias("pa"))
    right = parts.select(F.col("sig").alias("b"), "f", F.col("part").alias("pb"))
    met = pairs.join(left, "a").join(right, ["b", "f"])
    partial = met.select("a", "b", "f", F.size(F.array_intersect("pa", "pb")).cast("long").alias("o"))
    partial = partial.groupBy("a", "b", "f").agg(F.max("o").alias("o"))  # a row that occurs twice counts once
    return pairs.join(partial.groupBy("a", "b").agg(F.sum("o").alias("overlap")), ["a", "b"], "left").select("a", "b", "na", "nb", F.coalesce("overlap", F.lit(0)).alias("overlap"))


def linked(p: DataFrame, percent: int) -> DataFrame:
    return p.where(F.lit(100) * F.col("overlap") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("overlap")))


def labelled(docs: DataFrame, percent: int = 80, k: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, n_shingles, at`` for each row of ``docs (doc_id, text)``: ``at`` is the same for all rows that links join, and null for the empty set."""
    hot = frequent_shingles(docs, k)
    base = materialize(signatures(docs, hot, percent, k), "sets")
    sets = base.where("n > 0")
    one = F.min(F.struct("doc_id", "n", "cells"))
    reps = materialize(sets.where("cells is not null").groupBy("sig").agg(one.alias("r")).select("sig", "r.doc_id", "r.n", "r.cells"), "classes")
    rows = sets.select("sig", "n", F.explode("prefix").alias("s"))
    met = materialize(_meet(rows, percent), "met")
    large = met.where("n is not null").select(F.col("b").alias("s"), F.col("a").alias("sig"), "n")
    common = sets.where("size(common) > 0").select("sig", "n", "common").dropDuplicates(["sig"])  # frequent shingles make large groups, which no task gathers
    pivots = materialize(_pivots(large.unionByName(common.select(F.explode("common").alias("s"), "sig", "n"))), "pivots")
    star = pivots.where(F.lit(100) * F.least("n", "pn") >= F.lit(percent) * F.greatest("n", "pn")).where("sig <> pivot")
    pairs = met.where("n is null").select("a", "b").unionByName(star.select(F.least("sig", "pivot").alias("a"), F.greatest("sig", "pivot").alias("b"))).distinct()
    ids = reps.select("doc_id", "sig")
    counted = materialize(exact_overlaps(materialize(possible(pairs, reps.select("sig", "n", "cells"), percent), "pairs"), docs, ids, k), "overlaps")
    links = linked(counted, percent).select("a", "b")
    labels = connected_components(links, "a", "b")
    more = outside_links(pivots, labels, reps, docs, percent, k)
    if more is not None:
        labels = connected_components(links.unionByName(more), "a", "b")
    low = base.join(labels, base["sig"] == labels["node"], "left").withColumn("at", F.when(F.col("n") > 0, F.coalesce("component", "sig")))
    return materialize(low.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "at"), "labelled")


def jaccard_components(docs: DataFrame, percent: int = 80, k: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs (doc_id, text)``.

    Documents link when ``100 * intersection >= percent * union`` of their sets of
    distinct k-word shingles; fewer words are one shingle. A text without words, or
    null, has the empty set and links with nothing. ``component_id`` is the smallest
    doc_id reachable by links, a null one only where no other is; a row of the empty
    set has its own. Rows that repeat a doc_id are each scored. A text of any length
    is taken whole. An empty table gives no rows. Other columns, whatever their names,
    are ignored.
    """
    low = labelled(docs, percent, k)
    least = low.where("at is not null").groupBy("at").agg(F.min("doc_id").alias("least"))
    return low.join(least, "at", "left").select("doc_id", "n_shingles", F.when(F.col("at").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def _pivots(groups: DataFrame) -> DataFrame:
    """``pivot, pn, sig, n``: each set of a large group with the group's pivot and both sizes; groups of one pivot are one."""
    often = groups.groupBy("sig").agg(F.count("*").alias("k"))
    best = groups.join(often, "sig").groupBy("s").agg(F.max(F.struct((F.col("k") / F.col("n")).alias("share"), "sig", "n")).alias("p"))
    return groups.join(best.select("s", F.col("p.sig").alias("pivot"), F.col("p.n").alias("pn")), "s").select("pivot", "pn", "sig", "n").distinct()


def _outside(pivots: DataFrame, labels: DataFrame) -> DataFrame:
    """``pivot, i, j, outside, sig``: for pivots that have sets outside their component, those sets and all sets, dealt into blocks ``i, j``."""
    own = pivots.join(labels.select(F.col("node").alias("sig"), F.col("component").alias("c")), "sig", "left").join(labels.select(F.col("node").alias("pivot"), F.col("component").alias("pc")), "pivot", "left")
    own = own.select("pivot", "sig", (F.coalesce("c", "sig") != F.coalesce("pc", "pivot")).alias("outside"))
    size = own.groupBy("pivot").agg(F.count_if("outside").alias("o"), F.count("*").alias("m")).where("o > 0")
    size = size.select("pivot", F.ceil(F.col("o") / OUTSIDE).cast("int").alias("ob"), F.ceil(F.col("m") / BLOCK).cast("int").alias("mb"))
    own = own.join(size, "pivot")
    at = lambda n: F.pmod(F.xxhash64("sig"), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = own.where("outside").select("pivot", at("ob").alias("i"), all_("mb").alias("j"), F.lit(True).alias("outside"), "sig")
    return one.unionByName(own.select("pivot", all_("ob").alias("i"), at("mb").alias("j"), F.lit(False).alias("outside"), "sig"))


def outside_links(pivots: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, k: int) -> DataFrame | None:
    """``a, b``: links of sets outside their pivot's component with the other sets of the pivot, up to a spanning forest of each block; None where no set is outside.

    ``pivots (pivot, sig)``, ``labels (node, component)``, ``reps (sig, doc_id, n, cells)``.
    """
    blocks = materialize(_outside(pivots, labels), "outside")
    if blocks.isEmpty():
        return None
    ids = reps.select("doc_id", "sig")
    left = materialize(_partners(blocks, reps.select("sig", "n", "cells"), percent), "partners")
    few = left.where("kind = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sizes = reps.select("sig", F.col("n").alias("size"))
    few = few.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").select("a", "b", "na", "nb")
    more = linked(exact_overlaps(materialize(few, "pairs"), docs, ids, k), percent).select("a", "b")
    many = left.where("kind > 0").select("pivot", "i", "j", (F.col("kind") == 1).alias("outside"), F.col("a").alias("sig"))
    return materialize(more.unionByName(_in_blocks(many, docs, ids, percent, k)), "more")


def overlaps_of(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Overlaps of each set of ``a`` with each of ``b``, by products of 0-1 matrices over the shingles that both sides hold."""
    flat, other = (np.concatenate([np.empty(0, np.int64), *x]) for x in (a, b))
    row, col = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (a, b))
    both = np.intersect1d(flat, other)
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(both), width):
        some = both[lo : lo + width]

        def ones(values, rows, n, some=some):
            at = np.minimum(np.searchsorted(some, values), len(some) - 1)
            hit = some[at] == values
            m = np.zeros((n, len(some)), np.float32)
            m[rows[hit], at[hit]] = 1
            return m

        out += ones(flat, row, len(a)) @ ones(other, col, len(b)).T
    return out.astype(np.int64)


def _folded(x: np.ndarray, width: int) -> np.ndarray:
    return x.reshape(len(x), width, -1).sum(2)


def _partners(blocks: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """What sizes by cell leave of blocks: pairs (kind 0: ``a, b``) of sets with few partners, the other outside sets (1: ``a``) and their possible partners (2: ``a``)."""
    rows = blocks.join(cells, "sig").select("pivot", "i", "j", "outside", "sig", "n", "cells")

    def bound(t: pa.Table) -> pa.Table:
        out, sig, n = (t.column(c).to_numpy() for c in ("outside", "sig", "n"))
        cells = [np.frombuffer(c, np.uint8) for c in t.column("cells").to_pylist()]
        width, full = np.array([len(c) for c in cells]), np.array([c.max() == 255 for c in cells])
        members = np.flatnonzero(~out)
        of = {w: members[width[members] == w] for w in np.unique(width[members])}
        stack = {w: np.stack([cells[x] for x in at]).astype(np.int16) for w, at in of.items()}
        pairs, outside, inside = [], [], set()
        for y in np.flatnonzero(out):
            found = []
            for w, at in of.items():
                at_n = n[at]
                fits = (100 * np.minimum(at_n, n[y]) >= percent * np.maximum(at_n, n[y])) & (sig[at] != sig[y])
                if not fits.any():
                    continue
                low = min(w, width[y])
                most = np.minimum(_folded(stack[w][fits], low), _folded(cells[y][None].astype(np.int16), low)).sum(1)
                most = np.where(full[at][fits] | full[y], np.minimum(at_n[fits], n[y]), most)
                found.append(at[fits][100 * most >= percent * (at_n[fits] + n[y] - most)])
            found = np.concatenate(found) if found else np.empty(0, np.int64)
            if len(found) <= FEW:
                pairs += [(sig[y], sig[x]) for x in found]
            else:
                outside.append(sig[y])
                inside.update(sig[found].tolist())
        kind = [0] * len(pairs) + [1] * len(outside) + [2] * len(inside)
        a = [x for x, _ in pairs] + outside + sorted(inside)
        b = [x for _, x in pairs] + [None] * (len(outside) + len(inside))
        where = [pa.array([t.column(c)[0].as_py()] * len(kind), k) for c, k in (("pivot", pa.int64()), ("i", pa.int32()), ("j", pa.int32()))]
        return pa.table([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), *where], names=["kind", "a", "b", "pivot", "i", "j"])

    return rows.groupBy("pivot", "i", "j").applyInArrow(bound, "kind int, a long, b long, pivot long, i int, j int")


def _in_blocks(blocks: DataFrame, docs: DataFrame, ids: DataFrame, percent: int, k: int) -> DataFrame:
    """``a, b``: a spanning forest of the links between outside sets and all sets of their pivots."""
    wanted = materialize(ids.join(blocks.select("sig").distinct(), "sig").select("doc_id", "sig"), "candidates")
    sets = _fragments(docs, wanted, k, 1).select("sig", F.col("part").alias("s"))
    rows = blocks.join(materialize(sets, "whole-sets"), "sig").select("pivot", "i", "j", "outside", "sig", "s")

    def verify(t: pa.Table) -> pa.Table:
        out = t.column("outside").to_numpy()
        sig, s = t.column("sig").to_numpy(), np.empty(t.num_rows, object)
        s[:] = list(t.column("s").to_numpy())
        a, b = np.flatnonzero(out), np.flatnonzero(~out)
        n = np.array([len(x) for x in s])
        o = overlaps_of(list(s[a]), list(s[b]))
        linked = (100 * o >= percent * (n[a][:, None] + n[b] - o)) & (sig[a][:, None] != sig[b])
        root = forest(linked)
        of, at = np.r_[sig[a], sig[b]], np.flatnonzero(root >= 0)
        one, other = of[at], sig[a][root[at]] if len(at) else of[at]
        edges = np.unique(np.stack([one, other], 1)[one != other], axis=0)
        return pa.table({"a": pa.array(np.ascontiguousarray(edges[:, 0])), "b": pa.array(np.ascontiguousarray(edges[:, 1]))})

    return rows.groupBy("pivot", "i", "j").applyInArrow(verify, "a long, b long")
