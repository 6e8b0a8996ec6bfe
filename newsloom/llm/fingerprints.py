"""MinHash fingerprints of whole texts, their likeness, and near-duplicate links by signature bands.

Signatures come from multiply-add hash permutations over 64-bit shingle hashes, in
numpy. A fingerprint keeps one byte of each minimum, as text; equal bytes by chance
are taken out of the likeness. The comparison with a neighbour in id order needs no
global sort: ids are cut into many ranges, each range is sorted where it lies, and
the first row of a range is sent to the range before it as well.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import ngram_join
from newsloom.llm.common import HASHES, SHINGLE, lists, shingles, texts, utf8
from newsloom.llm.ngram_join import cell_sizes, exact_overlaps, linked, outside_links, possible, set_signature
from newsloom.plans.components import connected_components
from newsloom.plans.scratch import materialize

#: Permutations, and rows of a band (32 bands of 4 find a pair at 0.8 but for 1 in 10^7).
PERMUTATIONS, BAND_ROWS = 128, 4
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**64, PERMUTATIONS, np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**64, PERMUTATIONS, np.uint64)


def signature(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """The least value of each permutation over the k-word shingles; all ones for a text without words."""
    s = shingles(text, HASHES, k)
    out = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(s), 1024):
        np.minimum(out, (np.multiply.outer(_A, s[lo : lo + 1024]) + _B[:, None]).min(1), out=out)
    return out


def digest(sig: np.ndarray) -> str:
    """A fingerprint: one byte of each minimum, from its high half, as base64."""
    return base64.b64encode((sig >> np.uint64(40)).astype(np.uint8).tobytes()).decode()


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity of two fingerprints, without the share of bytes that agree by chance."""
    x, y = (np.frombuffer(base64.b64decode(f), np.uint8) for f in (a, b))
    return max(0.0, float(((x == y).mean() - 1 / 256) / (1 - 1 / 256)))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points, rounded down, replaced by the first as many, or all, of another text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _ranges(docs: DataFrame, n: int) -> list[int]:
    """Ids that cut the distinct ids into at most ``n`` ranges of about equal counts, the least id first."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(n)], 100 * n)).first()[0]
    return sorted({*cuts, docs.agg(F.min("doc_id")).first()[0]}) if cuts else []


def fingerprints(docs: DataFrame, k: int = SHINGLE, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text of ``docs (doc_id, text)`` and of its edited text.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. The next document is that with the next id, the first
    after the last; of a single document, itself. A null text is empty; null ids
    come before all others; rows with equal ids follow each other by text. A text of
    any length is read whole, its shingles in slices. An empty table gives no rows.
    Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    t = texts(docs)
    n = ranges or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = _ranges(t, n)
    # the first row of each range: an id and, where ids repeat, the least text
    has_null = not t.where("doc_id is null").isEmpty()
    firsts = [None] * has_null + [c for c in cuts]
    at = F.lit(0)
    if cuts:
        at = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("doc_id"))) - (0 if has_null else 1))
    size = max(1, len(firsts))
    own = t.withColumn("bucket", at).withColumn("extra", F.lit(False))
    is_first = F.col("doc_id").isin([f for f in firsts if f is not None]) | F.col("doc_id").isNull()
    before = own.where(is_first).withColumn("bucket", F.pmod(F.col("bucket") - 1, F.lit(size))).withColumn("extra", F.lit(True))
    dealt = own.unionByName(before).repartition("bucket").sortWithinPartitions("bucket", "extra", "doc_id", "text")

    def run(batches):
        held = None  # a row that waits for its next

        def finish(row, following, out):
            d, text, sig = row
            e = edited(text, following[1])
            f, g = digest(sig), digest(signature(e.encode(), k))
            out.append((d, len(text), hashlib.sha256(e.encode()).hexdigest(), f, g, likeness(f, g), likeness(f, digest(following[2]))))

        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b, out = whole.slice(lo, 1000), []
                for d, text, bucket, extra in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    if extra and held is None:
                        continue  # a further row with the first id of the next range
                    row = (d, text, signature(text.encode(), k))
                    if held is not None:
                        finish(held, row, out)
                    held = None if extra else row
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.select("doc_id", "text", "bucket", "extra").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = SHINGLE) -> DataFrame:
    """``doc_id, component_id``: documents joined by signature bands whose sets were verified.

    Equal sets are one class. Classes of a small band are all compared; those of a
    large one first meet its pivot, the class that lies most in large bands, and what
    this leaves outside the pivot's component meets all classes of the pivot in blocks
    of bounded size. The exact Jaccard similarity of their sets decides. Texts without
    words are not returned. An empty table gives no rows.
    """

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                ids, n, sig, cells, bands = [], [], [], [], []
                for d, t in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                    if len(s := shingles(t, HASHES, k)):
                        ids.append(d)
                        n.append(len(s))
                        sig.append(set_signature(s))
                        cells.append(cell_sizes(s))
                        v = signature(t, k).reshape(-1, BAND_ROWS)
                        h = np.arange(len(v), dtype=np.uint64)
                        for i in range(BAND_ROWS):
                            h = (h ^ v[:, i]) * np.uint64(0x9E3779B97F4A7C15)
                            h ^= h >> np.uint64(29)
                        bands.append(h)
                yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()), "sig": pa.array(sig, pa.int64()), "cells": pa.array(cells, pa.binary()), "bands": lists(bands)})

    own = materialize(texts(docs).mapInArrow(run, "doc_id long, n long, sig long, cells binary, bands array<long>"), "signatures")
    classes = materialize(own.groupBy("sig").agg(F.min(F.struct("doc_id", "n", "cells", "bands")).alias("r")).select("sig", "r.*"), "classes")
    rows = classes.select("sig", "n", F.explode("bands").alias("band"))
    met = materialize(rows.join(rows.groupBy("band").agg(F.count("*").alias("m")).where("m > 1"), "band"), "met")
    few = met.where(F.col("m") <= ngram_join.SMALL)
    pairs = few.select(F.col("sig").alias("a"), "band").join(few.select(F.col("sig").alias("b"), "band"), "band").where("a < b").select("a", "b")
    large = met.where(F.col("m") > ngram_join.SMALL)
    often = large.groupBy("sig").agg(F.count("*").alias("k"))
    best = large.join(often, "sig").groupBy("band").agg(F.max(F.struct("k", "sig")).alias("p")).select("band", F.col("p.sig").alias("pivot"))
    pivots = materialize(large.join(best, "band").select("pivot", "sig").distinct(), "pivots")
    star = pivots.where("sig <> pivot").select(F.least("sig", "pivot").alias("a"), F.greatest("sig", "pivot").alias("b"))
    pairs = materialize(possible(pairs.unionByName(star).distinct(), classes.select("sig", "n", "cells"), percent), "band-pairs")
    links = linked(materialize(exact_overlaps(pairs, docs, classes.select("doc_id", "sig"), k), "overlaps"), percent).select("a", "b")
    labels = connected_components(links, "a", "b")
    more = outside_links(pivots, labels, classes, docs, percent, k)
    if more is not None:
        labels = connected_components(links.unionByName(more), "a", "b")
    at = classes.join(labels, F.col("sig") == F.col("node"), "left").select("sig", "doc_id", F.coalesce("component", "sig").alias("at"))
    least = at.groupBy("at").agg(F.min("doc_id").alias("component_id"))
    return own.select("doc_id", "sig").join(at.join(least, "at").select("sig", "component_id"), "sig").select("doc_id", "component_id")
