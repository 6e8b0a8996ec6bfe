"""Interpolated modified Kneser-Ney bigram model, counted in Spark, scored from memory-mapped sorted arrays.

Counting: each map task turns its texts into distinct (context, word) pairs with
counts, in numpy, and deals them out as a few compact rows per bucket of the
context's hash. A context that a bounded sample shows to be frequent is dealt by
both words, so that no bucket holds all of it. Each bucket sums its pairs and
writes sorted hash arrays into the shared folder. A second, smaller shuffle by
word gives counts and continuation counts. All statistics cover every training
text. Workers map the arrays and look up only what their own texts hold.

Order two is a measured choice: distinct trigrams alone would exceed the disk
limit of four times the input (README).
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import mix, texts, utf8, words
from newsloom.plans.scratch import materialize, scratch_path

#: Tokens that a counting or scoring task gathers at a time; documents sampled for frequent contexts.
COUNT_TOKENS, SCORE_TOKENS, SAMPLE_DOCS = 3_000_000, 1_000_000, 2_000
#: Bytes of training text for one bucket of the model's arrays (about).
BUCKET_BYTES = 32_000_000
#: Hashes have 56 bits. The start of a text and its end are tokens 0 and 1.
_BITS, START, END = 56, 1, 2
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_BLOB = "bucket int, u binary, glen binary, w binary, c binary"
_PART = "kind string, bucket int, a binary, b binary, c binary, d binary, e binary"


class _Ids(dict):
    """Words of the texts at hand to small numbers; ``hashes`` by number."""

    def __init__(self):
        super().__init__()
        self.hashes = [START, END]

    def __missing__(self, word: bytes) -> int:
        self.hashes.append(xxhash.xxh3_64_intdigest(word) >> (64 - _BITS))
        value = self[word] = len(self.hashes) - 1
        return value


def _numbered(text: bytes, ids: _Ids) -> np.ndarray:
    """Start, words, end."""
    w = words(text)
    out = np.empty(len(w) + 2, np.int64)
    out[0], out[-1] = 0, 1
    out[1:-1] = np.fromiter(map(ids.__getitem__, w), np.int64, len(w))
    return out


def _pairs(a: np.ndarray) -> np.ndarray:
    return (a[:-1] << np.int64(32)) | a[1:]


def _pack(x: np.ndarray) -> bytes:
    """56-bit hashes as 7 bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(b, np.uint8).reshape(-1, 7)
    return out.reshape(-1).view("<u8")


def _zip(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unzip(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def _sums(sorted_keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys of a sorted array, and the sums of ``columns`` for each."""
    if not len(sorted_keys):
        return sorted_keys, *columns
    first = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return sorted_keys[first], *(np.add.reduceat(c, first) for c in columns)


def _bucket(u: np.ndarray, w: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a pair: by its context, or by both words where the context is frequent."""
    is_hot = np.isin(u, hot)
    return (mix(np.where(is_hot, u * _PAIR + w, u)) % np.uint64(buckets)).astype(np.int32)


def _blobs(keys: np.ndarray, hashes: np.ndarray, hot: np.ndarray, buckets: int) -> pa.RecordBatch:
    key, count = np.unique(keys, return_counts=True)
    u, w = hashes[key >> 32], hashes[key & 0xFFFFFFFF]
    b = _bucket(u, w, hot, buckets)
    order = np.argsort(b, kind="stable")
    b, u, w, count = b[order], u[order], w[order], count[order].astype("<u4")
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]).tolist() + [len(b)]
    rows = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        first = np.flatnonzero(np.r_[True, u[lo + 1 : hi] != u[lo : hi - 1]])
        rows.append((int(b[lo]), _pack(u[lo:hi][first]), _zip(np.diff(np.r_[first, hi - lo]).astype("<u4")), _pack(w[lo:hi]), _zip(count[lo:hi])))
    kinds = (pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "u", "glen", "w", "c"])


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _save(uri: str, name: str, array: np.ndarray) -> None:
    """Write an array to the shared folder; a task that runs twice leaves the same file."""
    fs, root = _open(uri)
    fs.create_dir(root, recursive=True)
    part = f"{root}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        np.save(f, array, allow_pickle=False)
    fs.move(part, f"{root}/{name}.npy")


class Arrays:
    """Memory maps of the model's arrays. Where the shared folder can't be mapped, a private copy is, which goes with the worker."""

    def __init__(self, uri: str):
        self.fs, self.root = _open(uri)
        self.kept: dict[str, np.ndarray] = {}

    def get(self, name: str) -> np.ndarray:
        if name not in self.kept:
            path = f"{self.root}/{name}.npy"
            if isinstance(self.fs, pafs.LocalFileSystem):
                self.kept[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else np.empty(0, np.uint64)
            elif self.fs.get_file_info(path).type == pafs.FileType.NotFound:
                self.kept[name] = np.empty(0, np.uint64)
            else:
                with tempfile.NamedTemporaryFile(suffix=".npy") as copy, self.fs.open_input_stream(path) as f:
                    while block := f.read(1 << 24):
                        copy.write(block)
                    copy.flush()
                    self.kept[name] = np.load(copy.name, mmap_mode="r")
        return self.kept[name]

    def find(self, key: np.ndarray, bucket: np.ndarray, name: str, columns: tuple[str, ...]) -> list[np.ndarray]:
        """Values of ``columns`` for each key, 0 where it is absent."""
        out = [np.zeros(len(key), np.float64) for _ in columns]
        order = np.argsort(key)
        order = order[np.argsort(bucket[order], kind="stable")]
        b = bucket[order]
        cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]).tolist() + [len(b)] if len(b) else []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            there = self.get(f"{name}-{b[lo]}-key")
            if not len(there):
                continue
            at = order[lo:hi]
            place = np.minimum(np.searchsorted(there, key[at]), len(there) - 1)
            hit = there[place] == key[at]
            at, place = at[hit], place[hit]
            for o, c in zip(out, columns, strict=True):
                o[at] = self.get(f"{name}-{b[lo]}-{c}")[place]
        return out


@dataclass
class Model:
    """Where the arrays are, and the few numbers that go with them."""

    uri: str
    buckets: int
    hot: np.ndarray
    hot_stats: np.ndarray
    n: int
    v: int
    cont: float
    d2: np.ndarray
    d1: np.ndarray
    cc1: np.ndarray

    def unigram(self, cont: np.ndarray) -> np.ndarray:
        """Lower-order probability from continuation counts; the uniform share covers unknown words too."""
        rest = float((self.d1[1:] * self.cc1).sum()) / max(self.cont, 1.0)
        if not self.cont:
            return np.full(len(cont), 1.0 / (self.v + 1))
        less = self.d1[np.minimum(cont, 3).astype(np.int64)]
        return np.maximum(cont - less, 0) / self.cont + rest / (self.v + 1)


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, 3+, from the numbers of items counted once to four times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2) == 0:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(x, 0.05), k) for k, x in enumerate(d, 1))])


def frequent_contexts(docs: DataFrame, buckets: int) -> np.ndarray:
    """Hashes of words that a bounded sample of documents shows in more than 1 of ``8 * buckets`` tokens; at most so many."""
    step = max(1, docs.count() // SAMPLE_DOCS)

    def count(batches):
        ids, got = _Ids(), []
        for b in batches:
            got += [_numbered(t, ids)[:-1] for t in utf8(b.column(0))]
        if got:
            k, n = np.unique(np.concatenate(got), return_counts=True)
            top = np.argsort(-n)[: 32 * buckets]
            yield pa.record_batch({"u": pa.array(np.array(ids.hashes, np.int64)[k[top]]), "n": pa.array(n[top].astype(np.int64)), "total": pa.array(np.where(np.arange(len(top)) == 0, n.sum(), 0))})

    drawn = texts(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select("text")
    rows = drawn.mapInArrow(count, "u long, n long, total long").groupBy("u").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy(F.desc("n"), "u").limit(8 * buckets + 64).collect()
    total = sum(r["total"] for r in rows)
    return np.array(sorted({START, *(r["u"] for r in rows if r["n"] * 8 * buckets > total)}), np.uint64)


def train(docs: DataFrame, buckets: int | None = None) -> Model:
    """Count ``docs (doc_id, text)`` and write the model's arrays.

    Buckets grow with the bytes of text, so what a task merges doesn't; small corpora
    have two for each shuffle partition.
    """
    spark = docs.sparkSession
    if not buckets:
        size = texts(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    hot, uri = frequent_contexts(docs, buckets), scratch_path(spark, "lm")

    def count(batches):
        ids, got, held = _Ids(), [], 0
        for b in batches:
            for t in utf8(b.column(0)):
                got.append(_pairs(_numbered(t, ids)))
                held += len(got[-1])
                if held >= COUNT_TOKENS:
                    yield _blobs(np.concatenate(got), np.array(ids.hashes, np.uint64), hot, buckets)
                    ids, got, held = _Ids(), [], 0
        if got:
            yield _blobs(np.concatenate(got), np.array(ids.hashes, np.uint64), hot, buckets)

    def merge(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        parts = group.select(["u", "glen", "w", "c"]).to_pylist()
        u = np.concatenate([np.repeat(_unpack(p["u"]), _unzip(p["glen"], "<u4")) for p in parts])
        w = np.concatenate([_unpack(p["w"]) for p in parts])
        c = np.concatenate([_unzip(p["c"], "<u4") for p in parts]).astype(np.int64)
        pair = mix(u * _PAIR + w)
        order = np.argsort(pair)
        first = np.flatnonzero(np.r_[True, pair[order][1:] != pair[order][:-1]])
        c = np.add.reduceat(c[order], first)
        order = order[first]
        u, w = u[order], w[order]
        _save(uri, f"bi-{bucket}-key", pair[order])
        _save(uri, f"bi-{bucket}-n", c.astype(np.uint8 if c.max() < 256 else np.uint32 if c.max() < 2**32 else np.int64))
        by = np.argsort(u, kind="stable")
        ctx, *stats = _sums(u[by], *(x[by] for x in (c, (c == 1) * 1, (c == 2) * 1, (c >= 3) * 1)))
        is_hot = np.isin(ctx, hot)
        _save(uri, f"ctx-{bucket}-key", ctx[~is_hot])
        for name, s in zip(("n", "n1", "n2", "n3"), stats, strict=True):
            _save(uri, f"ctx-{bucket}-{name}", s[~is_hot].astype(np.uint32 if s.max() < 2**32 else np.int64))
        rows = [("hot", -1, ctx[is_hot].tobytes(), *(s[is_hot].astype(np.int64).tobytes() for s in stats))]
        cc = np.array([(c == k).sum() for k in (1, 2, 3, 4)], np.int64)
        rows.append(("cc", -1, cc.tobytes(), b"", b"", b"", b""))
        by = np.argsort(w, kind="stable")
        word, n, cont = _sums(w[by], c[by], np.ones(len(c), np.int64))
        to = (mix(word) % np.uint64(buckets)).astype(np.int32)
        by = np.argsort(to, kind="stable")
        to, word, n, cont = to[by], word[by], n[by], cont[by]
        cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]).tolist() + [len(to)]
        rows += [("w", int(to[lo]), _pack(word[lo:hi]), _zip(n[lo:hi]), _zip(cont[lo:hi]), b"", b"") for lo, hi in zip(cuts, cuts[1:], strict=False)]
        return pa.Table.from_pylist([dict(zip(("kind", "bucket", "a", "b", "c", "d", "e"), r, strict=True)) for r in rows], pa.schema([("kind", pa.string()), ("bucket", pa.int32()), *((k, pa.binary()) for k in "abcde")]))

    def by_word(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        parts = group.select(["a", "b", "c"]).to_pylist()
        w = np.concatenate([_unpack(p["a"]) for p in parts])
        by = np.argsort(w, kind="stable")
        w, n, cont = _sums(w[by], *(np.concatenate([_unzip(p[k], "<i8") for p in parts])[by] for k in "bc"))
        _save(uri, f"uni-{bucket}-key", w)
        _save(uri, f"uni-{bucket}-n", n)
        _save(uri, f"uni-{bucket}-cont", cont)
        said = {"v": len(w), "n": int(n.sum()), "cont": int(cont.sum()), "cc": [int((cont == k).sum()) for k in (1, 2, 3, 4)], "more": int((cont >= 3).sum())}
        return pa.table({"said": [json.dumps(said)]})

    blobs = texts(docs).select("text").mapInArrow(count, _BLOB)
    parts = materialize(blobs.groupBy("bucket").applyInArrow(merge, _PART), "lm-parts")
    said = [json.loads(r["said"]) for r in parts.where("kind = 'w'").groupBy("bucket").applyInArrow(by_word, "said string").toLocalIterator()]
    stats = np.zeros((len(hot), 4))
    cc2 = np.zeros(4)
    for r in parts.where("kind <> 'w'").toLocalIterator():  # a row for each bucket, of at most 8 contexts for each bucket
        if r["kind"] == "cc":
            cc2 += np.frombuffer(r["a"], np.int64)
        elif r["a"]:
            at = np.searchsorted(hot, np.frombuffer(r["a"], np.uint64))
            stats[at] += np.stack([np.frombuffer(r[k], np.int64) for k in "bcde"], 1)
    cc1 = np.sum([s["cc"] for s in said], 0) if said else np.zeros(4)
    more = np.array([cc1[0], cc1[1], sum(s["more"] for s in said)], float)
    return Model(uri, buckets, hot, stats, sum(s["n"] for s in said), sum(s["v"] for s in said), float(sum(s["cont"] for s in said)), discounts(cc2), discounts(cc1), more)


def score_tokens(arrays: Arrays, m: Model, sequences: list[np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log10 probability, log10 add-one unigram probability and training count of each token of ``sequences`` after its start."""
    key, at = np.unique(np.concatenate([_pairs(s) for s in sequences]), return_inverse=True)
    n, cont = arrays.find(hashes, (mix(hashes) % np.uint64(m.buckets)).astype(np.int32), "uni", ("n", "cont"))
    ctx = np.stack(arrays.find(hashes, (mix(hashes) % np.uint64(m.buckets)).astype(np.int32), "ctx", ("n", "n1", "n2", "n3")), 1)
    place = np.minimum(np.searchsorted(m.hot, hashes), len(m.hot) - 1)
    is_hot = m.hot[place] == hashes
    ctx[is_hot] = m.hot_stats[place[is_hot]]
    ui, wi = key >> 32, key & 0xFFFFFFFF
    u, w = hashes[ui], hashes[wi]
    (c,) = arrays.find(mix(u * _PAIR + w), _bucket(u, w, m.hot, m.buckets), "bi", ("n",))
    low = m.unigram(cont)[wi]
    total = ctx[ui, 0]
    seen = np.maximum(total, 1)
    back = (ctx[ui, 1:] * m.d2[1:]).sum(1) / seen
    p = np.where(total > 0, np.maximum(c - m.d2[np.minimum(c, 3).astype(np.int64)], 0) / seen + back * low, low)
    base = np.log10((n[wi] + 1) / (m.n + m.v + 1))
    return np.log10(p)[at], base[at], n[wi][at]


def score(docs: DataFrame, model: Broadcast) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of each text under a broadcast :class:`Model`.

    Tokens are words after lower-casing A-Z and one end of text. A null or empty
    text has one token, its end; null ids and repeated rows are kept; a text of any
    length is scored whole; an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        m = model.value
        arrays = Arrays(m.uri)

        def flush(doc_ids, seqs, ids):
            p, base, n = score_tokens(arrays, m, seqs, np.array(ids.hashes, np.uint64))
            sizes = np.array([len(s) - 1 for s in seqs])
            first = np.r_[0, np.cumsum(sizes)[:-1]]
            add = lambda x: pa.array(np.add.reduceat(x, first))
            return pa.record_batch({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(sizes.astype(np.int64)), "n_known": add((n > 0).astype(np.int64)), "base_score": add(base), "score": add(p)})

        doc_ids, seqs, held, ids = [], [], 0, _Ids()
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                doc_ids.append(d)
                seqs.append(_numbered(t, ids))
                held += len(seqs[-1])
                if held >= SCORE_TOKENS:
                    yield flush(doc_ids, seqs, ids)
                    doc_ids, seqs, held, ids = [], [], 0, _Ids()
        if seqs:
            yield flush(doc_ids, seqs, ids)

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def crc(doc_id: str = "doc_id"):
    """crc32 of an id's decimal text; of a null id, of the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def kneser_ney_scores(docs: DataFrame, folds: int = 7, held_out: int = 2) -> DataFrame:
    """Score all texts with a model of those whose id isn't in the held-out fold.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``
    and ``perplexity`` (10 to the minus score by token). With no training text all
    words are unknown and the vocabulary is empty.
    """
    fold = F.pmod(crc(), F.lit(folds)) == held_out
    model = train(docs.where(~fold))
    out = score(docs, docs.sparkSession.sparkContext.broadcast(model))
    return out.select("doc_id", fold.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
