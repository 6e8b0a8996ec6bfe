"""Best-fit packing of tokenised documents into sequences, certified by lower bounds.

Texts are tokenised once, on the map side; what moves on is one small row for each
piece. Pieces are dealt into partitions of bounded size, every n-th piece in the
order of lengths to each, so that all partitions have the same mix of lengths. Each
is packed best-fit decreasing, and a lower bound from dual feasible functions over
its lengths certifies its number of bins. The same bound over all lengths tells
when the whole is done. Until then the partitions exchange the pieces of their least
filled bins: these are dealt anew over fewer partitions and packed again, and a
repacking is kept only where it saves bins.
"""

from __future__ import annotations

import base64
import math
import os
import re
import zlib
from array import array
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import slices, small_table, texts
from newsloom.plans.scratch import materialize

#: Pieces in a partition (about), exchanges at most, entries of a worker's cache, characters above which a chunk isn't remembered, pieces of one length that are ranked together (about).
GROUP, ROUNDS, CACHE, LONGEST, RANKED = 20_000, 6, 200_000, 64, 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long, gap long, certified boolean"
#: Chunks that no pre-token of the byte-level pattern crosses; characters that Python takes for white space and the pattern doesn't (texts with them
#: are encoded whole); white space but " " and line ends, and runs of it, that only those chunks cut rightly; punctuation that ends a word, which is a pre-token of its own.
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_WHOLE = re.compile(r"[\x1c-\x1f\x85]")
_OTHER = re.compile(f"[{''.join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in ' \n')}]")
_RUN = re.compile(r"\s\s(?:\s|$)")
_TAIL = re.compile(r"(.*[A-Za-z])([.,;:!?]+)", re.S)
SPECIAL = "<|endoftext|>"
_encoders: dict[tuple[str, str], "Encoder"] = {}


class Chunks(dict):
    """Ids of chunks with ``before`` in front of each, remembered up to a bound."""

    def __init__(self, encode: Callable[[str], list[int]], before: str, bare: "Chunks | None" = None):
        super().__init__()
        self.encode, self.before, self.bare = encode, before, self if bare is None else bare

    def __missing__(self, chunk: str) -> bytes:
        if m := _TAIL.fullmatch(chunk):
            value = self[m[1]] + self.bare[m[2]]
        else:
            value = array("I", self.encode(self.before + chunk)).tobytes()
        if len(chunk) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = value
        return value


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, by chunks that a worker remembers.

    Whole texts with special strings go to the tokenizer itself. Chunks go to the
    same vocabulary as ranks, which gives the same ids in less time.
    """

    def __init__(self, path: str, ranks: str):
        import tiktoken
        from public_tokenizers import PATTERN

        self.path = path
        with open(ranks, "rb") as f:
            pairs = [line.split() for line in f]
        encode = tiktoken.Encoding(ranks, pat_str=PATTERN, mergeable_ranks={base64.b64decode(k): int(v) for k, v in pairs}, special_tokens={}).encode_ordinary
        self.bare = Chunks(encode, "")
        self.spaced = Chunks(encode, " ", self.bare)
        self.line_end = self.bare["\n"]

    @cached_property
    def tokenizer(self):
        """Loaded by the first text that needs it: few do, and its tables stay in the worker's memory."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> bytes:
        if SPECIAL in text:
            return self._whole(text)
        other = _OTHER.search(text)
        if other and _WHOLE.search(text):
            return self._whole(text)
        if other or (any(x in text for x in ("  ", "\n\n", " \n", "\n ")) and _RUN.search(text)):
            return b"".join([self.spaced[x[1:]] if x[0] == " " else self.bare[x] for x in _CHUNK.findall(text)])
        out = []
        for line in text.split("\n"):
            head, space, rest = line.partition(" ")
            out.append(self.bare[head])
            if space:
                out += map(self.spaced.__getitem__, rest.split(" "))
            out.append(self.line_end)
        return b"".join(out[:-1])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(path: str, ranks: str) -> Encoder:
    """One encoder for each worker process, whatever its tasks."""
    if (path, ranks) not in _encoders:
        _encoders[path, ranks] = Encoder(path, ranks)
    return _encoders[path, ranks]


def cut(ids: bytes, cap: int) -> list[tuple[int, int, int]]:
    """``(start, length, crc32)`` of the pieces of a document's ids; only the first piece of several may be shorter than ``cap``."""
    n = len(ids) // 4
    edges = [0, *range(n % cap or cap, n + 1, cap)]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(edges, edges[1:], strict=False)]


def pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str, end_id: int = 2, cap: int = 1024) -> DataFrame:
    """A row for each piece of each document: its ids and ``end_id``, cut only where they exceed ``cap``."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        ids_of = encoder(tokenizer_path, ranks_path).ids
        for b in slices(batches):
            rows = [(d, i, *p) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, p in enumerate(cut(ids_of(t) + end, cap))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(run, PIECES)


def bound_of(counts: np.ndarray, cap: int) -> float:
    """Bins that any packing of ``counts[length]`` pieces needs, by two families of dual feasible functions; not rounded up."""
    n = counts.astype(np.int64)
    x = np.arange(cap + 1, dtype=np.int64)
    best = int((n * x).sum()) / cap
    above = np.r_[np.cumsum(n[::-1])[::-1], 0]
    mass = np.r_[0, np.cumsum(n * x)]
    for a in range(1, cap // 2 + 1):  # over cap - a: a bin of its own; under a: nothing
        best = max(best, int(above[cap - a + 1]) + int(mass[cap - a + 1] - mass[a]) / cap)
    for k in range(1, 33):
        t = x * (k + 1)
        whole = t % cap == 0
        best = max(best, int((n * np.where(whole, x * k, t // cap * cap)).sum()) / (k * cap))
    return best


def lower_bound(lengths: np.ndarray, cap: int) -> float:
    """:func:`bound_of` for single lengths."""
    return bound_of(np.bincount(lengths, minlength=cap + 1), cap)


def best_fit_decreasing(lengths: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(cap + 1)]
    fill: list[int] = []
    mask = 0  # bit r: some bin has r left
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                mask ^= 1 << r
        else:
            b, r = len(fill), cap
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        if r > size:
            free[r - size].append(b)
            mask |= 1 << (r - size)
    return bins, offsets, np.array(fill, np.int64)


def _deal(items: DataFrame, counts: dict[int, int], parts: int, turn: int, cap: int) -> DataFrame:
    """Deal ``items``, of which ``counts`` have each length, over ``parts`` partitions in the order of lengths, and pack each.

    The rank in that order comes from the ranks within a length, taken in chunks of
    bounded size, and from the number of shorter pieces: ``cap`` numbers in all.
    """

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        lengths = p["length"].to_numpy(np.int64)
        b, at, fill = best_fit_decreasing(lengths, cap)
        certified = len(fill) <= math.ceil(lower_bound(lengths, cap))
        return p.assign(sequence_id=(turn << 56) + (int(p["part"].iloc[0]) << 28) + b, offset=at, gap=cap - fill[b], certified=certified).drop(columns="part")

    part = F.lit(0).cast("long")
    if parts > 1:
        lengths = sorted(counts)
        before = dict(zip(lengths, np.cumsum([0, *(counts[x] for x in lengths[:-1])]).tolist(), strict=True))
        starts = small_table(items.sparkSession, of=lengths, before=[before[x] for x in lengths], chunks=[-(-counts[x] // RANKED) for x in lengths])
        items = items.withColumn("key", F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(turn)))
        full = items.where(F.col("length") == cap).withColumn("at", F.col("key"))  # each is a sequence of its own, wherever it lies
        rest = items.where(F.col("length") < cap).join(F.broadcast(starts), F.col("length") == F.col("of")).withColumn("chunk", F.pmod("key", F.col("chunks")))
        rank = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("key", "doc_id", "piece", "ids_crc32"))
        items = rest.withColumn("at", F.col("before") + F.col("chunk") * RANKED + rank).select(*full.columns).unionByName(full)
        part = F.pmod(F.col("at"), F.lit(parts))
    dealt = items.select(*[c.split()[0] for c in PIECES.split(", ")], part.alias("part"))
    return dealt.groupBy("part").applyInPandas(pack, PACKED)


def pack(items: DataFrame, cap: int = 1024, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """``items`` (doc_id, piece, start, length, ids_crc32) with ``sequence_id, offset, gap, certified``.

    ``gap`` is what the sequence leaves free; ``certified`` tells that the partition
    which packed it cannot do with fewer. Repeated rows are packed as often as they
    occur. An empty table gives an empty result. A length over ``cap`` or under 1 is
    an error.
    """
    counted = lambda df: {r["length"]: r["n"] for r in df.groupBy("length").agg(F.count("*").alias("n")).collect()}  # noqa: E731  at most cap rows
    counts = counted(items)
    if any(not 1 <= x <= cap for x in counts):
        raise ValueError(f"lengths must lie between 1 and {cap}")
    n = np.zeros(cap + 1, np.int64)
    n[list(counts)] = list(counts.values())
    parts, least = max(1, -(-int(n.sum()) // group)), math.ceil(bound_of(n, cap))
    now = materialize(_deal(items, counts, parts, 0, cap), "packed")
    bins, want = now.where("offset = 0").count(), max(group, 8 * parts)
    for turn in range(1, rounds + 1):
        gaps = now.where("gap > 0").groupBy("gap").agg(F.count("*").alias("n"), F.count_if(F.col("offset") == 0).alias("bins")).collect() if bins > least else []  # at most cap rows
        pool, had, above = 0, 0, None
        for r in sorted(gaps, key=lambda r: -r["gap"]):  # the least filled first
            if pool and pool + r["n"] > want:
                break
            pool, had, above = pool + r["n"], had + r["bins"], r["gap"]
        if above is None:
            break
        open_ = now.where(F.col("gap") >= above).drop("sequence_id", "offset", "gap", "certified")
        parts = -(-pool // group)
        again = materialize(_deal(open_, counted(open_), parts, turn, cap), "packed")
        used = again.where("offset = 0").count()
        if used < had:
            now, bins, want = now.where(F.col("gap") < above).unionByName(again), bins - had + used, max(group, 8 * parts)
        elif pool == sum(r["n"] for r in gaps):
            break
        else:
            want = 2 * max(want, pool)
    return now


def pack_documents(docs: DataFrame, tokenizer_path: str, ranks_path: str, end_id: int = 2, cap: int = 1024) -> DataFrame:
    """Tokenise and pack ``docs (doc_id, text)``.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset, gap,
    certified`` (see :func:`pack`), a row for each piece. A null or empty text is one
    piece of one id, the end; a text of any length is encoded whole and cut; null ids
    and repeated rows are packed like others; an empty table gives no rows; other
    columns are ignored.
    """
    return pack(materialize(pieces(docs, tokenizer_path, ranks_path, end_id, cap), "pieces"), cap)
