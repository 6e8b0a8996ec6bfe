"""Token counts with a two-tier map-side lookup.

A SentencePiece BPE model whose pieces never hold a space mark after another
character cannot merge across the start of a run of spaces. A text therefore
splits into pre-tokens (a run of spaces and what follows up to the next space)
whose token counts add up. Tier one is a broadcast hash table of the lengths of
frequent pre-tokens, drawn from a bounded sample of documents; it changes speed,
never results. Tier two is each worker's bounded cache, which encodes a missing
pre-token once. No pre-token is ever shuffled.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import texts, utf8

#: Sampled documents, entries of the broadcast table, entries of a worker's cache, and bytes above which a pre-token isn't remembered.
SAMPLE_DOCS, TABLE, CACHE, LONGEST = 2_000, 65_536, 400_000, 64
_MARK = "▁".encode()
_RUNS = re.compile(rb" +[^ ]*")


def pre_tokens(text: bytes) -> list[bytes]:
    """Pre-tokens without the space that each one starts with; the model puts one space before the text."""
    if not text:
        return []
    spaced = b" " + text.replace(_MARK, b" ")
    if b"  " in spaced or spaced[-1] == 32:
        return [x[1:] for x in _RUNS.findall(spaced)]
    return spaced[1:].split(b" ")


def splits_at_spaces(model: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether counts of pre-tokens add up: no piece continues over the start of a run of spaces, and one space is put before a text."""
    inside = any("▁" in (p := model.id_to_piece(i)).lstrip("▁") for i in range(model.get_piece_size()) if not model.is_control(i))
    return not inside and model.encode("a  b \n c") == [t for x in (b"a", b" b", b"\n", b"c") for t in model.encode(x.decode())]


def length_of(model: sentencepiece.SentencePieceProcessor, key: bytes) -> int:
    """Tokens of a pre-token with the space before it."""
    if not key:  # the model has nothing for an empty text: take the space from a longer one
        return len(model.encode("a ")) - len(model.encode("a"))
    return len(model.encode(key.decode("utf-8", "replace")))


class Lengths(dict):
    """Tier two over tier one: counts of pre-tokens, encoded when first met."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor, frequent: dict[bytes, int]):
        super().__init__(frequent)
        self.model, self.frequent = model, frequent

    def __missing__(self, key: bytes) -> int:
        value = length_of(self.model, key)
        if len(key) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
                self.update(self.frequent)
            self[key] = value
        return value


def frequent_lengths(docs: DataFrame, model_path: str, sample_docs: int = SAMPLE_DOCS, size: int = TABLE) -> dict[bytes, int]:
    """Lengths of the most frequent pre-tokens of about ``sample_docs`` documents chosen by hash: at most ``size`` entries."""
    step = max(1, docs.count() // sample_docs)

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in utf8(b.column(0)):
                seen.update(x for x in pre_tokens(t) if len(x) <= LONGEST)
        top = seen.most_common(size)
        yield pa.record_batch({"token": pa.array([k for k, _ in top], pa.binary()), "n": pa.array([v for _, v in top], pa.int64())})

    drawn = texts(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select("text")
    top = drawn.mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(size)
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return {(k := bytes(r["token"])): length_of(model, k) for r in top.toLocalIterator()}


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs (doc_id, text)``.

    A null text counts as empty (0 tokens); a null doc_id and repeated rows are
    kept as they are; a text of any length is counted whole; an empty table gives no
    rows. Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    apart = splits_at_spaces(sentencepiece.SentencePieceProcessor(model_file=model_path))
    frequent = spark.sparkContext.broadcast(frequent_lengths(docs, model_path) if apart else {})

    def run(batches):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        length = Lengths(model, frequent.value).__getitem__
        for b in batches:
            raw = utf8(b.column(1))
            n = [sum(map(length, pre_tokens(t))) for t in raw] if apart else [len(model.encode(t.decode())) for t in raw]
            yield pa.record_batch({"doc_id": b.column(0), "n_bytes": pa.array(map(len, raw), pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
