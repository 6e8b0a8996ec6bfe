"""A corpus pipeline of five stages: toxicity, line dedup, n-gram Jaccard join, mixing, packing.

Each stage is ``(name, function)`` with ``function(spark, docs, sf_dir)``. All but the
last return the columns of ``documents``; the last returns the packed pieces. Each
stage works on every row that the one before it kept. ``run`` writes each stage's
result as Parquet into the shared folder and reads it back as the next one's input.

For all stages: null texts are empty and stay; null ids, null sources and rows that
repeat an id are rows like others; a text of any length is taken whole; an empty
table gives no rows; further columns, whatever their names, come through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import line_dedup, mixing, ngram_join, packing, toxicity
from newsloom.llm.common import table, tokenizer
from newsloom.plans.scratch import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go. It learns from the labelled documents outside the held-out fold. Texts without words have no hits and stay; equal texts score alike."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.without_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources repeat go but for their first occurrence, and with them documents that held nothing else. Documents that were empty stay; rows that share id and text are treated alike."""
    return line_dedup.dedup_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that links join, that of the least doc_id stays, once; of an id's rows, that of the least text hash. Null ids come last.

    Rows are told apart by doc_id and text, so rows that share an id, or have none, go only where links join them.
    Of rows equal in both one stays. Texts without words link with nothing and stay.
    """
    rows = ngram_join.labelled(docs).where("at is not null").groupBy("at", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    rows = materialize(rows, "groups")
    best = rows.groupBy("at").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("best"))
    marked = rows.join(best, "at").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash")))
    marked = materialize(marked.where("n > 1 or not stays").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__of"), "stays"), "marked")
    own = docs.withColumn("__hash", ngram_join.text_hash("text"))

    def among(some: DataFrame, how: str) -> DataFrame:
        side = F.broadcast(some) if some.count() <= ngram_join.BROADCAST_IDS else some
        return own.join(side, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__of")), how)

    kept = among(marked, "left_anti").select(*docs.columns)
    twice = marked.where("stays")
    return kept if twice.isEmpty() else kept.unionByName(among(twice, "left_semi").dropDuplicates(["doc_id", "__hash"]).select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, at most three times; of a source that whole documents leave short of its target, one more in part. Rows equal in id and text are drawn alike."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents of the mix; an empty text is one piece, each copy of a document has its own."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A learned lexicon, hashed draws and best-fit packing have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
