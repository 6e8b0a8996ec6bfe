"""The pipeline's stages on the smallest tables: columns, decisions, and each stage on all that the one before kept."""

from collections import Counter

import numpy as np

import corpus_pipeline
from pyspark.sql import functions as F

from newsloom.llm import line_dedup, ngram_join, packing, toxicity
from newsloom.llm.common import table, tokenizer

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "mixing", "packing"]
    docs = table(spark, SF, "documents").persist()
    stages = dict(corpus_pipeline.STAGES)
    out = stages["toxicity"](spark, docs, SF).persist()
    assert out.columns == docs.columns
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(docs, table(spark, SF, "labels")).collect()}
    assert {r["doc_id"] for r in out.collect()} == {d for d, p in scored.items() if not p}

    lines = stages["line_dedup"](spark, out, SF).persist()
    marks = {r["doc_id"]: r[line_dedup.OUT] for r in line_dedup.mark_lines(out).collect()}
    assert lines.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == {d: m["text"] for d, m in marks.items() if not m["removed"] or (m["text"] or "").strip()}
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect() if r["text"] is not None and marks[r["doc_id"]]["removed"])

    one = stages["ngram_jaccard_join"](spark, lines, SF).persist()
    groups = ngram_join.jaccard_components(lines).collect()
    assert one.columns == docs.columns
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({r["component_id"] for r in groups})

    mix = stages["mixing"](spark, one, SF).persist()
    assert mix.columns == docs.columns and max(Counter(r["doc_id"] for r in mix.collect()).values()) <= 3

    packed = stages["packing"](spark, mix, SF).collect()
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want = sum(len(tk.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in mix.collect())
    assert sum(r["length"] for r in packed) == want
    least = packing.lower_bound(np.array([r["length"] for r in packed]), 1024)  # long pieces may leave gaps that nothing fits
    assert len({r["sequence_id"] for r in packed}) <= 1.02 * least + 2


def test_repeated_rows_leave_one(spark):
    docs = table(spark, SF, "documents").limit(20)
    twice = docs.unionByName(docs)
    out = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, twice, SF)
    assert out.count() == out.select("doc_id").distinct().count()


def test_rows_of_one_id_go_only_where_links_join_them(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(None, a), (None, b), (None, a), (1, c), (1, "one more text of the same id"), (2, c), (3, c + " end"), (1, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, SF)
    want = [(None, a), (None, b), (1, c), (1, "one more text of the same id"), (1, ""), (None, None)]
    assert Counter(map(tuple, out.collect())) == Counter(want)


def test_stages_keep_columns_whose_names_they_use_themselves(spark):
    names = "gone once h i n lines kept key row first node at of of_key block blocks copy copies cut shard shards size gap taken passes rest score predicted sig prefix common cells text_hash stays best sequence_id offset piece".split()
    rows = [(i if i % 7 else None, f"line that all sites share\n{' '.join(f'w{i % 20}x{j}' for j in range(30))}", f"s{i % 6}") for i in range(40)]
    docs = spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(f"own {x}").alias(x) for x in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names], name
        got = docs.collect()
        assert got and all(r[x] == f"own {x}" for r in got for x in names), name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() >= docs.count()


def test_empty_corpus(spark):
    docs = table(spark, SF, "documents").where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_a_batch_of_long_texts_is_never_python_objects_as_a_whole(spark, monkeypatch):
    """Spark's batches hold 10,000 rows; what a worker makes of one at once, it keeps in memory for all later stages."""
    docs = spark.range(400).coalesce(1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id").cast("string"), F.repeat(F.lit("some words "), 3_000)).alias("text"))

    def small(got):
        got = list(got)
        assert sum(map(len, got)) <= 4_000_000, "13 MB at once"
        return got

    scorer, utf8 = toxicity.scorer, ngram_join.utf8
    monkeypatch.setattr(toxicity, "scorer", lambda model: lambda texts: scorer(model)(small(texts)))
    monkeypatch.setattr(ngram_join, "utf8", lambda column: small(utf8(column)))
    model = toxicity.Model({" zzz ": 3.0}, np.array([-3.0, 0.5, 1.0]))
    assert toxicity.without_toxic(docs, model).count() == toxicity.score(docs, model).count() == 400
    assert ngram_join.signatures(docs, np.empty(0, np.uint64), 80).where("n > 0").count() == 400


def test_mixing_and_packing_hold_little_beside_the_texts(spark, monkeypatch):
    """Small tables come without Python rows, whose workers stay on each executor; the tokenizer is loaded only for texts that need it."""
    docs = table(spark, SF, "documents")
    made, plain = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: (made.append(type(data)), plain(self, data, *a, **b))[1])
    stages = dict(corpus_pipeline.STAGES)
    mix = stages["mixing"](spark, docs, SF)
    assert mix.count() > 0
    items = packing.pieces(docs, tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"))
    assert packing.pack(items, group=100).count() == items.count()
    assert made and list not in made
    e = packing.Encoder(tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"))
    e.ids("a plain text\nof two lines")
    assert "tokenizer" not in vars(e)
    e.ids(f"one with {packing.SPECIAL}")
    assert "tokenizer" in vars(e)
