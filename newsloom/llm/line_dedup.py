"""Removal of lines that many sites repeat, with DataFrame functions only.

Each text is split and hashed once; its lines go, as small rows, into the shared
folder. A HyperLogLog sketch of the sites of each line's hash is built by one
aggregation with map-side merging, so a line that a third of all documents hold
costs one row a task. Lines whose estimate lies near the threshold get exact distinct
counts; the estimates decide the rest. The first occurrence of a line stays.

Shuffles grow in proportion to the input: places of lines meet boilerplate hashes by
merge join (adaptive execution splits a hot hash), and texts meet the places that they
lose by merge join on their id and hash. Only the hashes of lines near the threshold are broadcast, up to a stated number
that is counted first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.plans.scratch import materialize

#: Distinct sites that make a line boilerplate; log2 of a sketch's size.
MIN_SITES, LG_K = 5, 12
#: Lines near the threshold up to which their hashes, of eight bytes, are sent to all tasks; beyond, all lines are dealt by hash. The result is the same.
NEAR = 500_000
OUT = "__lines"


def line_hash(line: Column) -> Column:
    """64-bit hash of a line without spaces, tabs and carriage returns at its ends; null for a blank one."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.xxhash64(bare))


def places(docs: DataFrame) -> DataFrame:
    """``doc_id, key, site, i, h``: hash and place of each line that isn't blank; ``key`` is the hash of its text."""
    hashes = F.transform(F.split("text", "\n", -1), line_hash)
    site = F.coalesce(F.col("source").cast("string"), F.lit(""))
    whole = docs.select("doc_id", F.xxhash64("text").alias("key"), site.alias("site"), hashes.alias("hashes"))  # before the explosion, which else copies the text to each line
    return whole.select("doc_id", "key", "site", F.posexplode("hashes").alias("i", "h")).where("h is not null")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``h, first``: hashes of ``lines`` (see :func:`places`) on at least ``min_sites`` sites, and the first place of each."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "i"))
    spread = lines.groupBy("h").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), first.alias("first"))
    margin = max(1, -(-3 * min_sites * 104 // (100 * 2 ** (LG_K // 2))))
    seen = materialize(spread.select("h", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites - margin), "spread")
    clear = seen.where(F.col("sites") > min_sites + margin).select("h", "first")
    near = seen.where(F.col("sites") <= min_sites + margin).select("h", "first")
    if near.count() <= NEAR:  # a lookup of this size is kept by each task, and no other line is shuffled again
        sites = lines.select("h", "site").join(F.broadcast(near.select("h")), "h", "left_semi").distinct()
    else:
        sites = lines.select("h", "site").distinct()
    exact = sites.join(near.hint("merge"), "h").groupBy("h").agg(F.count("*").alias("sites"), F.first("first").alias("first"))
    return clear.unionByName(exact.where(F.col("sites") >= min_sites).select("h", "first"))


def _marked(docs: DataFrame, min_sites: int, *keep: str) -> DataFrame:
    """``row`` (the columns ``keep``, or all), ``n, removed, kept``: number of lines, of those removed, and the text without them."""
    lines = materialize(places(docs), "lines")
    found = materialize(boilerplate(lines, min_sites), "boilerplate")
    held = lines.select("doc_id", "key", "i", "h").join(found.hint("merge"), "h")
    again = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key")) & (F.col("i") == F.col("first.i")))
    gone = held.where(again).groupBy(F.col("doc_id").alias("of"), F.col("key").alias("of_key")).agg(F.collect_set("i").alias("gone"))
    rows = docs.select(F.struct(*(keep or ("*",))).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    both = rows.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    both = both.select("row", F.split("row.text", "\n", -1).alias("lines"), "gone")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(stay, lambda i: F.col("lines")[i]), "\n"))
    return both.select("row", F.coalesce(F.array_size("lines"), F.lit(0)).alias("n"), F.coalesce(F.array_size("gone"), F.lit(0)).alias("removed"), text.alias("kept"))


def mark_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` and a struct ``__lines (n, removed, text)``: its lines, those removed, and the text without them.

    A line goes if its hash occurs on at least ``min_sites`` distinct sources, except
    for its first occurrence, in the document of the least doc_id that holds it (of
    rows that share it, the least text hash; ids that are null come last). A null
    source counts as one site of its own, a blank line never goes, and a null text
    has no lines and stays null. Rows that repeat a doc_id and text are treated alike.
    Work is linear in a text's lines, however long it is. An empty table gives no
    rows. Other columns, whatever their names, are kept; only one named ``__lines``
    is replaced.
    """
    out = _marked(docs, min_sites)
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != OUT], F.struct("n", "removed", F.col("kept").alias("text")).alias(OUT))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` without boilerplate lines, in the columns they have. A document that had text and has none left goes.

    A column ``n_chars``, where there is one, gets the length of the new text. For
    nulls, repeated rows, long texts and empty tables see :func:`mark_lines`.
    """
    out = _marked(docs, min_sites).where("removed = 0 or kept rlike '\\\\S'")
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("removed") > 0, F.length("kept").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def line_digest(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_chars, kept_sha256`` of each document (null text: 0 lines, the empty text)."""
    text = F.coalesce("kept", F.lit(""))
    return _marked(docs, min_sites, "doc_id", "text").select("row.doc_id", F.col("n").cast("long").alias("n_lines"), F.col("removed").cast("long").alias("n_removed"), F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


LINE_DIGEST_SQL = f"""
with parts as (select doc_id, coalesce(source, '') as site, string_split(text, chr(10)) as p from documents where text is not null),
lines as (select doc_id, site, unnest(p) as line, generate_subscripts(p, 1) as i from parts),
keyed as (select *, trim(line, ' ' || chr(9) || chr(13)) as k from lines),
bad as (select k, min(doc_id) as first_doc from keyed where k <> '' group by k having count(distinct site) >= {MIN_SITES}),
placed as (select keyed.*, row_number() over (partition by keyed.doc_id, keyed.k order by i) as nth, bad.k is not null as is_bad, first_doc from keyed left join bad on keyed.k = bad.k),
kept as (select *, not is_bad or (doc_id is not distinct from first_doc and nth = 1) as keep from placed),
own as (select doc_id, count(*) as n, count(*) filter (where not keep) as removed, coalesce(string_agg(line, chr(10) order by i) filter (where keep), '') as text from kept group by doc_id)
select d.doc_id, coalesce(own.n, 0)::bigint as n_lines, coalesce(own.removed, 0)::bigint as n_removed, length(coalesce(own.text, ''))::bigint as kept_chars, sha256(coalesce(own.text, '')) as kept_sha256
from documents d left join own on d.doc_id = own.doc_id
"""
