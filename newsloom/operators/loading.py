"""Idempotent import, reference checks, enrichment and what it leaves in the tables."""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import slug
from newsloom.plans.scratch import materialize
from newsloom.schema import ENRICHMENT, ORG_TYPES
from newsloom.session import ship

# Topics of the taxonomy with their category.
TOPIC_CATEGORIES = {
    "政治": "Politics", "经济": "Economy", "外交": "Politics", "军事": "Military", "科技": "Technology", "社会": "Society",
    "文化": "Culture", "生态": "Environment", "国际关系": "Politics", "中美关系": "Politics", "一带一路": "Economy", "乡村振兴": "Economy",
    "高质量发展": "Economy", "改革开放": "Economy", "党的建设": "Politics", "法治建设": "Law", "民生保障": "Society", "国防安全": "Military",
}
#: Organizations and people kept of each item, characters of text that enrichment needs at least and sends at most.
KEPT, SHORTEST, LONGEST = 5, 50, 4000
RESULT = f"struct<{ENRICHMENT.replace(' ', ':').replace(',:', ',')}>"


def compare_import(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """``news_id, state`` (new, same, changed) of each incoming item against what is there."""
    columns = ("title", "full_text", "broadcast_date", "order_in_broadcast")
    old = existing.select("news_id", F.lit(True).alias("known"), *[F.col(c).alias(f"old_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    state = F.when(F.col("known").isNull(), "new").when(same, "same").otherwise("changed")
    return incoming.join(old, "news_id", "left").select("news_id", state.alias("state"))


def import_errors(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """``news_id, reason`` of each incoming item that an import can't take: no title or text, an id that stands for several contents within the batch, a known id with other content."""
    columns = ("title", "full_text", "broadcast_date", "order_in_broadcast")
    empty = incoming.where((F.coalesce(F.trim("title"), F.lit("")) == "") | (F.coalesce(F.trim("full_text"), F.lit("")) == "")).select("news_id", F.lit("no title or text").alias("reason"))
    several = incoming.groupBy("news_id").agg(F.count_distinct(F.xxhash64(*columns)).alias("n")).where("n > 1 or news_id is null").select("news_id", F.when(F.col("news_id").isNull(), "no id").otherwise("several contents in the batch").alias("reason"))
    changed = compare_import(incoming, existing).where("state = 'changed'").select("news_id", F.lit("known with other content").alias("reason"))
    return empty.unionByName(several).unionByName(changed).distinct()


def import_items(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """The table after an import, or an error that leaves all as it was.

    New items are added, rows that repeat an item once; known ones keep what they have
    and get a URL where they had none, the least of several. What :func:`import_errors`
    finds, or an empty batch, is an error.
    """
    if incoming.isEmpty():
        raise ValueError("nothing to import")
    bad = [f"{r['reason']}: {r['n']}" for r in import_errors(incoming, existing).groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason").collect()]
    if bad:
        raise ValueError("; ".join(bad))
    once = incoming.groupBy("news_id").agg(F.min("url").alias("new_url"), *[F.min(c).alias(c) for c in incoming.columns if c not in ("news_id", "url")])
    kept = existing.join(once.select("news_id", "new_url"), "news_id", "left").withColumn("url", F.coalesce("url", "new_url")).drop("new_url")
    new = once.join(existing.select("news_id"), "news_id", "left_anti").withColumnRenamed("new_url", "url").withColumn("word_count", F.length("full_text"))
    return kept.unionByName(new, allowMissingColumns=True)


def orphans(links: DataFrame, key: str, dim: DataFrame, dim_key: str, name: str) -> DataFrame:
    """``relation, value``: references of ``links.key`` that the dimension lacks."""
    own = links.where(F.col(key).isNotNull()).select(F.col(key).alias("value")).distinct()
    return own.join(dim.select(F.col(dim_key).alias("value")), "value", "left_anti").select(F.lit(name).alias("relation"), F.col("value").cast("string").alias("value"))


def check_references(*found: DataFrame) -> None:
    """Raise if any of the tables that :func:`orphans` gives has rows; one job for all."""
    if not found:
        return
    all_ = reduce(DataFrame.unionByName, found)
    some = all_.groupBy("relation").agg(F.count("*").alias("n")).orderBy("relation").collect()
    if some:
        raise ValueError(f"{sum(r['n'] for r in some)} references lead nowhere: " + ", ".join(f"{r['relation']} {r['n']}" for r in some))


def first_writer(rows: DataFrame, keys: list[str], order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """The first row of each key, of keys that aren't there yet."""
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
    return first if existing is None else first.join(existing.select(*keys), keys, "left_anti")


def strip_fence(text: Column) -> Column:
    """The content of a fenced block, or the text itself."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*\n?", ""), r"\n?```\s*$", ""))


def parse_reply(reply: Column) -> Column:
    """A provider's JSON reply as :data:`ENRICHMENT`; null where it can't be read or has no summary.

    A wrapper object ``article_analysis`` is opened; a summary may be a text or an
    object with ``short``; list elements may be bare names.
    """
    v = F.try_parse_json(strip_fence(reply))
    v = F.coalesce(F.try_variant_get(v, "$.article_analysis", "variant"), v)
    text = lambda x, path: F.try_variant_get(x, path, "string")
    each = lambda path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    name = lambda x: F.coalesce(text(x, "$.name"), text(x, "$"))
    summary = F.coalesce(text(v, "$.summary.short"), F.when(~F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.summary", "variant")), F.lit("")).startswith("OBJECT"), text(v, "$.summary")))
    out = F.struct(
        summary.alias("summary"),
        F.transform(each("$.keywords"), lambda x: text(x, "$")).alias("keywords"),
        F.transform(each("$.topics"), lambda x: F.struct(name(x).alias("name"), F.coalesce(F.try_variant_get(x, "$.relevance", "double"), F.lit(0.5)).alias("relevance"))).alias("topics"),
        F.transform(each("$.entities.people"), lambda x: F.struct(name(x).alias("name"), text(x, "$.title").alias("title"))).alias("people"),
        F.transform(each("$.entities.organizations"), lambda x: F.struct(name(x).alias("name"), F.coalesce(text(x, "$.type"), F.lit("government")).alias("type"))).alias("organizations"),
        F.to_json(F.try_variant_get(v, "$.entities", "variant")).alias("entities"),
        F.when(F.size(each("$.policy_signals")) > 0, F.to_json(F.try_variant_get(v, "$.policy_signals", "variant"))).alias("signals"),
        F.transform(each("$.policy_signals"), lambda x: F.struct(text(x, "$.signal").alias("signal"), text(x, "$.type").alias("type"), text(x, "$.evidence").alias("evidence"))).alias("policy_signals"),
    )
    return F.when(F.coalesce(summary, F.lit("")) != "", out)


def infer_organization(title: Column, organizations: Column) -> Column:
    """The first organization of which a word of three letters or more occurs in a person's title."""
    held = F.filter(F.slice(organizations, 1, KEPT), lambda o: F.exists(F.split(o["name"], " "), lambda p: (F.length(p) >= 3) & F.contains(title, p)))
    return F.get(held, F.lit(0))["name"]


def pending(items: DataFrame, limit: int = 0) -> DataFrame:
    """Items to enrich, by id; all of them for limit 0. Those with too little text are skipped by :func:`enrich`."""
    own = items.where(F.coalesce("summary", F.lit("")) == "")
    return own.orderBy("news_id").limit(limit) if limit else own


def stub(text: str) -> str:
    """A provider that needs no network: the first sentence as summary and the longest words as keywords."""
    words = sorted(set(text.split()), key=lambda w: (-len(w), w))[:3]
    return json.dumps({"summary": {"short": text.split("。")[0].split(". ")[0][:120]}, "keywords": words, "topics": [], "entities": {}}, ensure_ascii=False)


class Busy(Exception):
    """What a provider raises where another try may succeed: too many requests, an error of the server."""


def with_retries(provider: Callable[[str], str], tries: int = 3, first_wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """``provider`` with up to ``tries`` calls for a text, and twice the wait before each further one, where it is :class:`Busy` or the network fails."""

    def call(text: str) -> str:
        for i in range(tries):
            try:
                return provider(text)
            except (Busy, OSError):
                if i + 1 == tries:
                    raise
                sleep(first_wait * 2**i)

    return call


def called(provider: Callable[[str], str], batches: Iterator[pa.RecordBatch], concurrency: int) -> Iterator[pa.RecordBatch]:
    """``news_id, reply, reason`` for rows ``news_id, text``: a pool of ``concurrency`` threads calls the provider, an item at a time.

    At most four items for each thread wait at once, so that a slow provider holds back
    the reading of the input. What a call raises is the reason of its item alone.
    """
    with ThreadPoolExecutor(concurrency) as pool:
        for b in batches:
            replies, reasons, waiting = [], [], deque()

            def take(replies=replies, reasons=reasons, waiting=waiting):
                call = waiting.popleft()
                error = call.exception()
                replies.append(None if error or not isinstance(call.result(), str) else call.result())
                reasons.append(f"{type(error).__name__}: {error}" if error else None if replies[-1] is not None else "no reply")

            for text in b.column(1).to_pylist():
                if len(waiting) >= 4 * concurrency:
                    take()
                waiting.append(pool.submit(provider, text))
            while waiting:
                take()
            yield pa.record_batch([b.column(0), pa.array(replies, pa.string()), pa.array(reasons, pa.string())], names=["news_id", "reply", "reason"])


def enrich(items: DataFrame, provider: Callable[[str], str] = stub, limit: int = 0, concurrency: int = 3, tasks: int | None = None, dry_run: bool = False) -> DataFrame:
    """``news_id, status, reason, result`` of each pending item, of the first ``limit`` by id if given; the provider turns a text into a reply.

    Each task calls the provider for ``concurrency`` items at a time; there are as many
    tasks as the input has partitions, or ``tasks`` to keep a service's limits. An error,
    or a reply that can't be read or has no summary, fails its item alone and says why.
    Items with too little text are skipped; a dry run calls nothing and says ``pending``.
    A lost executor repeats the calls of its tasks.
    """
    if concurrency < 1:
        raise ValueError("concurrency must be positive")
    ship(items.sparkSession)
    own = pending(items, limit).select("news_id", F.coalesce("full_text", F.lit("")).alias("full_text"))
    fits = F.length("full_text") >= SHORTEST
    nothing = F.lit(None).cast(RESULT)
    skipped = own.where(~fits).select("news_id", F.lit("skipped").alias("status"), F.lit("too little text").alias("reason"), nothing.alias("result"))
    sent = own.where(fits).select("news_id", F.substring("full_text", 1, LONGEST).alias("text"))
    if dry_run:
        return sent.select("news_id", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("reason"), nothing.alias("result")).unionByName(skipped)
    sent = sent.repartition(tasks) if tasks else sent
    done = sent.mapInArrow(lambda batches: called(provider, batches, concurrency), f"news_id {dict(items.dtypes)['news_id']}, reply string, reason string")
    done = done.withColumn("result", parse_reply(F.col("reply")))
    reason = F.when(F.col("result").isNull(), F.coalesce("reason", F.lit("no summary")))
    done = done.select("news_id", F.when(F.col("result").isNull(), "failed").otherwise("enhanced").alias("status"), reason.alias("reason"), "result")
    return done.unionByName(skipped)


def judged_rows(results: DataFrame, slugs: dict[str, str] | None = None) -> DataFrame:
    """``news_id, relation, pos, id, name, kind, title, organization_id, relevance, reason``: what enrichment results name, each row once, written.

    ``reason`` is null for accepted rows; others have no name, a relevance outside 0 to 1
    or none, or an unknown type of organization. The first five organizations and people
    of an item count; later ones have a reason too, so nothing disappears. ``slugs`` are
    the readings that topic ids are made of, see :func:`slug`.
    """
    r = results.where("result is not null").select("news_id", "result.*")
    unnamed = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    late = F.col("pos") >= KEPT
    columns = ("news_id", "relation", "pos", "id", "name", "kind", "title", "organization_id", "relevance", "reason")

    def shaped(rows, relation, **more):
        return rows.select(*[more.get(c, F.lit(relation) if c == "relation" else F.col(c) if c in rows.columns else F.lit(None).cast("double" if c == "relevance" else "string")).alias(c) for c in columns])

    topic = r.select("news_id", F.posexplode("topics").alias("pos", "x")).select("news_id", "pos", F.col("x.name").alias("name"), F.col("x.relevance").alias("relevance"))
    topic = shaped(topic, "topic", id=slug(F.col("name"), slugs), reason=F.when(unnamed("name"), "no name").when(~F.coalesce(F.col("relevance").between(0, 1), F.lit(False)), "relevance outside 0 to 1"))
    org = r.select("news_id", F.posexplode("organizations").alias("pos", "x")).select("news_id", "pos", F.col("x.name").alias("name"), F.col("x.type").alias("kind"))
    org = shaped(org, "organization", id=F.col("name"), reason=F.when(unnamed("name"), "no name").when(late, "beyond the first five").when(~F.coalesce(F.col("kind").isin(*ORG_TYPES), F.lit(False)), "unknown type"))
    who = r.select("news_id", "organizations", F.posexplode("people").alias("pos", "x")).select("news_id", "pos", F.col("x.name").alias("name"), F.col("x.title").alias("title"), infer_organization(F.coalesce("x.title", F.lit("")), F.col("organizations")).alias("organization_id"))
    who = shaped(who, "person", id=F.col("name"), reason=F.when(unnamed("name"), "no name").when(late, "beyond the first five"))
    return materialize(topic.unionByName(org).unionByName(who), "judged")


def persist_enrichment(results: DataFrame, slugs: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The rows that enrichment results ``(news_id, result)`` add: dimensions by first writer, and links; and ``rejected``, what doesn't enter, with its reason.

    An item's tags keep all entities as they came, locations and whatever else a
    provider gives, and its policy signals.
    """
    rows = judged_rows(results, slugs)
    fine = rows.where("reason is null")
    topic, org, who = (fine.where(F.col("relation") == x) for x in ("topic", "organization", "person"))
    category = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in TOPIC_CATEGORIES.items() for v in kv]), F.col("name")), F.lit(""))
    order = ["news_id", "pos"]
    r = results.where("result is not null").select("news_id", "result.*")
    signals = F.concat(F.lit('"_policy_signals":'), F.col("signals"))
    entities = F.regexp_extract(F.coalesce("entities", F.lit("{}")), r"(?s)^\{(.*)\}$", 1)
    tags = F.concat(F.lit("{"), F.concat_ws(",", F.nullif(entities, F.lit("")), signals), F.lit("}"))
    return {
        "items": r.select("news_id", "summary", "keywords", tags.alias("tags")),
        "topic": first_writer(topic.withColumn("category", category), ["id"], order).select(F.col("id").alias("topic_id"), "name", "category"),
        "news_topic": first_writer(topic, ["news_id", "id"], order).select("news_id", F.col("id").alias("topic_id"), F.col("relevance").alias("relevance_score")),
        "organization": first_writer(org, ["id"], order).select(F.col("id").alias("org_id"), "name", F.col("kind").alias("type")),
        "news_organization": org.select("news_id", F.col("id").alias("org_id")).distinct(),
        "person": first_writer(who, ["id"], order).select(F.col("id").alias("person_id"), "name", F.col("name").alias("name_chinese"), "title", "organization_id"),
        "news_person": who.select("news_id", F.col("id").alias("person_id")).distinct(),
        "rejected": rows.where("reason is not null").select("news_id", "relation", "pos", "name", "reason"),
    }


def article_counts(dim: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """Each entity's number of items, counted when asked for."""
    n = links.groupBy(key).agg(F.count("*").alias("article_count"))
    return dim.select(key).join(n, key, "left").select(key, F.coalesce("article_count", F.lit(0)).alias("article_count"))


def stats(items: DataFrame, persons: DataFrame, orgs: DataFrame, topics: DataFrame) -> DataFrame:
    own = items.agg(F.count("*").alias("items"), F.count_distinct("broadcast_date").alias("dates"), F.count_if(F.coalesce("summary", F.lit("")) != "").alias("enhanced"))
    for df, name in ((persons, "persons"), (orgs, "organizations"), (topics, "topics")):
        own = own.crossJoin(df.agg(F.count("*").alias(name)))
    return own
