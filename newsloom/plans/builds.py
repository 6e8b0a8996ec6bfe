"""Whole runs, each published as one version or not at all: the import of a folder, the build of all event tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.operators import events, loading, search
from newsloom.plans.publish import Tables, commit, read
from newsloom.plans.scratch import materialize
from newsloom.schema import REFERENCES, TABLES
from newsloom.session import ship
from newsloom.sources import markdown

EVENT_TABLES = ("news_event", "news_event_link", "event_person", "event_organization", "event_relation")
#: Items of an event, the earliest, that its profile is written from.
PROFILE_ITEMS = 50


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def with_all(spark: SparkSession, tables: Tables) -> Tables:
    """``tables`` and an empty table for each of the data model's that isn't among them."""
    return {name: tables[name] if name in tables else empty(spark, name) for name in TABLES}


def check_all_references(tables: Tables) -> None:
    """Raise if a reference between two of the tables leads nowhere."""
    found = [loading.orphans(tables[a], k, tables[b], j, f"{a}.{k}") for a, k, b, j in REFERENCES if a in tables and b in tables]
    loading.check_references(*found)


def setup(spark: SparkSession, root: str) -> str:
    """Publish the data model's tables, empty but for what is there."""
    return commit(spark, root, lambda now: {name: empty(spark, name) for name in TABLES if name not in now} or {"news_item": now["news_item"]})


def parsed_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Items of all Markdown files of a folder, written; raises where there are no files, a file has no items, or an item is wrong."""
    try:
        files = markdown.read_files(spark, folder)
        files = materialize(files, "files")
    except AnalysisException as e:
        raise FileNotFoundError(f"no Markdown files in {folder}") from e
    items = materialize(markdown.parse(files), "parsed")
    bad = items.where("error is not null").select(F.format_string("%s, item %d: %s", "file", "order_in_broadcast", "error").alias("x"))
    bad = bad.unionByName(files.join(items.select("file").distinct(), "file", "left_anti").select(F.format_string("%s: no items", "file").alias("x")))
    if wrong := bad.orderBy("x").limit(6).collect():
        raise ValueError("; ".join(r["x"] for r in wrong[:5]) + ("; and more" if len(wrong) > 5 else ""))
    return items.drop("file", "error")


def import_folder(spark: SparkSession, folder: str, root: str, tries: int = 5) -> int:
    """Import a folder's daily files into the tables at ``root`` as one commit; the number of new items.

    Files, items, ids and contents are checked, known items get URLs where they had none,
    and references are checked on what was written. Any fault leaves all as it was.
    Another writer's commit meanwhile is built upon, not overwritten.
    """
    items = parsed_folder(spark, folder)
    added = 0

    def build(now: Tables) -> Tables:
        nonlocal added
        existing = now.get("news_item", empty(spark, "news_item"))
        after = materialize(loading.import_items(items, existing).select(*existing.columns), "import")
        added = after.count() - existing.count()
        return {"news_item": after}

    commit(spark, root, build, check_all_references, tries)
    return added


def plain_profile(digest: str) -> str:
    """A profile that needs no network: the first line of the digest and how many follow."""
    lines = digest.split("\n")
    return lines[0] + (f" (+{len(lines) - 1})" if len(lines) > 1 else "")


def event_tables(now: Tables, profile: Callable[[str], str] = plain_profile, window_days: int = 7, min_items: int = 2, concurrency: int = 3) -> Tables:
    """All five event tables from one version's items, people, organizations and topics.

    Each item belongs to one event. Metrics refer to the newest broadcast. ``profile``
    turns an event's digest into its summary; an event without one is an error.
    """
    spark = now["news_item"].sparkSession
    ship(spark)
    items = now["news_item"].select("news_id", "title", "summary", "full_text", "broadcast_date")
    clusters = materialize(events.topical_clusters(items, now["news_topic"], window_days), "event-clusters")
    ids = materialize(events.cluster_events(clusters, min_items), "event-ids")
    links = materialize(events.event_links(clusters, items, min_items, ids), "event-links")
    found = materialize(events.detected_events(items, now["news_topic"], now["topic"], clusters, min_items, ids), "events")
    people = events.event_entities(links, now["news_person"], "person_id")
    first = events.primary_actors(links, now["news_person"]).select("event_id", "person_id", F.lit("primary_actor").alias("first"))
    people = materialize(people.join(first, ["event_id", "person_id"], "left").select("event_id", "person_id", F.coalesce("first", "role").alias("role")), "event-people")
    when = links.join(items.select("news_id", F.col("broadcast_date").alias("day")), "news_id")
    board = events.heat_board(when, people.select("event_id", F.col("person_id").alias("actor")), items.agg(F.max("broadcast_date").alias("as_of")))
    types = events.event_types(links, now["news_topic"], now["topic"])
    early = F.row_number().over(Window.partitionBy("event_id").orderBy("broadcast_date", "news_id"))
    some = links.join(items.select("news_id", "broadcast_date"), "news_id").withColumn("at", early).where(F.col("at") <= PROFILE_ITEMS).select("news_id", "event_id")
    digests = search.event_digest(items, some).select(F.col("event_id").alias("news_id"), F.col("digest").alias("text"))
    profiles = digests.mapInArrow(lambda batches: loading.called(profile, batches, concurrency), "event_id string, summary string, reason string")
    profiles = materialize(profiles.where("coalesce(summary, '') <> ''"), "profiles")
    events.require_profiles(found, profiles)
    own = found.join(types, "event_id").join(board.select("event_id", "importance", "status", "heat_score"), "event_id").join(profiles.select("event_id", "summary"), "event_id")
    relations = events.related_events(people.select("event_id", "person_id"), found)
    shaped = {
        "news_event": own,
        "news_event_link": links,
        "event_person": people,
        "event_organization": events.event_entities(links, now["news_organization"], "org_id"),
        "event_relation": relations,
    }
    as_model = lambda name, df: spark.createDataFrame([], TABLES[name]).unionByName(df.select(*spark.createDataFrame([], TABLES[name]).columns))
    return {name: as_model(name, df) for name, df in shaped.items()}


def build_events(spark: SparkSession, root: str, profile: Callable[[str], str] = plain_profile, window_days: int = 7, min_items: int = 2, concurrency: int = 3, tries: int = 5) -> dict:
    """Build all event tables from the version in force and swap them in at once; the counts of the new version.

    An incomplete build, a reference that leads nowhere, or any other fault leaves the
    events as they were; an import that comes between is built upon.
    """

    def check(tables: Tables) -> None:
        check_all_references(tables)
        loose = tables["news_item"].join(tables["news_event_link"], "news_id", "left_anti").count()
        if loose:
            raise ValueError(f"{loose} items belong to no event")

    def build(now: Tables) -> Tables:
        check_all_references({k: v for k, v in now.items() if k not in EVENT_TABLES})
        return event_tables(with_all(spark, now), profile, window_days, min_items, concurrency)

    commit(spark, root, build, check, tries)
    return events.pipeline_stats(read(spark, root, "news_event"), read(spark, root, "event_relation")).first().asDict()
