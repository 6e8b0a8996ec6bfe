"""Search, profiles, topic evolution, co-occurrence and coverage over the ontology tables.

Every function takes DataFrames with the columns of :mod:`newsloom.schema` and returns
one; ties are broken by id. Lookups by name prefer an exact match, then the least id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import contains, like


def search_news(items: DataFrame, keyword: str, limit: int = 50) -> DataFrame:
    """Items whose title or text holds the keyword; a title hit counts 2, a text hit 1."""
    hit = contains(F.coalesce("title", F.lit("")), keyword)
    out = items.where(hit | contains(F.coalesce("full_text", F.lit("")), keyword))
    out = out.select("news_id", "title", "broadcast_date", F.substring("full_text", 1, 200).alias("excerpt"), F.when(hit, 2).otherwise(1).alias("relevance"))
    return out.orderBy(F.desc("relevance"), F.desc("broadcast_date"), "news_id").limit(limit)


def lookup(dim: DataFrame, key: str, exact: Column, close: Column) -> DataFrame:
    """The one row of a dimension that matches exactly, or else closely, with the least key."""
    tier = F.when(exact, 0).when(close, 1)
    return dim.withColumn("tier", tier).where("tier is not null").orderBy("tier", key).limit(1).drop("tier")


def find_person(persons: DataFrame, name: str) -> DataFrame:
    exact = (F.col("name") == name) | (F.col("name_chinese") == name)
    return lookup(persons, "person_id", exact, contains(F.col("name"), name) | contains(F.col("name_chinese"), name))


def find_topic(topics: DataFrame, name: str) -> DataFrame:
    return lookup(topics, "topic_id", F.col("name") == name, contains(F.col("name"), name))


def person_items(items: DataFrame, news_person: DataFrame, person: DataFrame) -> DataFrame:
    own = news_person.join(F.broadcast(person.select("person_id")), "person_id", "left_semi")
    return items.join(own, "news_id").select("news_id", "title", "broadcast_date").orderBy(F.desc("broadcast_date"), "news_id")


def person_topics(news_topic: DataFrame, topics: DataFrame, news_person: DataFrame, person: DataFrame, limit: int = 10) -> DataFrame:
    """The topics that most often share an item with a person."""
    own = news_person.join(F.broadcast(person.select("person_id")), "person_id", "left_semi").select("news_id")
    n = news_topic.join(own, "news_id", "left_semi").groupBy("topic_id").agg(F.count("*").alias("item_count"))
    return n.join(topics.select("topic_id", "name"), "topic_id").orderBy(F.desc("item_count"), "topic_id").limit(limit)


def person_organization(organizations: DataFrame, person: DataFrame) -> DataFrame:
    who = person.select("person_id", F.col("name").alias("person_name"), "organization_id")
    return who.join(organizations.select(F.col("org_id").alias("organization_id"), F.col("name").alias("org_name")), "organization_id", "left").select("person_id", "person_name", "organization_id", "org_name")


def topic_evolution(items: DataFrame, news_topic: DataFrame, topic: DataFrame) -> DataFrame:
    """Items and titles of a topic by date."""
    own = news_topic.join(F.broadcast(topic.select("topic_id", F.col("name").alias("topic_name"))), "topic_id")
    own = items.join(own, "news_id")
    titles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_in_broadcast", "news_id", "title"))), lambda x: x["title"]), " || ")
    return own.groupBy("topic_id", "topic_name", "broadcast_date").agg(F.count("*").alias("item_count"), titles.alias("titles")).orderBy("broadcast_date")


def date_summary(items: DataFrame, news_person: DataFrame, persons: DataFrame, news_org: DataFrame, organizations: DataFrame, date: str) -> DataFrame:
    """Items of a date in order, with their people and organizations."""
    own = items.where(F.col("broadcast_date") == F.to_date(F.lit(date)))

    def names(links: DataFrame, dim: DataFrame, key: str, name: str) -> DataFrame:
        met = links.join(own.select("news_id"), "news_id", "left_semi").join(dim.select(key, F.col("name").alias("n")), key)
        return met.groupBy("news_id").agg(F.array_sort(F.collect_set("n")).alias(name))

    none = F.array().cast("array<string>")
    out = own.join(names(news_person, persons, "person_id", "people"), "news_id", "left").join(names(news_org, organizations, "org_id", "organizations"), "news_id", "left")
    return out.select("news_id", "order_in_broadcast", "title", F.coalesce("people", none).alias("people"), F.coalesce("organizations", none).alias("organizations"), F.count("*").over(Window.partitionBy("broadcast_date")).alias("total")).orderBy("order_in_broadcast", "news_id")


def topic_network(news_topic: DataFrame, topics: DataFrame, topic: DataFrame, minimum: int = 1, limit: int = 20) -> DataFrame:
    """Other topics on the items of a topic."""
    focus = news_topic.join(F.broadcast(topic.select("topic_id")), "topic_id", "left_semi").select("news_id")
    n = news_topic.join(focus, "news_id", "left_semi").join(F.broadcast(topic.select("topic_id")), "topic_id", "left_anti")
    n = n.groupBy("topic_id").agg(F.count("*").alias("cooccurrence")).where(F.col("cooccurrence") >= minimum)
    return n.join(topics.select("topic_id", "name"), "topic_id").orderBy(F.desc("cooccurrence"), "topic_id").limit(limit)


def compare_coverage(items: DataFrame, news_person: DataFrame, persons: DataFrame, names: list[str]) -> DataFrame:
    """For each requested name, the items of each person it matches, by date: an item occurs once for each such person."""
    asked = None
    for name in dict.fromkeys(names):
        own = persons.where((F.col("name_chinese") == name) | like(F.col("name"), name) | contains(F.col("name_chinese"), name)).select(F.lit(name).alias("requested"), "person_id")
        asked = own if asked is None else asked.unionByName(own)
    return items.join(news_person.join(asked, "person_id"), "news_id").select("requested", "person_id", "news_id", "title", "broadcast_date").orderBy("requested", "broadcast_date", "news_id", "person_id")


def list_events(events: DataFrame, links: DataFrame, status: str | None = None, importance: str | None = None, limit: int = 20) -> DataFrame:
    out = events
    for name, value in (("status", status), ("importance", importance)):
        out = out.where(F.col(name) == value) if value else out
    n = links.groupBy("event_id").agg(F.count("*").alias("item_count"))
    return out.join(n, "event_id", "left").withColumn("item_count", F.coalesce("item_count", F.lit(0))).orderBy(F.desc("heat_score"), "event_id").limit(limit)


def event_items(items: DataFrame, links: DataFrame, event_id) -> DataFrame:
    own = links.where(F.col("event_id") == F.lit(event_id)).select("news_id")
    return items.join(own, "news_id", "left_semi").orderBy("broadcast_date", "news_id")


def event_actors(event_person: DataFrame, persons: DataFrame, event_id, limit: int = 10) -> DataFrame:
    own = event_person.where((F.col("event_id") == F.lit(event_id)) & (F.col("role") == "primary_actor"))
    return own.join(persons, "person_id").orderBy("person_id").limit(limit)


def event_relations(relations: DataFrame, event_id, limit: int = 5) -> DataFrame:
    return relations.where(F.col("source_event_id") == F.lit(event_id)).orderBy(F.desc("similarity_score"), "target_event_id").limit(limit)


def numbered(items: DataFrame) -> DataFrame:
    """``items`` with their ``position`` by date and id, from 1: ranks within a day, and the counts of the days before."""
    at = F.row_number().over(Window.partitionBy("broadcast_date").orderBy("news_id"))
    days = items.groupBy(F.col("broadcast_date").alias("of")).agg(F.count("*").alias("n")).select("of", F.coalesce(F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each day
    return items.withColumn("at", at).join(days, F.col("broadcast_date") == F.col("of")).withColumn("position", (F.col("before") + F.col("at")).cast("long")).drop("of", "before", "at")


def event_report(events: DataFrame, items: DataFrame, links: DataFrame, event_person: DataFrame, persons: DataFrame, event_organization: DataFrame, orgs: DataFrame, event_id, named: int = 10, length: int = 300) -> DataFrame:
    """What a report of an event is written from: ``section, position, line`` of its header, people, organizations and timeline, in order.

    People and organizations are the first ten by role, then by id; each item has its
    date and title, and on a second line up to 300 characters of summary or text. An
    event without items, or one that isn't known, gives one line that says so.
    """
    is_it = F.col("event_id") == F.lit(event_id)
    own = links.where(is_it).select("news_id")
    event = events.where(is_it).limit(1)
    n, known = F.lit(own.count()), F.lit(event.count())
    fine = (n > 0) & (known > 0)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = event.select(F.explode(F.array(F.concat(F.lit("Event: "), text("name")), F.concat(F.lit("Type: "), text("type")), F.concat(F.lit("Importance: "), text("importance")), F.concat(F.lit("Status: "), text("status")), F.concat(F.lit("Dates: "), text("first_date"), F.lit(" to "), text("last_date")))).alias("line")).withColumn("position", F.monotonically_increasing_id() + 1)

    def who(of, dim, key, name, section):
        rows = of.where(is_it).join(dim.select(key, F.col(name).alias("name")), key).orderBy("role", key).limit(named)
        at = F.row_number().over(Window.orderBy("role", key))  # at most ten rows
        return rows.select(F.lit(section).alias("section"), at.cast("long").alias("position"), F.concat(F.lit("- "), text("name"), F.lit(" ("), text("role"), F.lit(")")).alias("line"))

    preview = F.substring(F.coalesce(F.nullif("summary", F.lit("")), "full_text", F.lit("")), 1, length)
    line = F.concat(F.lit("["), F.col("broadcast_date").cast("string"), F.lit("] "), text("title"), F.lit("\n  "), preview)
    timeline = numbered(items.join(own, "news_id", "left_semi")).select(F.lit(4).alias("section"), "position", line.alias("line"))
    rows = head.select(F.lit(1).alias("section"), "position", "line").unionByName(who(event_person, persons, "person_id", "name_chinese", 2)).unionByName(who(event_organization, orgs, "org_id", "name", 3)).unionByName(timeline).where(fine)
    message = F.when(n == 0, "No items linked to this event.").otherwise("Event not found.")
    return rows.unionByName(links.sparkSession.range(1).select(F.lit(0).alias("section"), F.lit(1).cast("long").alias("position"), message.alias("line")).where(~fine)).orderBy("section", "position")


def emerging_events(events: DataFrame, links: DataFrame, items: DataFrame, as_of: Column, lookback_days: int = 3, limit: int = 10) -> DataFrame:
    """Emerging and developing events with news since ``as_of`` minus the lookback, and how much of it."""
    cutoff = F.date_sub(as_of, lookback_days)
    recent = links.join(items.where(F.col("broadcast_date") >= cutoff).select("news_id"), "news_id").groupBy("event_id").agg(F.count("*").alias("recent_count"))
    out = events.where(F.col("status").isin("emerging", "developing") & (F.col("last_date") >= cutoff)).join(recent, "event_id", "left")
    return out.withColumn("recent_count", F.coalesce("recent_count", F.lit(0))).orderBy(F.desc("heat_score"), "event_id").limit(limit)


def topic_narrative(items: DataFrame, news_topic: DataFrame, topic: DataFrame) -> DataFrame:
    """What a narrative of a topic is written from: its items by date with a preview of at most 300 characters."""
    own = news_topic.join(F.broadcast(topic.select("topic_id")), "topic_id", "left_semi")
    preview = F.substring(F.coalesce(F.nullif("summary", F.lit("")), "full_text", F.lit("")), 1, 300)
    return items.join(own.select("news_id"), "news_id", "left_semi").select("news_id", "broadcast_date", "title", preview.alias("preview")).orderBy("broadcast_date", "news_id")


def event_digest(items: DataFrame, links: DataFrame, length: int = 200) -> DataFrame:
    """What a profile or report of each event is written from: its items by date, a line each."""
    line = F.format_string("[%s] %s", F.col("broadcast_date").cast("string"), F.substring(F.coalesce(F.nullif("summary", F.lit("")), "title"), 1, length))
    own = links.join(items, "news_id").select("event_id", F.struct("broadcast_date", "news_id", line.alias("line")).alias("x"), "broadcast_date")
    return own.groupBy("event_id").agg(F.count("*").alias("items"), F.min("broadcast_date").alias("first_date"), F.max("broadcast_date").alias("last_date"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("digest"))
