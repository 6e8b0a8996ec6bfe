"""Nested exports, and the figures of a dashboard over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import ascii_lower


def export_news(items: DataFrame, news_person: DataFrame, persons: DataFrame, news_org: DataFrame, orgs: DataFrame, news_topic: DataFrame, topics: DataFrame) -> DataFrame:
    """Items with people ``(name, name_chinese, title)``, organizations ``(name, type)`` and topics ``(topic_id, name, category, relevance)``, as arrays of structs.

    People and organizations go by name, topics by falling relevance; one join for each kind.
    """

    def nested(links: DataFrame, dim: DataFrame, key: str, *columns: str, order=None) -> DataFrame:
        rows = links.join(dim, key).select("news_id", F.struct(*([order] if order is not None else []), *columns).alias("x"))
        return rows.groupBy("news_id").agg(F.array_sort(F.collect_list("x")).alias("x"))

    people = nested(news_person, persons.select("person_id", "name", "name_chinese", "title"), "person_id", "name", "name_chinese", "title", order=F.col("name_chinese").alias("o"))
    people = people.select("news_id", F.transform("x", lambda x: F.struct(x["name"].alias("name"), x["name_chinese"].alias("name_chinese"), x["title"].alias("title"))).alias("people"))
    org = nested(news_org, orgs.select("org_id", "name", "type"), "org_id", "name", "type").withColumnRenamed("x", "organizations")
    topic = nested(news_topic, topics.select("topic_id", "name", "category"), "topic_id", "topic_id", "name", "category", "relevance_score", order=(-F.col("relevance_score")).alias("o"))
    topic = topic.select("news_id", F.transform("x", lambda x: F.struct(x["topic_id"].alias("topic_id"), x["name"].alias("name"), x["category"].alias("category"), x["relevance_score"].alias("relevance"))).alias("topics"))
    excerpt = F.coalesce(F.nullif("summary", F.lit("")), F.substring("full_text", 1, 200))
    return items.withColumn("excerpt", excerpt).join(people, "news_id", "left").join(org, "news_id", "left").join(topic, "news_id", "left")


def export_topics(topics: DataFrame, news_topic: DataFrame, items: DataFrame) -> DataFrame:
    own = news_topic.join(items.select("news_id", "broadcast_date"), "news_id").groupBy("topic_id").agg(F.count("*").alias("article_count"), F.count_distinct("broadcast_date").alias("date_count"))
    out = topics.join(own, "topic_id", "left").select("topic_id", "name", "category", F.coalesce("article_count", F.lit(0)).alias("article_count"), F.coalesce("date_count", F.lit(0)).alias("date_count"))
    return out.orderBy(F.desc("article_count"), "topic_id")


def export_dates(items: DataFrame) -> DataFrame:
    return items.groupBy("broadcast_date").agg(F.count("*").alias("item_count"), F.count_if(F.coalesce("summary", F.lit("")) != "").alias("enhanced_count")).orderBy("broadcast_date")


def export_events(events: DataFrame, links: DataFrame, items: DataFrame, actors: DataFrame, relations: DataFrame, people: int = 10, related: int = 5) -> DataFrame:
    """Events with their items ``(news_id, title, date)``, at most so many key persons ``(name, role)`` and related events ``(event_id, name, similarity, type)``, hottest first.

    ``actors (event_id, name, role)`` are the primary ones; ``events`` have an id and a name.
    """
    by_date = F.array_sort(F.collect_list(F.struct("broadcast_date", "news_id", "title")))
    own = links.join(items.select("news_id", "title", "broadcast_date"), "news_id").groupBy("event_id").agg(by_date.alias("items"))
    own = own.select("event_id", F.transform("items", lambda x: F.struct(x["news_id"].alias("news_id"), x["title"].alias("title"), x["broadcast_date"].alias("date"))).alias("items"))
    who = actors.groupBy("event_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("name", "role"))), 1, people).alias("key_persons"))
    other = events.select(F.col("event_id").alias("target_event_id"), F.col("name").alias("target_name"))
    rows = relations.join(other, "target_event_id").select(F.col("source_event_id").alias("event_id"), F.struct((-F.col("similarity_score")).alias("o"), "target_event_id", "target_name", "relation_type").alias("x"))
    rel = rows.groupBy("event_id").agg(F.slice(F.array_sort(F.collect_list("x")), 1, related).alias("x"))
    rel = rel.select("event_id", F.transform("x", lambda x: F.struct(x["target_event_id"].alias("event_id"), x["target_name"].alias("name"), (-x["o"]).alias("similarity"), x["relation_type"].alias("type"))).alias("related_events"))
    return events.join(own, "event_id", "left").join(who, "event_id", "left").join(rel, "event_id", "left").orderBy(F.desc("heat_score"), "event_id")


def dashboard_filter(articles: DataFrame, date=None, topic: str | None = None, person: str | None = None, keyword: str | None = None) -> DataFrame:
    """Articles that meet all given conditions; the keyword is looked for in titles, summaries, excerpts and all names."""
    out = articles
    if date:
        out = out.where(F.col("day") == F.to_date(F.lit(date)))
    if topic:
        out = out.where(F.array_contains("topics", topic))
    if person:
        out = out.where(F.array_contains("people", person))
    if keyword:
        word = ascii_lower(F.lit(keyword))
        hit = F.lit(False)
        for c in ("title", "summary", "excerpt"):
            hit = hit | F.contains(ascii_lower(F.coalesce(c, F.lit(""))), word)
        for c in ("keywords", "people", "organizations"):
            hit = hit | F.exists(c, lambda x: F.contains(ascii_lower(x), word))
        out = out.where(hit)
    return out


def kpis(articles: DataFrame, filtered: DataFrame) -> DataFrame:
    own = filtered.agg(F.count("*").alias("filtered"), F.count_if(F.coalesce("summary", F.lit("")) != "").alias("with_summary"), F.count_distinct("day").alias("dates"))
    return own.crossJoin(articles.agg(F.count("*").alias("total")))


def date_bars(items: DataFrame) -> DataFrame:
    """Items by date and their width in per cent of the fullest date."""
    n = items.groupBy("broadcast_date").agg(F.count("*").alias("item_count"))
    top = F.broadcast(n.agg(F.max("item_count").alias("top")))
    return n.crossJoin(top).select("broadcast_date", "item_count", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("item_count") * 100.0 / F.col("top"))), 2).alias("width")).orderBy("broadcast_date")


def topic_tiles(exported: DataFrame, top: int = 24) -> DataFrame:
    return exported.orderBy(F.desc("article_count"), "topic_id").limit(top)


def people_board(filtered: DataFrame, top: int = 20) -> DataFrame:
    n = filtered.select(F.explode(F.array_distinct("people")).alias("name")).groupBy("name").agg(F.count("*").alias("item_count"))
    return n.orderBy(F.desc("item_count"), "name").limit(top)


def events_on(events: DataFrame, links: DataFrame, date, top: int = 12) -> DataFrame:
    """The hottest events that have an item on a date."""
    own = links.where(F.col("day") == F.to_date(F.lit(date))).select("event_id")
    return events.join(own, "event_id", "left_semi").orderBy(F.desc(F.coalesce("heat_score", F.lit(0.0))), "event_id").limit(top)


def news_page(items: DataFrame, page: int = 0, size: int = 60) -> DataFrame:
    return items.orderBy(F.desc("broadcast_date"), "order_in_broadcast", "news_id").offset(page * size).limit(size)


def bars(counts: DataFrame, name: str = "item_count", most: int = 20) -> DataFrame:
    """A text bar for each count."""
    return counts.withColumn("bar", F.repeat(F.lit("█"), F.least(F.col(name), F.lit(most)).cast("int")))

