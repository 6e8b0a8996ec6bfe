"""Events: detection by shared topics and time, actors, types, heat, importance, status, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import event_id, round_even
from newsloom.operators.overlap import top_overlaps
from newsloom.plans.components import contracted_components
from newsloom.plans.digest import member_digests
from newsloom.plans.scratch import materialize
from newsloom.schema import CATEGORY_TYPES


def generic_topics(news_topic: DataFrame, top: int = 3) -> DataFrame:
    """The topics of most items, counted from the links."""
    return news_topic.groupBy("topic_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic_id").limit(top).select("topic_id")


def _starts(days: DataFrame, window_days: int) -> DataFrame:
    """Distinct ``days (topic_id, day, ...)`` with ``start``, the first day of the island that each belongs to."""
    by_topic = Window.partitionBy("topic_id").orderBy("day")
    starts = F.coalesce(F.datediff("day", F.lag("day").over(by_topic)) > window_days, F.lit(True))
    return days.withColumn("start", F.last(F.when(starts, F.col("day")), ignorenulls=True).over(by_topic))


def topic_islands(placed: DataFrame, window_days: int = 7) -> DataFrame:
    """``topic_id, day, start``: the distinct days of each topic in ``placed (topic_id, day)``, and the first day of the island that each belongs to."""
    return _starts(placed.select("topic_id", "day").distinct(), window_days)


def topical_clusters(items: DataFrame, news_topic: DataFrame, window_days: int = 7, exclude_top: int = 3, min_items: int = 1) -> DataFrame:
    """``news_id, cluster_id``: components of items that share a topic within ``window_days``.

    Not pairs but islands are linked: the days of a topic, each no further than the
    window from the one before, form an island whose items are all connected. Islands
    are found on distinct days of a topic, so a topic of very many items costs no more
    than its days, and each other item of an island has an edge to its least one.
    """
    if window_days < 0:
        raise ValueError("window_days must not be negative")
    kept = news_topic.select("news_id", "topic_id").join(F.broadcast(generic_topics(news_topic, exclude_top)), "topic_id", "left_anti") if exclude_top else news_topic.select("news_id", "topic_id")
    placed = materialize(kept.join(items.select("news_id", F.col("broadcast_date").alias("day")), "news_id").select("news_id", "topic_id", "day"), "placed")
    islands = _starts(placed.groupBy("topic_id", "day").agg(F.min("news_id").alias("least")), window_days)
    islands = islands.select("topic_id", "day", F.min("least").over(Window.partitionBy("topic_id", "start")).alias("hub"))
    edges = placed.join(islands, ["topic_id", "day"]).where("news_id <> hub").select("news_id", "hub")
    labels = contracted_components(edges, "news_id", "hub")
    out = items.select("news_id").distinct().join(labels, F.col("news_id") == F.col("node"), "left").select("news_id", F.coalesce("component", "news_id").alias("cluster_id"))
    if min_items <= 1:
        return out
    out = materialize(out, "clusters")
    return out.join(out.groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_items), "cluster_id").select("news_id", "cluster_id")


def dominant(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group, the least of several."""
    n = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))
    return n.withColumn("rank", rank).where("rank = 1").select(group, value)


def cluster_events(clusters: DataFrame, min_items: int = 2) -> DataFrame:
    """``cluster_id, event_id, news_count`` of clusters of ``min_items``; the id hashes the members, however many."""
    found = member_digests(clusters, "cluster_id", "news_id")
    return found.where(F.col("members") >= min_items).select(F.col("group").alias("cluster_id"), F.substring("digest", 1, 16).alias("event_id"), F.col("members").alias("news_count"))


def detected_events(items: DataFrame, news_topic: DataFrame, topics: DataFrame, clusters: DataFrame, min_items: int = 2, ids: DataFrame | None = None) -> DataFrame:
    """A row for each event: clusters of ``min_items``, named by dominant topic, first date and size, and each other item as an event of its own. ``ids`` may have :func:`cluster_events`."""
    ids = cluster_events(clusters, min_items) if ids is None else ids
    large = clusters.join(ids, "cluster_id").join(items.select("news_id", "title", "broadcast_date"), "news_id")
    topic = dominant(large.select("news_id", "cluster_id").join(news_topic.select("news_id", "topic_id"), "news_id"), "cluster_id", "topic_id").join(topics.select("topic_id", F.col("name").alias("topic_name")), "topic_id")
    events = large.groupBy("cluster_id", "event_id", "news_count").agg(F.min("broadcast_date").alias("first_date"), F.max("broadcast_date").alias("last_date"))
    events = events.join(topic, "cluster_id", "left").select("event_id", F.format_string("%s_%s_%d条", "topic_name", F.col("first_date").cast("string"), "news_count").alias("name"), "news_count", "first_date", "last_date")
    single = items.join(large.select("news_id"), "news_id", "left_anti").select(event_id(F.array(F.col("news_id").cast("string"))).alias("event_id"), F.substring("title", 1, 80).alias("name"), F.lit(1).cast("long").alias("news_count"), F.col("broadcast_date").alias("first_date"), F.col("broadcast_date").alias("last_date"))
    return events.unionByName(single)


def event_links(clusters: DataFrame, items: DataFrame, min_items: int = 2, ids: DataFrame | None = None) -> DataFrame:
    """``news_id, event_id`` of the same events."""
    ids = cluster_events(clusters, min_items) if ids is None else ids
    large = clusters.join(ids, "cluster_id").select("news_id", "event_id")
    return large.unionByName(items.join(large.select("news_id"), "news_id", "left_anti").select("news_id", event_id(F.array(F.col("news_id").cast("string"))).alias("event_id")))


def event_entities(links: DataFrame, news_entity: DataFrame, key: str) -> DataFrame:
    """People or organizations of events, in the role of being mentioned."""
    return links.join(news_entity, "news_id").select("event_id", key).distinct().withColumn("role", F.lit("mentioned"))


def primary_actors(links: DataFrame, news_person: DataFrame, top: int = 1) -> DataFrame:
    """The people on most items of each event."""
    n = links.join(news_person, "news_id").groupBy("event_id", "person_id").agg(F.count("*").alias("item_count"))
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("item_count"), "person_id"))
    return n.withColumn("rank", rank).where(F.col("rank") <= top).select("event_id", "person_id", "item_count")


def event_types(links: DataFrame, news_topic: DataFrame, topics: DataFrame) -> DataFrame:
    """Type of each event by its most frequent topic category; political where there is none or no rule."""
    category = F.lower(F.coalesce("category", F.lit("")))
    rows = links.join(news_topic.select("news_id", "topic_id"), "news_id").join(topics.select("topic_id", category.alias("category")), "topic_id")
    mapped = F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORY_TYPES.items() for x in kv]), F.col("category"))
    return links.select("event_id").distinct().join(dominant(rows, "event_id", "category"), "event_id", "left").select("event_id", F.coalesce(mapped, F.lit("political")).alias("type"))


def importance(heat: Column) -> Column:
    return F.when(heat >= 70, "critical").when(heat >= 50, "major").when(heat >= 30, "notable").otherwise("routine")


def status(n: Column, gap: Column, recent: Column, earlier: Column) -> Column:
    """Lifecycle status from the number of items, days since the last one, and items of the last and the previous week."""
    out = F.when((n == 0) | (gap > 30), "archived").when(gap > 7, "resolved").when(recent == 0, "declining")
    out = out.when(recent > 1.5 * earlier, F.when(n > 3, "developing").otherwise("emerging"))
    return out.when(recent >= 0.8 * earlier, "peak").when(recent < 0.5 * earlier, "declining").otherwise("developing")


def heat_board(links: DataFrame, actors: DataFrame, as_of: DataFrame) -> DataFrame:
    """Heat, importance and status of each event of ``links (event_id, day)``.

    ``actors (event_id, actor)`` are the distinct people of events, ``as_of`` a table
    of one row and column: the date that all metrics refer to.
    """
    when = F.broadcast(as_of.toDF("as_of"))
    back = F.datediff("as_of", "day")
    own = links.crossJoin(when).groupBy("event_id").agg(F.count("*").alias("news_count"), F.min("day").alias("first_date"), F.max("day").alias("last_date"), F.min(back).alias("gap"), F.count_if(back <= 7).alias("recent"), F.count_if((back > 7) & (back <= 14)).alias("earlier"))
    own = own.join(actors.groupBy("event_id").agg(F.count_distinct("actor").alias("actors")), "event_id", "left").withColumn("actors", F.coalesce("actors", F.lit(0)))
    d = lambda c: F.col(c).cast("double")
    frequency = F.least(d("news_count") / 30, F.lit(1.0)) * 100
    recency = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - d("gap") * F.lit(100.0 / 30)))
    acceleration = F.when(F.col("earlier") > 0, F.least(F.try_divide(d("recent"), d("earlier")) * 50, F.lit(100.0))).when(F.col("recent") > 0, 50.0).otherwise(0.0)
    actor = F.least(d("actors") / 10, F.lit(1.0)) * 100
    own = own.withColumn("heat_score", round_even(0.4 * frequency + 0.3 * recency + 0.2 * acceleration + 0.1 * actor, 1))
    return own.select("event_id", "news_count", "first_date", "last_date", "recent", "earlier", "actors", "heat_score", importance(F.col("heat_score")).alias("importance"), status(F.col("news_count"), F.col("gap"), F.col("recent"), F.col("earlier")).alias("status"))


def related_events(event_person: DataFrame, events: DataFrame, top: int = 5) -> DataFrame:
    """For each event, the events that share most people, with the days from its end to their start; found by :func:`top_overlaps`, so a person of very many events makes no pairs of them."""
    n = top_overlaps(event_person.select(F.col("event_id").alias("item"), F.col("person_id").alias("member")), top)
    n = n.select(F.col("item").alias("source_event_id"), F.col("other").alias("target_event_id"), "shared")
    n = n.join(events.select(F.col("event_id").alias("source_event_id"), F.col("last_date").alias("ends")), "source_event_id").join(events.select(F.col("event_id").alias("target_event_id"), F.col("first_date").alias("starts")), "target_event_id")
    return n.select("source_event_id", "target_event_id", "shared", F.least(F.lit(0.2) * F.col("shared"), F.lit(1.0)).alias("similarity_score"), F.lit("thematic").alias("relation_type"), F.datediff("starts", "ends").alias("time_interval_days"))


def pipeline_stats(events: DataFrame, relations: DataFrame) -> DataFrame:
    own = events.agg(F.count("*").alias("events"), F.count_if(F.coalesce("summary", F.lit("")) != "").alias("with_summary"), F.count_if(F.col("importance") == "critical").alias("critical"))
    return own.crossJoin(relations.agg(F.count("*").alias("relations")))


def require_profiles(events: DataFrame, profiles: DataFrame) -> None:
    """Raise if an event has no profile: an incomplete build is not published."""
    missing = events.select("event_id").join(profiles.select("event_id"), "event_id", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} events have no profile")
