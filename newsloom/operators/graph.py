"""A bounded graph of items, people, organizations and topics, and PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.plans.scratch import materialize


def newest_items(items: DataFrame, limit: int = 100) -> DataFrame:
    return items.orderBy(F.desc("broadcast_date"), "order_in_broadcast", "news_id").limit(limit)


def selected(links: DataFrame, chosen: DataFrame, dim: DataFrame, key: str, top: int) -> DataFrame:
    """The ``top`` entities by links to the chosen items; such without a dimension row go after the cut."""
    n = links.join(F.broadcast(chosen.select("news_id")), "news_id", "left_semi").groupBy(key).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), key).limit(top).join(dim.select(key, F.col("name").alias("label")), key).select(key, "label", "n")


def graph_nodes(chosen: DataFrame, people: DataFrame, orgs: DataFrame, topics: DataFrame) -> DataFrame:
    """``id, kind, label`` of all nodes; of a title the first 40 characters."""
    kind = lambda df, key, name, k: df.select(F.concat(F.lit(f"{k}_"), F.col(key).cast("string")).alias("id"), F.lit(k).alias("kind"), F.col(name).alias("label"))
    return kind(chosen.withColumn("title", F.substring("title", 1, 40)), "news_id", "title", "news").unionByName(kind(people, "person_id", "label", "person")).unionByName(kind(orgs, "org_id", "label", "org")).unionByName(kind(topics, "topic_id", "label", "topic"))


def cooccurrence(links: DataFrame, chosen: DataFrame, people: DataFrame, limit: int = 50, least: int = 2) -> DataFrame:
    """Pairs of selected people by the chosen items they share."""
    own = links.join(F.broadcast(chosen.select("news_id")), "news_id", "left_semi").join(F.broadcast(people.select("person_id")), "person_id", "left_semi").distinct()
    a, b = own.select("news_id", F.col("person_id").alias("a")), own.select("news_id", F.col("person_id").alias("b"))
    n = a.join(b, "news_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)
    return n.orderBy(F.desc("weight"), "a", "b").limit(limit)


def graph_edges(chosen: DataFrame, news_person: DataFrame, people: DataFrame, news_org: DataFrame, orgs: DataFrame, news_topic: DataFrame, topics: DataFrame) -> DataFrame:
    """``source, target, kind, weight``: mentions, about and co_occur."""

    def links(rows: DataFrame, few: DataFrame, key: str, k: str, kind: str) -> DataFrame:
        own = rows.join(F.broadcast(chosen.select("news_id")), "news_id", "left_semi").join(F.broadcast(few.select(key)), key, "left_semi").select("news_id", key).distinct()
        return own.select(F.concat(F.lit("news_"), F.col("news_id").cast("string")).alias("source"), F.concat(F.lit(f"{k}_"), F.col(key).cast("string")).alias("target"), F.lit(kind).alias("kind"), F.lit(1).cast("long").alias("weight"))

    name = lambda c: F.concat(F.lit("person_"), F.col(c).cast("string"))
    pairs = cooccurrence(news_person, chosen, people).select(name("a").alias("source"), name("b").alias("target"), F.lit("co_occur").alias("kind"), "weight")
    return links(news_person, people, "person_id", "person", "mentions").unionByName(links(news_org, orgs, "org_id", "org", "mentions")).unionByName(links(news_topic, topics, "topic_id", "topic", "about")).unionByName(pairs)


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 30, damping: float = 0.85, every: int = 5) -> DataFrame:
    """``id, rank`` on the undirected simple graph; the mass of nodes without edges is spread evenly. Lineage is cut every few rounds."""
    e = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a <> b")
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    ids = nodes.select("id").distinct()
    e = e.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    e = materialize(e, "links")
    degree = e.groupBy(F.col("a").alias("of")).agg(F.count("*").alias("k"))
    own = materialize(ids.join(degree, F.col("id") == F.col("of"), "left").select("id", "k"), "degrees")
    alone = own.where("k is null").count()
    idle = alone / n  # all nodes without edges have the same rank, so their mass is one number
    ranks = own.select("id", F.lit(1.0 / n).alias("rank"), "k")
    for i in range(iterations):  # a hub's edges are rows, which a skewed join splits
        base = (1 - damping) / n + damping * idle / n
        got = e.join(ranks.select(F.col("id").alias("a"), (F.col("rank") / F.col("k")).alias("sent")), "a").groupBy("b").agg(F.sum("sent").alias("got"))
        ranks = own.join(got, F.col("id") == F.col("b"), "left").select("id", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"), "k")
        idle = alone * base
        if (i + 1) % every == 0 or i + 1 == iterations:
            ranks = materialize(ranks, "pagerank")
    return ranks.select("id", "rank")


def normalised(ranks: DataFrame) -> DataFrame:
    """Ranks between 0 and 1, rounded to 4 places; equal ranks are each one by their number."""
    span = F.broadcast(ranks.agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count("*").alias("n")))
    return ranks.crossJoin(span).select("id", F.round(F.when(F.col("hi") - F.col("lo") > 1e-15, F.try_divide(F.col("rank") - F.col("lo"), F.col("hi") - F.col("lo"))).otherwise(F.lit(1.0) / F.col("n")), 4).alias("pagerank"))


def sanitised(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def radius(nodes: DataFrame) -> DataFrame:
    """Drawing size of nodes with ``kind`` and ``pagerank``."""
    base = F.when(F.col("kind") == "news", 4).when(F.col("kind") == "topic", 8).otherwise(6)
    return nodes.withColumn("radius", base + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("pagerank"))) * F.when(F.col("kind") == "news", 14).otherwise(18))
