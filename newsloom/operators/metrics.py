"""Clustering quality from contingency counts; nothing here enumerates pairs of items.

Partitions are long tables ``(item, label)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import round_even


def _pairs(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


def check_partition(labels: DataFrame, expected: DataFrame) -> None:
    """Raise unless ``labels (item, label)`` names each expected item once, with a label that isn't blank."""
    blank = F.coalesce(F.trim(F.col("label").cast("string")), F.lit("")) == ""
    own = labels.groupBy("item").agg(F.count("*").alias("n"), F.count_if(blank).alias("blank"))
    both = own.join(expected.groupBy("item").agg(F.count("*").alias("e")), "item", "full_outer")
    twice, blanks, lost, extra = both.agg(F.count_if((F.col("n") > 1) | (F.col("e") > 1)), F.coalesce(F.sum("blank"), F.lit(0)), F.count_if(F.col("n").isNull()), F.count_if(F.col("e").isNull())).first()
    if twice or blanks or lost or extra:
        raise ValueError(f"not a partition: {twice} repeated, {blanks} without a label, {lost} missing, {extra} unexpected items")


def _cells(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    check_partition(gold, gold.select("item"))
    check_partition(predicted, gold.select("item"))
    both = gold.select("item", F.col("label").alias("g")).join(predicted.select("item", F.col("label").alias("p")), "item")
    return both.groupBy("g", "p").agg(F.count("*").alias("n"))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, F.try_divide(2 * p * r, p + r)).otherwise(0.0)


def pairwise_metrics(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """True, false and missed pairs, precision, recall and F1 of pairs put together.

    Without predicted pairs precision is 1 if there are no gold pairs either, else 0;
    without gold pairs recall is 1. Both must be partitions of the same items.
    """
    cells = _cells(gold, predicted)
    tp = cells.agg(F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0)).alias("tp"))
    total = lambda k, name: cells.groupBy(k).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0)).alias(name))
    out = tp.crossJoin(total("p", "together")).crossJoin(total("g", "wanted"))
    out = out.select("tp", (F.col("together") - F.col("tp")).alias("fp"), (F.col("wanted") - F.col("tp")).alias("fn"))
    d = lambda c: F.col(c).cast("double")
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.try_divide(d("tp"), d("tp") + d("fp"))).when(F.col("fn") == 0, 1.0).otherwise(0.0)
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.try_divide(d("tp"), d("tp") + d("fn"))).otherwise(1.0)
    return out.select("tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"))


def bcubed_metrics(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Mean over items of the shares of its predicted and its gold cluster that the two have in common; 1 without items. Both must be partitions of the same items."""
    cells = _cells(gold, predicted)
    p, g = cells.groupBy("p").agg(F.sum("n").alias("np")), cells.groupBy("g").agg(F.sum("n").alias("ng"))
    n = F.sum("n")
    square = (F.col("n") * F.col("n")).cast("double")
    out = cells.join(p, "p").join(g, "g").agg(F.coalesce(F.sum(square / F.col("np")) / n, F.lit(1.0)).alias("precision"), F.coalesce(F.sum(square / F.col("ng")) / n, F.lit(1.0)).alias("recall"))
    return out.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def diagnostics(clusters: DataFrame) -> DataFrame:
    """Of ``(item, label, day)``: items, clusters, the largest and its share, single ones, longest span in days."""
    size = clusters.groupBy("label").agg(F.count("*").alias("n"), F.datediff(F.max("day"), F.min("day")).alias("span"))
    return size.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.count("*").alias("clusters"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.coalesce(F.try_divide(F.max("n").cast("double"), F.sum("n")), F.lit(0.0)).alias("largest_share"), F.count_if(F.col("n") == 1).alias("singletons"), F.coalesce(F.max("span"), F.lit(0)).alias("max_span_days"))


def size_histogram(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("label").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))


def pair_retrieval(gold: DataFrame, pairs: DataFrame) -> DataFrame:
    """Precision, recall and F1 of retrieved ``(left, right)`` pairs against a gold partition; a pair of an item with itself or with an unknown one is an error."""
    check_partition(gold, gold.select("item"))
    p = pairs.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct()
    g = gold.select("item", "label")
    met = p.join(g.select(F.col("item").alias("left"), F.col("label").alias("a")), "left", "left").join(g.select(F.col("item").alias("right"), F.col("label").alias("b")), "right", "left")
    wrong = met.where("a is null or b is null or left = right").count()
    if wrong:
        raise ValueError(f"{wrong} invalid candidate pairs")
    got = met.agg(F.count("*").alias("retrieved"), F.count_if(F.col("a") == F.col("b")).alias("hits"))
    wanted = gold.groupBy("label").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0)).alias("wanted"))
    d = lambda c: F.col(c).cast("double")
    precision = F.when(F.col("retrieved") > 0, F.try_divide(d("hits"), d("retrieved"))).when(F.col("wanted") == 0, 1.0).otherwise(0.0)
    recall = F.when(F.col("wanted") > 0, F.try_divide(d("hits"), d("wanted"))).otherwise(1.0)
    return got.crossJoin(wanted).select("retrieved", "hits", "wanted", precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"))


def event_quality(links: DataFrame, news: DataFrame, share: float = 0.25) -> DataFrame:
    """How events cover the news: assigned, unassigned, dangling, the largest, single ones, mean size, whether a review is due."""
    if links.groupBy("event_id", "news_id").count().where("count > 1").count():
        raise ValueError("an item occurs twice in an event")
    size = links.groupBy("event_id").agg(F.count("*").alias("n"))
    sizes = size.agg(F.count("*").alias("event_count"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_event_size"), F.count_if(F.col("n") == 1).alias("singleton_events"), F.coalesce(round_even(F.avg("n"), 2), F.lit(0.0)).alias("average_event_size"))
    member = links.select("news_id").distinct()
    total = news.select("news_id").agg(F.count("*").alias("news_count"))
    here = member.join(news.select("news_id"), "news_id", "left_semi").agg(F.count("*").alias("assigned"))
    away = member.join(news.select("news_id"), "news_id", "left_anti").agg(F.count("*").alias("dangling"))
    out = total.crossJoin(sizes).crossJoin(here).crossJoin(away)
    part = F.coalesce(F.try_divide(F.col("largest_event_size").cast("double"), F.col("news_count")), F.lit(0.0))
    return out.select("news_count", "event_count", "assigned", (F.col("news_count") - F.col("assigned")).alias("unassigned"), "dangling", "largest_event_size", round_even(part, 4).alias("largest_event_share"), "singleton_events", "average_event_size", (part > share).alias("requires_review"))
