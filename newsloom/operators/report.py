"""The variants of clustering side by side: blocking, shape and, with gold labels, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import clusters, metrics
from newsloom.plans.scratch import materialize

VARIANTS = ("legacy", "connected", "constrained")


def ablations(articles: DataFrame, gold: DataFrame | None = None, window_days: int = 7, minimum_score: float = 0.34) -> DataFrame:
    """A row for each variant: the pairs that blocking leaves, accepted edges, the clusters' shape, ids of its first clusters of several articles.

    With ``gold (item, label)``, a partition of the articles, also the retrieval of
    blocking and of edges (none for legacy) and pairwise and B-Cubed precision,
    recall and F1; without, these are null. Concentration is a diagnostic, not
    accuracy, and preview ids are no event ids.
    """
    blocked = materialize(clusters.blocked_pairs(articles, window_days), "blocked")
    edges = materialize(clusters.candidate_edges(articles, window_days, minimum_score, blocked), "edges")
    named = lambda df, *columns, prefix: df.select(*[F.col(c).cast("double").alias(f"{prefix}_{c}") for c in columns])
    quality = ("precision", "recall", "f1")
    empty = lambda prefix: articles.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(f"{prefix}_{c}") for c in quality])
    retrieval = lambda pairs, prefix: empty(prefix) if gold is None or pairs is None else named(metrics.pair_retrieval(gold, pairs.select("left", "right")), *quality, prefix=prefix)
    of_blocks = materialize(blocked.agg(F.count("*").alias("blocked_pairs")).crossJoin(retrieval(blocked, "blocking")), "blocking")
    n_edges = edges.count()
    out = None
    for variant in VARIANTS:
        if variant == "legacy":
            found = clusters.cluster(articles, variant, minimum_score, window_days)
        else:
            found = clusters.connected_clusters(articles, edges) if variant == "connected" else clusters.constrained_clusters(articles, edges)
        found = materialize(found, variant)
        own = found.select(F.col("news_id").alias("item"), F.col("cluster_id").alias("label"))
        shape = metrics.diagnostics(own.join(articles.select(F.col("news_id").alias("item"), "day"), "item"))
        sizes = metrics.size_histogram(own).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("size", "clusters"))), lambda x: F.concat_ws(":", x["size"], x["clusters"])), ",").alias("size_histogram"))
        previews = clusters.preview(found).select("cluster_id", "preview_id").distinct().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster_id", "preview_id"))), lambda x: x["preview_id"]), ",").alias("previews"))
        row = of_blocks.crossJoin(shape).crossJoin(sizes).crossJoin(previews).crossJoin(retrieval(None if variant == "legacy" else edges, "edge"))
        for prefix, measure in (("pairwise", metrics.pairwise_metrics), ("bcubed", metrics.bcubed_metrics)):
            row = row.crossJoin(empty(prefix) if gold is None else named(measure(gold, own), *quality, prefix=prefix))
        row = row.select(F.lit(variant).alias("variant"), F.lit(0 if variant == "legacy" else n_edges).cast("long").alias("qualified_pair_edges"), "*")
        out = row if out is None else out.unionByName(row)
    return out
