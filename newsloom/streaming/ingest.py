"""Incremental ingest: items that arrive as files, and counts by trailing windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.session import ship

_CHANGE = "news_id string, title string, full_text string, broadcast_date date, order_in_broadcast int, url string, state string, filled boolean"


def read_items(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of item rows from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_arrivals(items: DataFrame, key: str, ts: str, late: str = "7 days") -> DataFrame:
    """Each key once; what arrives later than the watermark allows is dropped with its state."""
    return items.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def import_changes(items: DataFrame) -> DataFrame:
    """``news_id, title, full_text, broadcast_date, order_in_broadcast, url, state, filled`` for each arriving row of items.

    State by id keeps the content's hash and the URL of what came first, across batches
    and restarts. A row is new, the same, or changed, as in an import; changed rows leave
    the state alone. ``url`` is the URL known after the row, ``filled`` whether it gave
    the item its first one. Rows of one batch are taken in the order of content and URL,
    so that the order of files plays no part. Null ids are left out. State grows with the
    items, not with the rows.
    """
    ship(items.sparkSession)
    content = F.sha2(F.to_json(F.struct("title", "full_text", F.col("broadcast_date").cast("string"), "order_in_broadcast")), 256)
    own = items.where("news_id is not null").select("news_id", "title", "full_text", "broadcast_date", F.col("order_in_broadcast").cast("int").alias("order_in_broadcast"), "url", content.alias("content"))

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        content, url = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values(["content", "url"], na_position="last", kind="stable")
        states, urls, filled = [], [], []
        for c, u in zip(rows["content"], rows["url"], strict=True):
            u = u if isinstance(u, str) else None
            kind = "new" if content is None else "same" if c == content else "changed"
            content = c if content is None else content
            filled.append(kind == "same" and url is None and u is not None)
            url = u if kind != "changed" and url is None else url
            states.append(kind)
            urls.append(url)
        state.update((content, url))
        yield rows.drop(columns="content").assign(url=urls, state=states, filled=filled)

    return own.groupBy("news_id").applyInPandasWithState(judge, _CHANGE, "content string, url string", "append", GroupStateTimeout.NoTimeout)


def imported(changes: DataFrame) -> DataFrame:
    """The items that the rows of :func:`import_changes` amount to: each new one, with the URL that it or a later row gave it."""
    urls = changes.where("state <> 'changed'").groupBy("news_id").agg(F.max("url").alias("url"))
    return changes.where("state = 'new'").drop("url", "state", "filled").join(urls, "news_id")


def heat_windows(items: DataFrame, key: str, ts: str, late: str = "1 day", length: str = "7 days", step: str = "1 day") -> DataFrame:
    """Items of each key in sliding windows, the ingredients of heat."""
    return items.withWatermark(ts, late).groupBy(F.window(ts, length, step), key).agg(F.count("*").alias("news_count")).select(key, F.col("window.start").alias("starts"), F.col("window.end").alias("ends"), "news_count")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append", out: str | None = None) -> DataFrame:
    """Process what is there and stop; the checkpoint makes a rerun go on from there.

    Each batch is a folder of Parquet files below ``out`` (by default beside the
    checkpoint), which a repeated batch replaces. The result, also the view ``name``,
    is all batches, or with mode complete the last one.
    """
    spark, out = stream.sparkSession, out or f"{checkpoint}-out"

    def write(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={i}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    done = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    if mode == "complete":
        done = done.where(F.col("batch") == done.agg(F.max("batch")).first()[0])
    done = done.drop("batch")
    done.createOrReplaceTempView(name)
    return done
