"""Daily text files: one ``YYYYMMDD.md`` a broadcast, a ``## `` heading for each item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.text import news_id

# What stands before and after an item's URL.
_BEFORE, _AFTER = "<!-- source_url: ", " -->"


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``file, content`` of all Markdown files of a folder."""
    return spark.read.text(f"{folder}/*.md", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("content"))


def file_date(file: Column) -> Column:
    """The date of a file's name; null unless it is eight digits and a date."""
    return F.when(file.rlike(r"^\d{8}\.md$"), F.try_to_date(F.substring(file, 1, 8), "yyyyMMdd"))


def parse(files: DataFrame) -> DataFrame:
    """``file, broadcast_date, order_in_broadcast, news_id, title, full_text, url`` of all items.

    Before the first ``## `` nothing counts; rules ``---``, headings ``# `` and blank
    lines are skipped; a comment line ``<!-- source_url: ... -->`` is the item's URL,
    the last of several. A row whose date or URL is wrong has ``error`` set.
    """
    lines = files.select("file", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("pos", "line"))
    by_file = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("is_item", F.col("line").startswith("## ")).withColumn("item", F.count_if("is_item").over(by_file)).where("item > 0")
    marked = F.col("line").startswith(_BEFORE) & F.col("line").endswith(_AFTER) & (F.length("line") >= len(_BEFORE) + len(_AFTER))
    url = F.trim(F.substring(F.col("line"), F.lit(len(_BEFORE) + 1), F.length("line") - len(_BEFORE) - len(_AFTER)))
    lines = lines.withColumn("url", F.when(marked & ~F.col("is_item"), url))
    body = ~F.col("is_item") & F.col("url").isNull() & (F.trim("line") != "---") & (F.trim("line") != "") & ~F.col("line").startswith("# ")
    out = lines.groupBy("file", "item").agg(
        F.max(F.when(F.col("is_item"), F.trim(F.substring("line", 4, 1 << 30)))).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(body, F.struct("pos", "line")))), lambda x: x["line"]), "\n").alias("full_text"),
        F.max_by("url", F.when(F.col("url").isNotNull(), F.col("pos"))).alias("url"),
    )
    date = file_date(F.col("file"))
    bad_url = F.col("url").isNotNull() & ~F.col("url").rlike("^https?://")
    error = F.when(date.isNull(), "file name is no date").when(bad_url, "url is not http").when(F.coalesce("title", F.lit("")) == "", "no title").when(F.trim("full_text") == "", "no text")
    return out.select("file", date.alias("broadcast_date"), F.col("item").cast("int").alias("order_in_broadcast"), news_id(date, F.col("item")).alias("news_id"), "title", "full_text", "url", error.alias("error"))


def render(items: DataFrame) -> DataFrame:
    """``file, content``: the files that :func:`parse` reads back to the same items."""
    url = F.when(F.col("url").isNotNull(), F.concat(F.lit(_BEFORE), F.col("url"), F.lit(f"{_AFTER}\n\n"))).otherwise("")
    item = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), url, F.col("full_text"), F.lit("\n\n---\n"))
    own = items.groupBy("broadcast_date").agg(F.array_sort(F.collect_list(F.struct("order_in_broadcast", item.alias("x")))).alias("x"))
    day = F.date_format("broadcast_date", "yyyyMMdd")
    return own.select(F.concat(day, F.lit(".md")).alias("file"), F.concat(F.lit("# "), day, F.lit("\n\n"), F.array_join(F.transform("x", lambda x: x["x"]), "\n")).alias("content"))


def broadcast_dates(spark: SparkSession, end: str, days_back: int) -> DataFrame:
    """The dates of the last days, as the names of pages."""
    return spark.sql(f"select explode(sequence(date_sub(date '{end}', {int(days_back) - 1}), date '{end}', interval 1 day)) as d").select(F.date_format("d", "yyyyMMdd").alias("date")).orderBy(F.desc("date"))
