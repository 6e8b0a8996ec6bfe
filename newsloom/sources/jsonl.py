"""Article records from JSON lines or a fixture document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "news_id string, title string, broadcast_date string, topics string, people string, organizations string, keywords string"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object a line; list columns are kept as JSON text, as elements may have either shape."""
    return spark.read.schema(RECORD).json(path)


def read_fixture(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records and ``(news_id, label)`` of a document ``{fixture_type, records, labels}``."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"fixture_type string, records array<struct<{RECORD.replace(' ', ':').replace(',:', ',')}>>, labels map<string,string>").alias("d")).select("d.*")
    kind = [r["fixture_type"] for r in doc.select("fixture_type").limit(2).collect()]
    if len(kind) != 1 or kind[0] not in ("synthetic", "human_reviewed"):
        raise ValueError("a fixture is one document of a known type")
    return doc.select(F.inline("records")), doc.select(F.explode("labels").alias("news_id", "label"))


def names(column: Column, key: str = "name") -> Column:
    """Distinct stripped names of a JSON list of objects or bare names, sorted; none where it is no list."""
    each = F.try_variant_get(F.try_parse_json(column), "$", "array<variant>")
    name = lambda x: F.trim(F.coalesce(F.try_variant_get(x, f"$.{key}", "string"), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))))
    own = F.filter(F.transform(each, name), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_sort(F.array_distinct(own)), F.array().cast("array<string>"))


def parse_articles(records: DataFrame) -> DataFrame:
    """Articles as clustering takes them; repeated or missing ids, titles and dates are errors."""
    own = records.select("news_id", "title", F.try_to_date("broadcast_date", "yyyy-MM-dd").alias("day"), names(F.col("topics")).alias("topics"), names(F.col("people"), "name_chinese").alias("people"), names(F.col("organizations")).alias("organizations"), names(F.col("keywords")).alias("keywords"))
    bad = own.where((F.coalesce("news_id", F.lit("")) == "") | F.col("title").isNull() | F.col("day").isNull()).count()
    twice = own.groupBy("news_id").count().where("count > 1").count()
    if bad or twice:
        raise ValueError(f"{bad} records without id, title or date, {twice} repeated ids")
    return own
