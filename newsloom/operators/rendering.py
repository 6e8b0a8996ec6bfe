"""Results as lines of text, a row for each entry; what a command line would print, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.search import numbered


def bar(n: Column, most: int | None = None) -> Column:
    """A bar of ``n`` blocks, of at most ``most``."""
    return F.repeat(F.lit("█"), F.greatest(F.lit(0), n if most is None else F.least(n, F.lit(most))).cast("int"))


def search_lines(found: DataFrame) -> DataFrame:
    """Date and title of each hit, and on a second line the beginning of its text."""
    head = F.format_string("  [%s] %s", F.col("broadcast_date").cast("string"), F.substring("title", 1, 70))
    excerpt = F.replace(F.substring(F.coalesce("excerpt", F.lit("")), 1, 120), F.lit("\n"), F.lit(" "))
    return found.select("news_id", F.concat(head, F.when(excerpt != "", F.concat(F.lit("\n       "), excerpt, F.lit("..."))).otherwise("")).alias("line"))


def evolution_lines(evolution: DataFrame) -> DataFrame:
    """A topic's items by date, as a number and a bar."""
    n = F.col("item_count")
    return evolution.select("broadcast_date", F.format_string("  %s  %2d %s", F.col("broadcast_date").cast("string"), n, bar(n)).alias("line"))


def network_lines(network: DataFrame) -> DataFrame:
    """Topics beside another, as a number and a bar of at most 20 blocks."""
    n = F.col("cooccurrence")
    return network.select("topic_id", F.format_string("  %-20s %2d %s", "name", n, bar(n, 20)).alias("line"))


def date_lines(summary: DataFrame) -> DataFrame:
    """Items of a date in order, with people and organizations where there are any."""
    names = lambda c, label: F.when(F.size(c) > 0, F.concat(F.lit(f"\n     {label}: "), F.array_join(c, ", "))).otherwise("")
    head = F.format_string("  #%d %s", "order_in_broadcast", F.substring("title", 1, 70))
    return summary.select("news_id", F.concat(head, names("people", "People"), names("organizations", "Orgs")).alias("line"))


def event_lines(events: DataFrame, name: str = "name") -> DataFrame:
    """Events with importance, status, heat, size, dates and a bar of a block for each 5 degrees, at most 20."""
    heat = F.coalesce("heat_score", F.lit(0.0))
    line = F.format_string(
        "  [%-10s] %s\n    Status: %-12s Heat: %d Items: %d\n    %s -> %s  %s",
        "importance", F.substring(F.col(name).cast("string"), 1, 60), "status", F.bround(heat, 0).cast("long"), "item_count", F.col("first_date").cast("string"), F.col("last_date").cast("string"), bar(F.floor(heat / 5), 20),
    )
    return events.select("event_id", line.alias("line"))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _lines(df: DataFrame, section: int, *lines: Column) -> DataFrame:
    """Lines of a table of one row; null ones are left out."""
    rows = df.select(F.posexplode(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("position", "line"))
    return rows.select(F.lit(section).alias("section"), (F.col("position") + 1).cast("long").alias("position"), "line")


def _listed(df: DataFrame, section: int, order: list, line: Column, limit: int) -> DataFrame:
    """A line for each of the first ``limit`` rows."""
    first = df.orderBy(*order).limit(limit)
    return first.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("position"), line.alias("line"))


def stats_lines(stats: DataFrame) -> DataFrame:
    """``section, position, line`` of the corpus in numbers."""
    n = lambda label, *c: F.concat(F.rpad(F.lit(f"  {label}:"), 18, " "), *c)
    return _lines(stats, 1, n("News Items", _text("items")), n("Dates", _text("dates")), n("Persons", _text("persons")), n("Organizations", _text("organizations")), n("Topics", _text("topics")), n("AI Enhanced", _text("enhanced"), F.lit("/"), _text("items")))


def person_lines(person: DataFrame, organization: DataFrame, topics: DataFrame, items: DataFrame, recent: int = 10) -> DataFrame:
    """``section, position, line`` of a person: name, title, organization and number of items, their topics, and the latest items. No lines for a person that isn't known."""
    head = person.select("person_id", "name_chinese", "title").limit(1).join(organization.select("person_id", "org_name"), "person_id", "left").crossJoin(items.agg(F.count("*").alias("n")))
    org = F.when(F.col("org_name").isNotNull(), F.concat(F.lit("  Organization: "), _text("org_name")))
    top = _lines(head, 1, F.concat(F.lit("Person: "), _text("name_chinese"), F.lit(" (ID: "), _text("person_id"), F.lit(")")), F.concat(F.lit("  Title: "), F.coalesce("title", F.lit("N/A"))), org, F.concat(F.lit("  Appearances: "), _text("n")))
    of_topics = _listed(topics, 2, [F.desc("item_count"), "topic_id"], F.format_string("    %-20s %d appearances", "name", "item_count"), 10)
    latest = _listed(items, 3, [F.desc("broadcast_date"), "news_id"], F.concat(F.lit("    ["), _text("broadcast_date"), F.lit("] "), F.substring("title", 1, 60)), recent)
    return top.unionByName(of_topics).unionByName(latest).orderBy("section", "position")


def event_detail_lines(event: DataFrame, items: DataFrame, actors: DataFrame, relations: DataFrame) -> DataFrame:
    """``section, position, line`` of an event: what it is, its summary, key actors, related events ``(name, importance)`` by falling similarity, and the timeline of all its items."""
    head = event.limit(1).crossJoin(items.agg(F.count("*").alias("n")))
    heat = F.bround(F.coalesce("heat_score", F.lit(0.0)), 0).cast("long")
    top = _lines(
        head, 1, F.concat(F.lit("Event: "), _text("name")), F.format_string("  Type: %-15s Importance: %s", "type", "importance"), F.format_string("  Status: %-12s Heat: %d", "status", heat),
        F.format_string("  Timeline: %s -> %s (%d items)", _text("first_date"), _text("last_date"), "n"), F.concat(F.lit("  Summary: "), F.nullif("summary", F.lit(""))),
    )
    who = _listed(actors, 2, ["person_id"], F.concat(F.lit("    "), _text("name_chinese"), F.lit(" ("), _text("role"), F.lit(")")), 10)
    related = _listed(relations, 3, [F.desc("similarity_score"), "target_event_id"], F.concat(F.lit("    ["), _text("importance"), F.lit("] "), F.substring("name", 1, 50)), 5)
    line = F.concat(F.lit("    ["), _text("broadcast_date"), F.lit("] "), F.substring("title", 1, 60))
    return top.unionByName(who).unionByName(related).unionByName(numbered(items).select(F.lit(4).alias("section"), "position", line.alias("line"))).orderBy("section", "position")
