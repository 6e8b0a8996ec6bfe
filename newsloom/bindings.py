"""How the ontology's tables are taken from the star schema, the event stream and the document tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.text import GENERIC_HEADLINES
from newsloom.schema import ORG_TYPES

CATEGORIES = ("Economy", "Politics", "Military", "Technology", "Culture", "Environment")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Relational:
    """Orders as items, suppliers as people, nations as organizations, brands as topics, customers as events."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.t = lambda name: table(spark, sf_dir, name)

    def items(self) -> DataFrame:
        o = self.t("orders")
        day = F.col("o_orderdate").cast("date")
        title = F.concat_ws(" ", "o_orderpriority", "o_orderstatus")
        order = F.row_number().over(Window.partitionBy(day).orderBy("o_orderkey"))
        return o.select(F.col("o_orderkey").alias("news_id"), day.alias("broadcast_date"), order.alias("order_in_broadcast"), title.alias("title"), F.concat(title, F.lit(" order "), F.col("o_orderkey").cast("string")).alias("full_text"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("summary"), F.col("o_custkey").alias("event_id"))

    def persons(self) -> DataFrame:
        return self.t("supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"), F.upper("s_name").alias("name_chinese"), F.concat(F.lit("Supplier of nation "), F.col("s_nationkey").cast("string")).alias("title"), F.col("s_nationkey").alias("organization_id"))

    def orgs(self) -> DataFrame:
        kind = F.element_at(F.array(*map(F.lit, ORG_TYPES)), F.pmod("n_regionkey", F.lit(len(ORG_TYPES))).cast("int") + 1)
        return self.t("nation").select(F.col("n_nationkey").alias("org_id"), F.col("n_name").alias("name"), kind.alias("type"))

    def topics(self) -> DataFrame:
        n = F.pmod(F.substring("p_brand", 7, 9).cast("int"), F.lit(len(CATEGORIES)))
        return self.t("part").select(F.col("p_brand").alias("topic_id"), F.col("p_brand").alias("name"), F.element_at(F.array(*map(F.lit, CATEGORIES)), n + 1).alias("category")).distinct()

    def news_person(self) -> DataFrame:
        return self.t("lineitem").select(F.col("l_orderkey").alias("news_id"), F.col("l_suppkey").alias("person_id")).distinct()

    def news_org(self) -> DataFrame:
        s = self.t("supplier").select("s_suppkey", F.col("s_nationkey").alias("org_id"))
        return self.t("lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("news_id"), "org_id").distinct()

    def news_topic(self, topic=None) -> DataFrame:
        """Topics of orders with the share of an order's quantity; ``topic`` is a column of part, the brand by default."""
        p = self.t("part").select("p_partkey", (F.col("p_brand") if topic is None else topic).alias("topic_id"))
        q = self.t("lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("news_id"), "topic_id").agg(F.sum("l_quantity").alias("q"))
        return q.select("news_id", "topic_id", (F.col("q") / F.sum("q").over(Window.partitionBy("news_id"))).alias("relevance_score"))

    def links(self) -> DataFrame:
        return self.t("orders").select(F.col("o_orderkey").alias("news_id"), F.col("o_custkey").alias("event_id"))


SQL_R = f"""
items as (select o_orderkey as news_id, cast(o_orderdate as date) as broadcast_date, cast(row_number() over (partition by cast(o_orderdate as date) order by o_orderkey) as int) as order_in_broadcast,
  o_orderpriority || ' ' || o_orderstatus as title, o_orderpriority || ' ' || o_orderstatus || ' order ' || o_orderkey as full_text, case when o_orderstatus = 'F' then o_orderpriority end as summary, o_custkey as event_id from orders),
persons as (select s_suppkey as person_id, s_name as name, upper(s_name) as name_chinese, 'Supplier of nation ' || s_nationkey as title, s_nationkey as organization_id from supplier),
orgs as (select n_nationkey as org_id, n_name as name, ([{', '.join(repr(c) for c in ORG_TYPES)}])[cast(n_regionkey as int) % {len(ORG_TYPES)} + 1] as type from nation),
topics as (select distinct p_brand as topic_id, p_brand as name, ([{', '.join(repr(c) for c in CATEGORIES)}])[cast(substr(p_brand, 7) as int) % {len(CATEGORIES)} + 1] as category from part),
news_person as (select distinct l_orderkey as news_id, l_suppkey as person_id from lineitem),
news_org as (select distinct l_orderkey as news_id, s_nationkey as org_id from lineitem join supplier on l_suppkey = s_suppkey),
topic_q as (select l_orderkey as news_id, p_brand as topic_id, sum(l_quantity) as q from lineitem join part on l_partkey = p_partkey group by all),
news_topic as (select news_id, topic_id, q / sum(q) over (partition by news_id) as relevance_score from topic_q),
links as (select o_orderkey as news_id, o_custkey as event_id from orders)
"""


def stream_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the event stream as items of the event of their user."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("event_id"), F.col("event_id").alias("news_id"), F.col("ts").cast("date").alias("day"), F.col("event_type").alias("actor"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles, a null text as an empty one: the first line is the title, language and source are topics, the source is the organization."""
    title = F.split("text", "\n").getItem(0)
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    long_words = F.array_sort(F.array_distinct(F.filter(F.split(title, " "), lambda w: F.length(w) >= 5)))
    return d.select(F.col("doc_id").alias("news_id"), title.alias("title"), F.col("text").alias("full_text"), F.expr("date_add(date '2024-01-01', cast(doc_id % 30 as int))").alias("day"), F.array("lang", "source").alias("topics"), F.array(F.concat(F.lit("by "), F.col("source"))).alias("people"), F.array("source").alias("organizations"), long_words.alias("keywords"), F.when(F.col("lang") == "en", title).alias("summary"), F.substring("text", 1, 200).alias("excerpt"), F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"))


#: The digests' headlines as SQL takes them.
_GENERIC = ", ".join(f"'{h}'" for h in GENERIC_HEADLINES)
SQL_T = r"""
articles as (select doc_id as news_id, split_part(text, chr(10), 1) as title, text as full_text, date '2024-01-01' + cast(doc_id % 30 as int) as day, [lang, source] as topics, ['by ' || source] as people, [source] as organizations,
  list_sort(list_distinct(list_filter(string_split(split_part(text, chr(10), 1), ' '), lambda w: length(w) >= 5))) as keywords, case when lang = 'en' then split_part(text, chr(10), 1) end as summary, substr(text, 1, 200) as excerpt, 'https://' || source || '.example/' || doc_id as url from (select doc_id, coalesce(text, '') as text, lang, source from documents)),
heads as (select *, lower(regexp_replace(trim(regexp_replace(title, '^【[^】]{1,32}】', '')), '[^\p{L}\p{N}]+', '', 'g')) as head from articles),
prep as (select *, case when length(head) < 4 or head in (GENERIC) then [] else list_distinct(list_transform(range(1, length(head)), lambda i: substr(head, cast(i as int), 2))) end as grams from heads)
""".replace("GENERIC", _GENERIC)
SQL_PAIRS = (
    SQL_T
    + r""",
total as (select count(*) as n from articles),
topic_rows as (select distinct news_id, unnest(topics) as topic from articles),
generic as (select topic from topic_rows group by topic order by count(*) desc, topic limit 3),
anchor_rows as (
  select 'topic' as kind, 5 as share, news_id, day, anchor from (select news_id, day, unnest(list_distinct(topics)) as anchor from prep) where anchor not in (select topic from generic)
  union all select 'person', 10, news_id, day, unnest(list_distinct(people)) from prep
  union all select 'organization', 10, news_id, day, unnest(list_distinct(organizations)) from prep
  union all select 'gram', 12, news_id, day, unnest(list_distinct(grams)) from prep),
fit as (select kind, anchor from anchor_rows, total group by kind, anchor, share, n having count(*) <= greatest(2, n // share) and count(*) <= 150 and count(*) > 1),
rare as (select a.* from anchor_rows a join fit f on a.kind = f.kind and a.anchor = f.anchor),
pairs as (select distinct a.news_id as l, b.news_id as r from rare a join rare b on a.kind = b.kind and a.anchor = b.anchor and a.news_id < b.news_id and abs(a.day - b.day) <= 7)
"""
)
SQL_EDGES = (
    SQL_PAIRS
    + r""",
met as (select l, r, a.grams as ga, b.grams as gb, a.keywords as ka, b.keywords as kb, a.people as pa, b.people as pb, a.organizations as oa, b.organizations as ob,
    len(list_filter(list_intersect(a.topics, b.topics), lambda t: not list_contains(gt, t))) as st, len(list_intersect(a.people, b.people)) as sp, len(list_intersect(a.organizations, b.organizations)) as so, a.head as ha, b.head as hb
  from pairs join prep a on a.news_id = l join prep b on b.news_id = r, (select list(topic) as gt from generic)),
sims as (select *, case when len(ga) > 0 and len(gb) > 0 then len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb)))::double else 0.0::double end as lex, case when len(ka) > 0 and len(kb) > 0 then len(list_intersect(ka, kb)) / len(list_distinct(list_concat(ka, kb)))::double else 0.0::double end as kw,
    case when len(pa) > 0 and len(pb) > 0 then sp / len(list_distinct(list_concat(pa, pb)))::double else 0.0::double end as actor, case when len(oa) > 0 and len(ob) > 0 then so / len(list_distinct(list_concat(oa, ob)))::double else 0.0::double end as org
  from met where not (len(oa) > 0 and len(ob) > 0 and so = 0 and sp = 0) and ha not in (GENERIC) and hb not in (GENERIC)),
scored as (select *, 0.60::double * lex + 0.18::double * kw + 0.12::double * actor + 0.07::double * org + (case when st > 0 then 0.03 else 0.0 end)::double as raw from sims),
edges as (select * from scored where (st > 0 or sp > 0 or so > 0) and (lex >= 0.34 or (lex >= 0.20 and kw >= 0.25)) and raw >= 0.34)
""".replace("GENERIC", _GENERIC)
)
