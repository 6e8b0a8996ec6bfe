"""Ontology operators on small tables: known values, order independence, errors, faults."""

import datetime
import json
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import annotation, clusters, events, exports, graph, loading, metrics, report, search
from newsloom.plans import publish
from newsloom.plans.components import connected_components, contracted_components
from newsloom.sources import html, jsonl, markdown

ARTICLE = "news_id string, title string, day date, topics array<string>, people array<string>, organizations array<string>, keywords array<string>"


def day(n):
    return datetime.date(2026, 9, n)


def corpus(spark):
    a = lambda i, t, d, topics, org=(), people=(), kw=(): (i, t, day(d), list(topics), list(people), list(org), list(kw))
    rows = [
        a("a1", "North river towns begin flood relief work", 1, ["weather"], ["north office"]),
        a("a2", "North river towns continue flood relief work", 2, ["weather"], ["north office"]),
        a("b1", "North river towns begin flood relief work", 2, ["weather"], ["south office"]),
        a("c1", "Rocket carries new satellite to orbit", 1, ["space"], ["launch site"], kw=["rocket", "orbit"]),
        a("c2", "A new satellite reaches orbit on rocket", 2, ["space"], ["launch site"], kw=["rocket", "orbit"]),
        a("g1", "【要闻】国内联播快讯", 1, ["digest"]),
        a("g2", "国内联播快讯", 2, ["digest"]),
        a("k1", "An isolated item of its own", 4, ["other"]),
    ]
    return spark.createDataFrame(rows, ARTICLE)


def partition(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cluster_id"], set()).add(r["news_id"])
    return sorted(sorted(v) for v in out.values())


def one(df):
    (r,) = df.collect()
    return r.asDict()


def col(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_headlines_and_grams(spark):
    assert col(spark, "【快讯】 Größe, 中文—Title 9!", text.headline) == "größe中文title9"
    assert sorted(col(spark, "abab", text.grams)) == ["ab", "ba"]
    assert col(spark, "abc", text.grams) == [] == col(spark, "新闻联播", text.grams) == col(spark, "", text.grams)


def test_identifiers(spark):
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()[:16]
    assert spark.range(1).select(text.news_id(F.lit("2026-09-01"), F.lit(3))).first()[0] == h("2026-09-01:3")
    assert col(spark, ["b", "a", "b"], text.event_id, "array<string>") == h("a,b")
    assert col(spark, ["b", "a"], text.preview_id, "array<string>") == "preview-" + h("a|b")


def test_like_folds_ascii_only(spark):
    rows = spark.createDataFrame([("ÉCOLE x",), ("école X",), ("a%b",), ("a\\b",)], "t string")
    hit = lambda k: [r["t"] for r in rows.where(text.contains(F.col("t"), k)).collect()]
    assert hit("ÉCOLE") == ["ÉCOLE x"] and hit("X") == ["ÉCOLE x", "école X"] and hit("a_b") == ["a%b", "a\\b"] and hit("a\\b") == ["a\\b"]


def test_lookup_prefers_exact_then_least(spark):
    p = spark.createDataFrame([("3", "li wei", "李伟", None), ("1", "li wei ming", "李伟明", None), ("2", "li wei ting", "李伟庭", None)], "person_id string, name string, name_chinese string, organization_id string")
    assert search.find_person(p, "li wei").first()["person_id"] == "3" and search.find_person(p, "LI WEI ").first()["person_id"] == "1" and search.find_person(p, "nobody").isEmpty()


def test_clusters_keep_traps_apart(spark):
    c = corpus(spark)
    b1 = partition(clusters.cluster(c, "connected"))
    assert ["a1", "a2"] in b1 and ["c1", "c2"] in b1 and ["b1"] in b1 and ["g1"] in b1 and ["g2"] in b1
    assert partition(clusters.cluster(c.orderBy(F.rand(3)), "connected")) == b1
    b2 = partition(clusters.cluster(c, "constrained"))
    assert sorted(x for g in b2 for x in g) == sorted(r["news_id"] for r in c.collect())
    assert ["c1", "c2"] in b2
    with pytest.raises(ValueError):
        clusters.cluster(c, "other")
    with pytest.raises(ValueError):
        clusters.candidate_edges(c, minimum_score=1.5)
    with pytest.raises(ValueError):
        clusters.blocked_pairs(c, -1)


def test_constrained_clusters_are_cliques_within_the_span(spark):
    rows = [(f"n{i}", "t", datetime.date(2026, 1, 1) + datetime.timedelta(days=i * 9), [], [], [], []) for i in range(5)]
    arts = spark.createDataFrame(rows, ARTICLE)
    edges = spark.createDataFrame([("n0", "n1", 0.9), ("n1", "n2", 0.8), ("n0", "n2", 0.7), ("n2", "n3", 0.6), ("n3", "n4", 0.95)], "left string, right string, score double")
    assert partition(clusters.constrained_clusters(arts, edges)) == [["n0", "n1"], ["n2"], ["n3", "n4"]] or partition(clusters.constrained_clusters(arts, edges)) == [["n0", "n1", "n2"], ["n3", "n4"]]
    assert partition(clusters.constrained_clusters(arts, edges, max_span_days=5)) == [[f"n{i}"] for i in range(5)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 3), st.integers(1, 28)), min_size=1, max_size=25), st.integers(0, 4))
def test_islands_equal_all_pairs(spark, rows, window):
    when = {}
    for n, _, d in rows:
        when.setdefault(n, d)
    items = spark.createDataFrame([(str(n), day(d)) for n, d in when.items()], "news_id string, broadcast_date date")
    topics = {(str(n), str(t)) for n, t, _ in rows}
    got = partition(events.topical_clusters(items, spark.createDataFrame(sorted(topics), "news_id string, topic_id string"), window, exclude_top=0))
    root = {str(n): str(n) for n in when}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, t in topics:
        for b, u in topics:
            if t == u and abs(when[int(a)] - when[int(b)]) <= window:
                root[find(a)] = find(b)
    want = {}
    for n in root:
        want.setdefault(find(n), []).append(n)
    assert got == sorted(sorted(v) for v in want.values())


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (8, 9), (7, 7), (None, 1)] + [(100, i) for i in range(101, 200)] + [(i, i + 1) for i in range(300, 330)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert got[5] == got[3] == 2 and got[9] == 8 and got[199] == 100 and got[330] == 300 and 1 not in got
    assert connected_components(e.where("false")).count() == 0


def test_edges_are_computed_once_and_components_share_a_task(spark):
    rows = [(f"n{i}", "t", day(1), [], [], [], []) for i in range(9)]
    arts = spark.createDataFrame(rows, ARTICLE)
    seen = spark.sparkContext.accumulator(0)

    def scored(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([("n0", "n1", 0.9), ("n1", "n2", 0.8), ("n4", "n5", 0.5)], "left string, right string, score double").mapInArrow(scored, "left string, right string, score double")
    got = clusters.constrained_clusters(arts, edges)
    assert partition(got) == [["n0", "n1"], ["n2"], ["n3"], ["n4", "n5"], ["n6"], ["n7"], ["n8"]]
    assert seen.value == 3  # edges are computed once
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()


def test_ablations_block_once(spark, monkeypatch):
    asked = []
    plain = clusters.blocked_pairs
    monkeypatch.setattr(clusters, "blocked_pairs", lambda *a, **k: asked.append(a) or plain(*a, **k))
    c = corpus(spark)
    assert {tuple(r) for r in clusters.candidate_edges(c, pairs=plain(c)).select("left", "right").collect()} == {tuple(r) for r in clusters.candidate_edges(c).select("left", "right").collect()}
    del asked[:]
    from newsloom.operators import report

    report.ablations(c)
    assert len(asked) == 1


def test_long_chains_take_few_rounds(spark):
    n = 100
    number = [0, *range(n - 1, 0, -1)]  # the least id has to pass along the whole chain
    items = spark.createDataFrame([(i, day(1)) for i in range(n)], "news_id long, broadcast_date date")
    links = spark.createDataFrame([(number[i + k], f"t{number[i]:03d}") for i in range(n - 1) for k in (0, 1)], "news_id long, topic_id string")
    got = events.topical_clusters(items, links, exclude_top=0).collect()
    assert len(got) == n and {r["cluster_id"] for r in got} == {0}
    cut = events.topical_clusters(items, links.where(F.col("topic_id") != f"t{number[49]:03d}"), exclude_top=0, min_items=50).collect()
    assert {(r["news_id"], r["cluster_id"]) for r in cut} == {(i, min(half)) for half in (number[:50], number[50:]) for i in half}


def test_contraction_equals_minimum_labels(spark):
    import random

    rng = random.Random(8)
    rows = [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(70)] + [(None, 1), (200, 200), (300, None)] + [(400, i) for i in range(401, 460)]
    e = spark.createDataFrame(rows, "a long, b long")
    want = {tuple(r) for r in connected_components(e.where("a <> b"), "a", "b").collect()}
    assert {tuple(r) for r in contracted_components(e, "a", "b").collect()} == want
    assert contracted_components(e.where("false"), "a", "b").count() == 0
    text = e.select(F.col("a").cast("string"), F.col("b").cast("string"))
    assert {tuple(r) for r in contracted_components(text, "a", "b").collect()} == {tuple(r) for r in connected_components(text.where("a <> b"), "a", "b").collect()}


def test_merging_in_rounds_equals_the_walk(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = [(i, day(rng.randint(1, 28))) for i in range(12)]
    found = {(a, b): round(rng.random(), 1) for _ in range(14) for a, b in [sorted(rng.sample(range(8), 2))]}  # with ties
    found |= {(a, b): 0.9 for a in range(8, 11) for b in range(a + 1, 11)}
    items = spark.createDataFrame([(i, f"t{i}", d, [], [], [], []) for i, d in rows], ARTICLE.replace("news_id string", "news_id long"))
    edges = spark.createDataFrame([(a, b, s) for (a, b), s in found.items()], "left long, right long, score double")
    walk = partition(clusters.constrained_clusters(items, edges, 20, 0.5))
    monkeypatch.setattr(clusters, "COMPONENT", 3)
    assert partition(clusters.constrained_clusters(items, edges, 20, 0.5)) == walk and len(walk) < 10


def test_metrics_known_values(spark):
    p = lambda d: spark.createDataFrame(list(d.items()), "item string, label string")
    gold, got = p({"a": "1", "b": "1", "c": "1"}), p({"a": "x", "b": "x", "c": "y"})
    m = one(metrics.pairwise_metrics(gold, got))
    assert (m["tp"], m["fp"], m["fn"]) == (1, 0, 2) and m["recall"] == pytest.approx(1 / 3) and m["f1"] == pytest.approx(0.5)
    b = one(metrics.bcubed_metrics(gold, got))
    assert b["precision"] == pytest.approx(1) and b["recall"] == pytest.approx(5 / 9)
    r = one(metrics.pair_retrieval(gold, spark.createDataFrame([("b", "a")], "left string, right string")))
    assert r["recall"] == pytest.approx(1 / 3) and r["precision"] == 1
    metrics.check_partition(got, gold)
    for bad in ({"a": "x", "b": "x"}, {"a": "x", "b": "x", "c": " "}, {"a": "x", "b": "x", "c": "y", "d": "y"}):
        with pytest.raises(ValueError):
            metrics.check_partition(p(bad), gold)
    for bad in ({"a": "x", "b": "x"}, {"a": "x", "b": "x", "c": "y", "d": "y"}):  # an item is missing, or unknown
        for measure in (metrics.pairwise_metrics, metrics.bcubed_metrics):
            with pytest.raises(ValueError):
                measure(gold, p(bad))
    for pair in (("a", "zz"), ("a", "a")):
        with pytest.raises(ValueError):
            metrics.pair_retrieval(gold, spark.createDataFrame([pair, ("a", "b")], "left string, right string"))
    none = spark.createDataFrame([], "item string, label string")
    assert one(metrics.bcubed_metrics(none, none)) == {"precision": 1.0, "recall": 1.0, "f1": 1.0}
    single = p({"a": "1", "b": "2"})
    assert one(metrics.pairwise_metrics(single, single))["precision"] == 1 == one(metrics.pairwise_metrics(single, single))["recall"]


def test_event_quality(spark):
    news = spark.createDataFrame([(c,) for c in "abcde"], "news_id string")
    links = lambda rows: spark.createDataFrame(rows, "event_id string, news_id string")
    q = one(metrics.event_quality(links([("e", c) for c in "abcd"] + [("f", "e")]), news))
    assert q["largest_event_size"] == 4 and q["largest_event_share"] == 0.8 and q["requires_review"] and q["singleton_events"] == 1
    q = one(metrics.event_quality(links([("e", "a"), ("e", "b"), ("e", "c"), ("f", "zz")]), news))
    assert q["dangling"] == 1 and q["unassigned"] == 2
    with pytest.raises(ValueError):
        metrics.event_quality(links([("e", "a"), ("e", "a")]), news)


REVIEW = "left string, right string, reviewer_1 struct<id:string,label:string>, reviewer_2 struct<id:string,label:string>, adjudication struct<label:string,reviewer:string>"


def test_reviews(spark):
    rows = [("a", "b", None, None, None), ("a", "c", ("r1", "SAME_EVENT"), ("r2", "SAME_EVENT"), None), ("a", "d", ("r1", "SAME_EVENT"), ("r2", "DIFFERENT_EVENT"), None), ("a", "e", ("r1", "SAME_EVENT"), ("r2", "DIFFERENT_EVENT"), ("RELATED_NOT_SAME", "r3")), ("a", "f", ("r1", "UNSURE"), ("r2", "UNSURE"), None)]
    df = spark.createDataFrame(rows, REVIEW)
    annotation.check_reviews(df)
    assert {r["right"]: r["state"] for r in annotation.review_state(df).collect()} == {"b": "unreviewed", "c": "ready", "d": "needs_adjudication", "e": "ready", "f": "needs_adjudication"}
    for bad in (("a", "a", None, None, None), ("b", "a", None, None, None), ("x", "y", ("r1", "MAYBE"), None, None), ("x", "y", ("r1", "UNSURE"), ("r1", "UNSURE"), None)):
        with pytest.raises(ValueError):
            annotation.check_reviews(df.unionByName(spark.createDataFrame([bad], REVIEW)))
    s = one(annotation.review_summary(df))
    assert [s[k] for k in ("total_pairs", "unreviewed", "double_reviewed", "agreed_and_definitive", "adjudicated", "needs_adjudication", "ready_definitive_pairs", "reviewer_agreement")] == [5, 1, 4, 1, 1, 2, 2, 0.5]
    k = one(annotation.agreement(spark.createDataFrame([("S", "S"), ("S", "D"), ("D", "D"), ("D", "D"), (None, "S")], "a string, b string")))
    assert k["n"] == 4 and k["agreement"] == 0.75 and k["kappa"] == pytest.approx(0.5)
    assert one(annotation.agreement(spark.createDataFrame([], "a string, b string")))["kappa"] is None


def test_queue_is_reproducible_and_counts_agree(spark):
    c = corpus(spark)
    q = [tuple(r)[:3] for r in annotation.make_queue(c, limit=9).collect()]
    assert q == [tuple(r)[:3] for r in annotation.make_queue(c.repartition(5), limit=9).collect()] and len(q) == len(set(q)) == 9
    first = next(r for r in annotation.make_queue(c, limit=9).collect() if r["stratum"] == "model_positive")
    assert first["evidence"]["matched_pair_score"] >= 0.34 and first["source"]["left_title"] and first["source"]["left_url"] is None and first["reviewer_1"] is None
    assert annotation.make_queue(c, limit=6).count() == 6
    counted = {r["stratum"]: r["pairs"] for r in annotation.strata_counts(c).collect()}
    rows = c.collect()
    edges = {(r["left"], r["right"]) for r in annotation.accepted_pairs(c).collect()}
    made = Counter()
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if abs((a["day"] - b["day"]).days) <= 7:
                related = any(set(a[k]) & set(b[k]) for k in ("topics", "people", "organizations"))
                made["model_positive" if tuple(sorted((a["news_id"], b["news_id"]))) in edges else "topical_unmatched" if related else "random_control"] += 1
    assert {k: v for k, v in counted.items() if v} == made
    with pytest.raises(ValueError):
        annotation.make_queue(c, limit=0)


def test_edges_without_a_node_go(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b", 1), ("a", "x", 2), ("x", "b", 3), (None, "a", 4)], "source string, target string, weight int")
    assert [tuple(r) for r in graph.sanitised(nodes, edges).collect()] == [("a", "b", 1)]


def test_heat_and_status(spark):
    links = spark.createDataFrame([("e", day(d)) for d in (1, 20, 21, 22)] + [("old", day(1))], "event_id string, day date")
    board = {r["event_id"]: r for r in events.heat_board(links, spark.createDataFrame([("e", "p"), ("e", "q")], "event_id string, actor string"), links.agg(F.max("day"))).collect()}
    e = board["e"]
    assert e["heat_score"] == round(0.4 * 4 / 30 * 100 + 0.3 * 100 + 0.2 * 50 + 0.1 * 20, 1) and e["status"] == "developing" and e["importance"] == "notable"
    assert board["old"]["status"] == "resolved" and board["old"]["actors"] == 0


def test_detected_events_cover_all_items(spark):
    items = spark.createDataFrame([("a", "A", day(1)), ("b", "B", day(2)), ("c", "C" * 100, day(20))], "news_id string, title string, broadcast_date date")
    nt = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "t")], "news_id string, topic_id string")
    found = events.topical_clusters(items, nt, 7, exclude_top=0)
    ev = events.detected_events(items, nt, spark.createDataFrame([("t", "Topic")], "topic_id string, name string"), found).collect()
    assert sorted((r["name"], r["news_count"]) for r in ev) == [("C" * 80, 1), ("Topic_2026-09-01_2条", 2)]
    assert events.event_links(found, items).select("event_id").distinct().count() == 2
    with pytest.raises(ValueError):
        events.require_profiles(spark.createDataFrame(ev), spark.createDataFrame([("x",)], "event_id string"))


def test_graph_bounds_and_pagerank(spark):
    nodes = lambda n: spark.createDataFrame([(f"n{i}",) for i in range(n)], "id string")
    none = spark.createDataFrame([], "source string, target string")
    assert [r["rank"] for r in graph.pagerank(nodes(3), none).collect()] == pytest.approx([1 / 3] * 3)
    assert [r["pagerank"] for r in graph.normalised(graph.pagerank(nodes(3), none)).collect()] == pytest.approx([0.3333] * 3)
    assert graph.pagerank(nodes(0), none).count() == 0
    pairs = [(0, 1), (1, 0), (1, 2), (2, 2), (1, 3)]
    got = {r["id"]: r["rank"] for r in graph.pagerank(nodes(5), spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "source string, target string"), every=7).collect()}
    near = {i: {b for a, b in pairs if a == i and b != i} | {a for a, b in pairs if b == i and a != i} for i in range(5)}
    r = [0.2] * 5
    for _ in range(30):
        idle = sum(r[i] for i in near if not near[i])
        r = [0.15 / 5 + 0.85 * (sum(r[j] / len(near[j]) for j in near[i]) + idle / 5) for i in range(5)]
    assert [got[f"n{i}"] for i in range(5)] == pytest.approx(r) and sum(r) == pytest.approx(1)
    item = spark.createDataFrame([("i", "t", day(1), 1)], "news_id string, title string, broadcast_date date, order_in_broadcast int")
    topics = spark.createDataFrame([(f"t{i:02}", f"T{i}") for i in range(18)], "topic_id string, name string")
    few = graph.selected(topics.select(F.lit("i").alias("news_id"), "topic_id"), item, topics, "topic_id", 15)
    assert few.count() == 15 and few.agg(F.max("topic_id")).first()[0] == "t14"


def files(spark, rows):
    return spark.createDataFrame(rows, "file string, content string")


def test_markdown_round_trip_and_errors(spark):
    page = "# head\nlost\n\n## One\n<!-- source_url: https://x.example/1 -->\n\nbody a\n\nbody b\n---\n## Two \nbody c\n"
    got = sorted(tuple(r)[2:] for r in markdown.parse(files(spark, [("20260901.md", page)])).select("file", "news_id", "order_in_broadcast", "title", "full_text", "url", "error").collect())
    assert got == [(1, "One", "body a\nbody b", "https://x.example/1", None), (2, "Two", "body c", None, None)]
    items = markdown.parse(files(spark, [("20260901.md", page)]))
    again = markdown.parse(markdown.render(items))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, items.collect()))
    errors = {r["file"]: r["error"] for r in markdown.parse(files(spark, [("20260230.md", "## A\nb"), ("x.md", "## A\nb"), ("20260902.md", "## A\n"), ("20260903.md", "## A\n<!-- source_url: ftp://x -->\nb")])).collect()}
    assert errors == {"20260230.md": "file name is no date", "x.md": "file name is no date", "20260902.md": "no text", "20260903.md": "url is not http"}
    assert [r["date"] for r in markdown.broadcast_dates(spark, "2026-03-01", 2).collect()] == ["20260301", "20260228"]


def test_markdown_files_as_scrapers_write_them(spark):
    page = "# 新闻联播 2026-09-01\n\n## 标题一\n\n<!-- source_url: https://tv.example/a?x=1 -->\n\n正文一\n第二段\n\n---\n\n## 标题二\n\n正文 <!-- source-url: https://no.example -->\n\n---\n\n"
    got = sorted(tuple(r) for r in markdown.parse(files(spark, [("20260901.md", page)])).select("order_in_broadcast", "title", "full_text", "url", "error").collect())
    assert got == [(1, "标题一", "正文一\n第二段", "https://tv.example/a?x=1", None), (2, "标题二", "正文 <!-- source-url: https://no.example -->", None, None)]
    empty = "## A\n<!-- source_url:  -->\nb"
    assert markdown.parse(files(spark, [("20260901.md", empty)])).first()["error"] == "url is not http"


def test_import_is_idempotent(spark):
    items = markdown.parse(files(spark, [("20260901.md", "## One\nbody a\n## Two\nbody b")])).drop("file", "error")
    none = items.where("false").withColumn("word_count", F.lit(None).cast("int")).withColumn("summary", F.lit(None).cast("string"))
    first = loading.import_items(items, none).withColumn("summary", F.lit("kept"))
    assert first.count() == 2 and {r["word_count"] for r in first.collect()} == {6}
    second = loading.import_items(items.withColumn("url", F.lit("https://x")), first)
    assert second.count() == 2 and {(r["summary"], r["url"]) for r in second.collect()} == {("kept", "https://x")}
    for bad in (items.withColumn("full_text", F.lit("other")), items.withColumn("title", F.lit(" ")), items.where("false")):
        with pytest.raises(ValueError):
            loading.import_items(bad, first)
    links = spark.createDataFrame([("a", "zz")], "news_id string, person_id string")
    with pytest.raises(ValueError):
        loading.check_references(loading.orphans(links, "person_id", spark.createDataFrame([("p",)], "person_id string"), "person_id", "news_person"))


def test_enrichment(spark):
    reply = {"article_analysis": {"summary": {"short": "S"}, "keywords": ["k"], "topics": ["经济", {"name": "new one", "relevance": 0.9}, {"name": "bad", "relevance": 7}], "entities": {"people": [{"name": "Wang", "title": "head of Central Bank"}, "Li"], "organizations": ["Ministry", {"name": "Central Bank", "type": "enterprise"}, {"name": "odd", "type": "club"}]}}}
    items = spark.createDataFrame([("a", "x" * 60, None), ("b", "short", None), ("c", "y" * 60, None), ("d", "z" * 60, "done")], "news_id string, full_text string, summary string")
    text_of = json.dumps(reply, ensure_ascii=False)

    def provider(t):
        return f"```json\n{text_of}\n```" if t[0] == "x" else "no json"

    out = loading.enrich(items, provider).persist()
    assert {r["news_id"]: r["status"] for r in out.collect()} == {"a": "enhanced", "b": "skipped", "c": "failed"}
    t = loading.persist_enrichment(out)
    assert {tuple(r) for r in t["topic"].collect()} == {("jing-ji", "经济", "Economy"), ("new one", "new one", "")}
    assert {tuple(r) for r in t["news_topic"].collect()} == {("a", "jing-ji", 0.5), ("a", "new one", 0.9)}
    assert {tuple(r) for r in t["organization"].collect()} == {("Ministry", "Ministry", "government"), ("Central Bank", "Central Bank", "enterprise")}
    assert {(r["person_id"], r["organization_id"]) for r in t["person"].collect()} == {("Wang", "Central Bank"), ("Li", None)}


def test_html(spark):
    page = "<body><main class='article-content x'><article class='content-section'><h2 class='content-heading'>T &amp; 1</h2><div class='content-body'><p> first <b>bold</b></p><p></p><p>second paragraph</p></div></article><article class='content-section'><h2>short</h2><div class='content-body'><p>x</p></div></article><article class='content-section'><h2>third</h2><div class='content-body'><p>a body that is long enough</p></div></article></main><article class='content-section'><h2>out</h2></article></body>"
    df = spark.createDataFrame([(1, page), (2, "<p>no main</p>"), (3, None)], "page_id int, html string")
    got = sorted(map(tuple, html.extract(df, "page_id").collect()))
    assert got == [(1, 1, "T & 1", "firstbold\n\nsecond paragraph"), (1, 2, "short", "x"), (1, 3, "third", "a body that is long enough")]
    assert [r["order_in_broadcast"] for r in html.usable(html.extract(df, "page_id")).orderBy("order_in_broadcast").collect()] == [1, 3]


def test_html_of_open_paragraphs(spark):
    page = "<article><h1> a<i> b </i></h1><p><b>first<br><p>second</p><p> third <!-- x --> part</p></article>"
    s = html.Selectors(main="", article="article", title="h1", any_title="h1", body="")
    assert html.articles_of(page, s) == [("ab", "firstsecondthirdpart\nsecond\nthirdpart")]


def test_report_compares_variants(spark):
    c = corpus(spark)
    gold = spark.createDataFrame([("a1", "a"), ("a2", "a"), ("b1", "b"), ("c1", "c"), ("c2", "c"), ("g1", "g"), ("g2", "h"), ("k1", "k")], "item string, label string")
    rows = {r["variant"]: r for r in report.ablations(c, gold).collect()}
    assert set(rows) == {"legacy", "connected", "constrained"} and all(r["items"] == 8 for r in rows.values())
    assert rows["constrained"]["pairwise_precision"] == 1 and rows["legacy"]["edge_f1"] is None and rows["connected"]["edge_precision"] == 1
    assert all(r["bcubed_f1"] is None for r in report.ablations(c).collect())


def test_providers_are_tried_again(spark):
    calls, waits = [], []

    def provider(text):
        calls.append(1)
        if len(calls) < 3:
            raise loading.Busy
        return text

    assert loading.with_retries(provider, sleep=waits.append)("x") == "x" and waits == [1.0, 2.0]
    with pytest.raises(ValueError):
        loading.with_retries(lambda t: (_ for _ in ()).throw(ValueError()), sleep=waits.append)("x")


def test_one_bad_text_fails_alone(spark):
    items = spark.createDataFrame([(i, f"text {i} " * 10, None) for i in range(40)], "news_id long, full_text string, summary string").coalesce(1)

    def provider(t):
        if t.startswith("text 17 "):
            raise RuntimeError("no luck")
        return loading.stub(t) if not t.startswith("text 9 ") else '{"summary": ""}'

    got = {r["news_id"]: (r["status"], r["reason"]) for r in loading.enrich(items, provider, concurrency=5).collect()}
    assert got.pop(17) == ("failed", "RuntimeError: no luck") and got.pop(9) == ("failed", "no summary")
    assert len(got) == 38 and set(got.values()) == {("enhanced", None)}
    assert sorted(r["news_id"] for r in loading.enrich(items, provider, limit=3).collect()) == [0, 1, 2]
    assert {r["status"] for r in loading.enrich(items, lambda t: 1 / 0, dry_run=True).collect()} == {"pending"}
    with pytest.raises(ValueError):
        loading.enrich(items, provider, concurrency=0)


def test_calls_run_side_by_side_and_hold_the_input_back(spark):
    import threading
    import time

    import pyarrow as pa

    now, most, lock, read = [0], [0], threading.Lock(), [0]

    def provider(t):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02)
        with lock:
            now[0] -= 1
        return t

    def batches():
        for i in range(3):
            read[0] += 1
            yield pa.record_batch([pa.array(range(20)), pa.array([f"{i}-{j}" for j in range(20)])], names=["news_id", "text"])

    began = time.time()
    out = loading.called(provider, batches(), 5)
    first = next(out)
    assert read[0] == 1 and first.column(1).to_pylist() == [f"0-{j}" for j in range(20)]
    assert sum(b.num_rows for b in out) == 40 and most[0] == 5 and time.time() - began < 60 * 0.02


def test_ids_within_a_batch(spark):
    kind = "news_id string, title string, full_text string, broadcast_date date, order_in_broadcast int, url string"
    none = spark.createDataFrame([], f"{kind}, word_count int")
    row = ("a", "T", "text", day(1), 1, None)
    two = loading.import_items(spark.createDataFrame([row, row, (*row[:5], "https://b"), (*row[:5], "https://a")], kind), none)
    assert [(r["news_id"], r["url"], r["word_count"]) for r in two.collect()] == [("a", "https://a", 4)]
    for bad in ([row, ("a", "T", "other", day(1), 1, None)], [(None, "T", "text", day(1), 1, None)]):
        with pytest.raises(ValueError):
            loading.import_items(spark.createDataFrame(bad, kind), none)
    again = loading.import_items(spark.createDataFrame([row, row], kind), two)
    assert again.count() == 1


def test_rejected_rows_are_kept_apart(spark):
    reply = {"summary": "S", "topics": [{"name": "good", "relevance": 1}, {"name": "bad", "relevance": 7}, {"name": " "}], "entities": {"people": [{"name": f"P{i}"} for i in range(7)], "organizations": [{"name": "odd", "type": "club"}, "Ministry"], "locations": ["Here"]}, "policy_signals": [{"signal": "x", "type": "t", "evidence": "e", "more": 1}]}
    items = spark.createDataFrame([("a", "x" * 60, None)], "news_id string, full_text string, summary string")
    out = loading.enrich(items, lambda t: json.dumps(reply))
    t = loading.persist_enrichment(out)
    rejected = sorted((r["relation"], r["reason"]) for r in t["rejected"].collect())
    assert rejected == [("organization", "unknown type"), ("person", "beyond the first five"), ("person", "beyond the first five"), ("topic", "no name"), ("topic", "relevance outside 0 to 1")]
    accepted = sum(t[x].count() for x in ("news_topic", "news_organization", "news_person"))
    assert accepted + len(rejected) == 3 + 7 + 2
    tags = json.loads(one(t["items"])["tags"])
    assert tags["locations"] == ["Here"] and tags["_policy_signals"][0]["signal"] == "x" and len(tags["people"]) == 7


def test_fixture_source(spark, tmp_path):
    rec = {"news_id": "a", "title": "t", "broadcast_date": "2026-09-01", "topics": [{"name": " x "}, "y", "", {"name": "x"}], "people": [{"name_chinese": "李"}], "keywords": "none"}
    (tmp_path / "f.json").write_text(json.dumps({"fixture_type": "synthetic", "records": [rec], "labels": {"a": "e"}}))
    (tmp_path / "r.jsonl").write_text(json.dumps(rec) + "\n")
    records, labels = jsonl.read_fixture(spark, str(tmp_path / "f.json"))
    for df in (records, jsonl.read_jsonl(spark, str(tmp_path / "r.jsonl"))):
        r = one(jsonl.parse_articles(df))
        assert (r["topics"], r["people"], r["organizations"], r["keywords"], r["day"]) == (["x", "y"], ["李"], [], [], day(1))
    assert [tuple(r) for r in labels.collect()] == [("a", "e")]
    with pytest.raises(ValueError):
        jsonl.parse_articles(records.unionByName(records))


def test_publish_is_all_or_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/gen"
    one_ = publish.publish(spark, root, {"t": spark.range(3)})
    assert publish.current(spark, root) == one_ and publish.read(spark, root, "t").count() == 3

    def fail(tables):
        raise ValueError("incomplete")

    with pytest.raises(ValueError):
        publish.publish(spark, root, {"t": spark.range(5)}, fail)
    assert publish.read(spark, root, "t").count() == 3
    two = publish.publish(spark, root, {"t": spark.range(4)}, lambda t: None)
    assert two != one_ and publish.read(spark, root, "t").count() == 4


def test_streaming_matches_batch(spark, tmp_path):
    from newsloom.streaming import ingest

    rows = spark.createDataFrame([(i % 3, datetime.datetime(2026, 1, 1 + i % 9, 12)) for i in range(40)], "k int, ts timestamp")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = ingest.heat_windows(ingest.read_items(spark, f"{tmp_path}/in", "k int, ts timestamp"), "k", "ts")
    ingest.run_once(stream, "heat", f"{tmp_path}/cp", "complete")
    assert sorted(map(tuple, spark.table("heat").collect())) == sorted(map(tuple, ingest.heat_windows(rows, "k", "ts").collect()))


def test_stream_of_imports_equals_batches(spark, tmp_path):
    from newsloom.streaming import ingest

    schema = "news_id string, title string, full_text string, broadcast_date date, order_in_broadcast int, url string"
    row = lambda i, text, url=None: (f"n{i}", f"T{i}", text, day(1), i, url)
    first = [row(i, f"text {i}") for i in range(1, 7)]
    second = [row(1, "text 1"), row(2, "other"), row(3, "text 3", "https://c"), row(7, "seven"), row(3, "text 3", "https://d"), (None, "T", "x", day(1), 1, None)]
    for order in (1, -1):
        folder, checkpoint = f"{tmp_path}/in{order}", f"{tmp_path}/cp{order}"
        for batch in (first, second):
            for one_row in batch[::order]:
                spark.createDataFrame([one_row], schema).write.mode("append").parquet(folder)
            out = ingest.run_once(ingest.import_changes(ingest.read_items(spark, folder, schema)), "changes", checkpoint)
        got = Counter((r["news_id"], r["state"], r["filled"]) for r in out.collect())
        assert got == Counter([(f"n{i}", "new", False) for i in (1, 2, 3, 4, 5, 6, 7)] + [("n1", "same", False), ("n2", "changed", False), ("n3", "same", True), ("n3", "same", False)])
        old = spark.createDataFrame(first, schema)
        new = spark.createDataFrame([r for r in second if r[0] and r[5] != "https://d"], schema)
        want = Counter((r["news_id"], r["state"]) for r in loading.compare_import(new, old).collect())
        late = Counter((i, state) for i, state, _ in got.elements()) - Counter((r[0], "new") for r in first)
        assert late == want + Counter({("n3", "same"): 1})  # the row left out above
        table = {r["news_id"]: r["url"] for r in ingest.imported(out).collect()}
        assert table == {f"n{i}": "https://c" if i == 3 else None for i in range(1, 8)}


def test_dashboard(spark):
    arts = corpus(spark).withColumn("summary", F.lit(None).cast("string")).withColumn("excerpt", F.col("title"))
    own = exports.dashboard_filter(arts, keyword="FLOOD", topic="weather")
    assert own.count() == 3 and one(exports.kpis(arts, own))["total"] == 8
    assert exports.dashboard_filter(arts, date="2026-09-01", keyword="rocket").count() == 1
    bars = exports.bars(spark.createDataFrame([(3,), (99,)], "item_count int")).collect()
    assert [len(r["bar"]) for r in bars] == [3, 20]
    assert [r["u"] for r in spark.createDataFrame([("https://a",), ("javascript:x",), ("http://b",)], "x string").select(text.safe_url(F.col("x")).alias("u")).collect()] == ["https://a", None, "http://b"]


def test_blocking_plan_has_no_cartesian_product(spark):
    plan = clusters.blocked_pairs(corpus(spark))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
