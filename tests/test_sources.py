"""Dated pages, files of given names, romanised ids, exact rounding, reports of events."""

import datetime
import http.server
import random
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from newsloom import catalogue
from newsloom.functions import text
from newsloom.operators import search
from newsloom.sources import files, html, markdown, pages

PAGE = "<main class='article-content'><article class='content-section'><h2 class='content-heading'>T{0}</h2><div class='content-body'><p>a body that is long enough {0}</p></div></article></main>"


def test_pages_by_date(spark, tmp_path):
    (tmp_path / "20260902.html").write_text(PAGE.format(2))
    (tmp_path / "20260901.html").write_text("<p>an empty day</p>")
    (tmp_path / "20260831.html").write_bytes(b"\xff\xfe broken \xff")
    path = f"file://{tmp_path}/{{date}}.html"
    kept = pages.read_pages(spark, path, "2026-09-03", 4, errors="keep")
    assert kept.rdd.getNumPartitions() == 4  # a task for each date
    got = {r["date"]: r for r in kept.collect()}
    assert set(got) == {"20260903", "20260902", "20260901", "20260831"}
    assert got["20260903"]["error"].startswith("FileNotFoundError") and got["20260831"]["error"].startswith("UnicodeDecodeError")
    assert got["20260902"]["error"] is None and got["20260901"]["html"] == "<p>an empty day</p>"
    items = html.usable(html.extract(kept.where("error is null"), "date")).collect()
    assert [(r["date"], r["title"]) for r in items] == [("20260902", "T2")]
    with pytest.raises(Exception, match="page of 2026"):
        pages.read_pages(spark, path, "2026-09-03", 4).collect()
    assert pages.read_pages(spark, path, "2026-09-02", 2).count() == 2
    with pytest.raises(Exception, match="path needs"):
        pages.read_pages(spark, f"file://{tmp_path}/page.html", "2026-09-02").count()


def test_many_dates_share_tasks(spark, tmp_path):
    for name in ("20301231", "09990101", "00001225", "-10622"):
        (tmp_path / f"{name}.html").write_text(name)
    many = pages.read_pages(spark, f"file://{tmp_path}/{{date}}.html", "2030-12-31", 742_001, errors="keep")
    assert 742 <= many.rdd.getNumPartitions() <= pages.TASKS
    reader = pages.PagesReader({"path": "{date}", "end": "2030-12-31", "days": "742001"})
    runs = [p.value for p in reader.partitions()]
    assert runs[0][0] == 0 and runs[-1][1] == 742_001 and all(a[1] == b[0] for a, b in zip(runs, runs[1:], strict=False))
    days = (0, 376_890, 741_448, 742_000)
    rows = [(n, f"page {n}") for n in days]
    spark.createDataFrame(rows[:1] + [(5, "five")], "page_id long, html string").write.parquet(f"{tmp_path}/near/pages.parquet")
    assert sorted(r["date"] for r in catalogue.dated_pages(spark, f"{tmp_path}/near").collect()) == ["20301226", "20301231"]
    con = duckdb.connect()
    want = [con.sql(f"select strftime(date '2030-12-31' - {n}, '%Y%m%d')").fetchall()[0][0] for n in days]
    assert [pages.compact(reader.end - n) for n in days] == want


def test_pages_over_http_are_tried_again(spark):
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            fine = self.path == "/20260902/" or (self.path == "/20260901/" and asked.count(self.path) > 1)
            self.send_response(200 if fine else 503)
            self.end_headers()
            self.wfile.write("seite é".encode() if fine else b"busy")

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    got = {r["date"]: r for r in pages.read_pages(spark, f"http://127.0.0.1:{server.server_port}/{{date}}/", "2026-09-02", 3, errors="keep", tries=2).collect()}
    server.shutdown()
    assert got["20260902"]["html"] == got["20260901"]["html"] == "seite é" and "503" in got["20260831"]["error"]
    assert asked.count("/20260831/") == 2


def test_references_without_a_semicolon(spark, tmp_path):
    page = "<article><h1>a{0}</h1><p>R&amp;D, x &lt; y, &#233;, &notit; and {0}; is long enough</article>"
    s = html.Selectors(main="", article="article", title="h1", any_title="h1", body="", closed=True)
    assert html.articles_of(page.format("&amp"), s) == [("a&amp", "R&D, x < y, é, &notit; and & is long enough")]
    assert html.articles_of("<article><h1>a&amp</h1><p>b&nope; c", html.Selectors(main="", article="article", title="h1", any_title="h1", body="")) == [("a&", "b&nope; c")]
    rows = [(i, f"<html><article><h1>Title &amp;{cut}</h1><p>a body that is &amp; long enough{cut}</p></article></html>") for i, cut in enumerate(("&amp", "&am", "&", "&amp;", "", "&copy", "&quot"))]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(map(tuple, catalogue.html_extract(spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(catalogue.SQL["html_extract"]).fetchall()) and len(got) == 7


def test_files_are_written_whole(spark, tmp_path):
    df = spark.createDataFrame([("20260901.md", "## A\nb\n"), ("20260902.md", "## C\né"), ("20260901.md", "## A\nb\n"), (None, "x"), ("20260903.md", None)], "file string, content string")
    for _ in range(2):
        assert files.write_files(df.repartition(3), f"file://{tmp_path}/out") == 3
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["20260901.md", "20260902.md", "20260903.md"]
    assert (tmp_path / "out/20260902.md").read_text() == "## C\né"
    assert sorted(r["title"] for r in markdown.parse(markdown.read_files(spark, f"file://{tmp_path}/out")).collect()) == ["A", "C"]
    assert files.write_files(df.where("false"), f"file://{tmp_path}/none") == 0


def test_topic_ids(spark):
    slug = lambda x, r=None: spark.createDataFrame([(x,)], "x string").select(text.slug(F.col("x"), r).alias("y")).first()["y"]
    for name, reading in text.TOPIC_READINGS.items():
        assert slug(name) == reading.replace(" ", "-")
    assert slug("中国经济") == "zhong-guo-jing-ji" and slug("经济 2.0") == "jing-ji- 2.0" and slug("new one") == "new one"
    assert slug("") == "" and slug(None) is None and slug("龘") == "龘"
    assert slug("ab", {"a": "one", "ab": "first second"}) == "first-second"
    assert slug("a.b.", {".": "dot"}) == "a-dot-b-dot"


def test_rounding_is_that_of_the_binary_value(spark):
    rng = random.Random(6)
    values = [0.25, 0.75, 0.15, 0.05, 2.675, 1.005, -0.25, -2.5, -0.15, 0.0, 1e15 + 0.5, 1e300, 12.5, 0.125, 0.375, *[rng.uniform(-100, 100) for _ in range(2000)], *[rng.randint(-4000, 4000) / 40 for _ in range(2000)], *[rng.randint(0, 10**6) / 1000 + 0.0005 for _ in range(500)]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 3):
        got = [r["r"] for r in df.select(text.round_even(F.col("v"), digits).alias("r")).collect()]
        assert got == [round(v, digits) for v in values]
    import duckdb
    import pandas as pd

    frame = pd.DataFrame({"x": values[:5] + values[15:2000]})  # noqa: F841
    got = duckdb.sql(f"select {text.round_even_sql('x', 2)} as r from frame").df()["r"].tolist()
    assert got == [round(v, 2) for v in frame["x"]]
    assert spark.sql("select double('NaN') as v").select(text.round_even(F.col("v"), 1).alias("r")).first()["r"] != 0


def test_reports_of_events(spark):
    d = lambda n: datetime.date(2026, 9, n)
    events = spark.createDataFrame([("e", "Flood", "social", "major", "peak", d(1), d(3)), ("none", "N", "t", "i", "s", d(1), d(1))], "event_id string, name string, type string, importance string, status string, first_date date, last_date date")
    items = spark.createDataFrame([("n2", "Two", "s" * 400, "text", d(3)), ("n1", "One", None, "text one", d(1)), ("n3", None, "", None, d(1))], "news_id string, title string, summary string, full_text string, broadcast_date date")
    links = spark.createDataFrame([("n1", "e"), ("n2", "e"), ("n3", "e"), ("n1", "ghost")], "news_id string, event_id string")
    people = spark.createDataFrame([("e", f"p{i:02d}", "mentioned") for i in range(12)] + [("e", "q", "primary_actor")], "event_id string, person_id string, role string")
    persons = spark.createDataFrame([(f"p{i:02d}", f"P{i}") for i in range(12)] + [("q", "Q")], "person_id string, name_chinese string")
    org_of, orgs = spark.createDataFrame([("e", "o", "mentioned")], "event_id string, org_id string, role string"), spark.createDataFrame([("o", "Office")], "org_id string, name string")
    report = lambda e: [tuple(r) for r in search.event_report(events, items, links, people, persons, org_of, orgs, e).collect()]
    got = report("e")
    assert [x[2] for x in got if x[0] == 1] == ["Event: Flood", "Type: social", "Importance: major", "Status: peak", "Dates: 2026-09-01 to 2026-09-03"]
    assert [x[2] for x in got if x[0] == 2] == [f"- P{i} (mentioned)" for i in range(10)]
    assert [x[2] for x in got if x[0] == 3] == ["- Office (mentioned)"]
    assert [x[1:] for x in got if x[0] == 4] == [(1, "[2026-09-01] One\n  text one"), (2, "[2026-09-01] \n  "), (3, "[2026-09-03] Two\n  " + "s" * 300)]
    assert report("none") == report("unknown") == [(0, 1, "No items linked to this event.")] and report("ghost") == [(0, 1, "Event not found.")]
