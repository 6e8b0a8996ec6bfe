"""Commits of a folder and of the event tables, overlaps without pairs, digests of any size."""

import datetime
import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from newsloom.operators import annotation, events, loading
from newsloom.operators.overlap import rare_pairs, top_overlaps
from newsloom.plans import builds, publish
from newsloom.plans.digest import member_digests
from newsloom.schema import TABLES


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, content in files.items():
        (folder / f"{name[1:]}.md").write_text(content)
    return f"file://{folder}"


def titles(spark, root):
    return sorted(r["title"] for r in publish.read(spark, root, "news_item").collect())


def test_import_of_a_folder(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    folder = write(tmp_path / "in", d20260901="# x\n\n## One\nbody one\n\n## Two\nbody two\n", d20260902="## Three\nbody three\n")
    assert builds.import_folder(spark, folder, root) == 3
    assert builds.import_folder(spark, folder, root) == 0
    write(tmp_path / "in", d20260901="## One\n<!-- source_url: https://a.example -->\nbody one\n\n## Two\nbody two\n", d20260903="## Four\nbody four")
    assert builds.import_folder(spark, folder, root) == 1
    got = {r["title"]: r for r in publish.read(spark, root, "news_item").collect()}
    assert got["One"]["url"] == "https://a.example" and got["Two"]["url"] is None and got["Four"]["word_count"] == 9
    for name, files in {
        "changed": {"d20260902": "## Three\nanother body"},
        "empty": {"d20260905": "# nothing here\n"},
        "undated": {"dnotes": "## A\nb"},
        "bad": {"d20260907": "## Good\nbody\n## Bad\n"},
    }.items():
        with pytest.raises(ValueError):
            builds.import_folder(spark, write(tmp_path / name, **files), root)
    with pytest.raises(FileNotFoundError):
        builds.import_folder(spark, f"file://{tmp_path}/nowhere", root)
    assert titles(spark, root) == ["Four", "One", "Three", "Two"]


def test_two_writers_leave_both_batches(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"
    one, two = write(tmp_path / "a", d20260901="## A\nbody a"), write(tmp_path / "b", d20260902="## B\nbody b")
    plain, seen = publish.publish, []

    def late(spark, root, tables, validate=None, after=None):
        if not seen:  # while the first writer is about to publish, another does
            seen.append(after)
            assert builds.import_folder(spark, two, root) == 1
        return plain(spark, root, tables, validate, after)

    monkeypatch.setattr(publish, "publish", late)
    assert builds.import_folder(spark, one, root) == 1
    assert titles(spark, root) == ["A", "B"] and publish.head(spark, root)[0] == 2
    with pytest.raises(publish.Conflict):
        plain(spark, root, {"t": spark.range(1)}, after=1)
    assert not publish._create(spark, f"{root}/log/{2:012d}", "x") and titles(spark, root) == ["A", "B"]


def corpus(spark, root):
    d = lambda n: datetime.date(2026, 9, n)
    items = [(f"n{i}", f"Title {i}", f"text {i}", d(i), 1, None, None, None, None, 6) for i in range(1, 8)]
    rows = {
        "news_item": items,
        "person": [("p1", "P1", "P1", "chair", "o1"), ("p2", "P2", "P2", None, None)],
        "organization": [("o1", "Office", "government")],
        "topic": [("t1", "flood", "Environment"), ("t2", "trade", "Economy"), *[(f"g{i}", f"generic{i}", "") for i in range(3)]],
        "news_topic": [("n1", "t1", 0.9, None), ("n2", "t1", 0.9, None), ("n3", "t2", 0.8, None), ("n4", "t2", 0.8, None)] + [(f"n{i}", f"g{j}", 0.1, None) for i in range(5, 8) for j in range(3)],
        "news_person": [("n1", "p1"), ("n2", "p1"), ("n3", "p1"), ("n3", "p2"), ("n5", "p2")],
        "news_organization": [("n1", "o1"), ("n2", "o1")],
    }
    publish.publish(spark, root, {k: spark.createDataFrame(v, TABLES[k]) for k, v in rows.items()})


def test_event_build_is_whole_or_not_at_all(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    corpus(spark, root)
    assert builds.build_events(spark, root) == {"events": 5, "with_summary": 5, "critical": 0, "relations": 4}
    e = {r["event_id"]: r for r in publish.read(spark, root, "news_event").collect()}
    of = {r["news_id"]: e[r["event_id"]] for r in publish.read(spark, root, "news_event_link").collect()}
    flood = hashlib.sha256(b"n1,n2").hexdigest()[:16]
    assert of["n1"]["event_id"] == of["n2"]["event_id"] == flood and of["n1"]["type"] == "environmental" and of["n3"]["type"] == "economic" and of["n5"]["type"] == "political"
    assert of["n1"]["name"] == "flood_2026-09-01_2条" and of["n5"]["name"] == "Title 5" and of["n1"]["summary"] == "[2026-09-01] Title 1 (+1)"
    roles = {(r["event_id"], r["person_id"]): r["role"] for r in publish.read(spark, root, "event_person").collect()}
    assert roles[flood, "p1"] == "primary_actor" and roles[of["n3"]["event_id"], "p2"] == "mentioned"
    before = publish.current(spark, root)

    def fails(digest):
        if "Title 5" in digest:
            raise RuntimeError
        return digest

    with pytest.raises(ValueError, match="1 events have no profile"):
        builds.build_events(spark, root, fails)
    assert publish.current(spark, root) == before
    loose = spark.createDataFrame([("n1", "nobody")], TABLES["news_person"])
    publish.publish(spark, root, {"news_person": publish.read(spark, root, "news_person").unionByName(loose)})
    stale = publish.current(spark, root)
    with pytest.raises(ValueError, match="lead nowhere"):
        builds.build_events(spark, root)
    assert publish.current(spark, root) == stale and publish.read(spark, root, "news_event").count() == 5


def test_setup_makes_all_tables_once(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    builds.setup(spark, root)
    assert set(publish.head(spark, root)[1]["tables"]) == set(TABLES)
    folder = write(tmp_path / "in", d20260901="## One\nbody one\n")
    assert builds.import_folder(spark, folder, root) == 1
    builds.setup(spark, root)
    assert titles(spark, root) == ["One"]
    assert builds.build_events(spark, root)["events"] == 1


# overlaps


def brute_overlaps(rows, top):
    sets = defaultdict(set)
    for i, m in rows:
        if i is not None and m is not None:
            sets[i].add(m)
    out = set()
    for a, x in sets.items():
        found = sorted((-len(x & y), b) for b, y in sets.items() if b != a and x & y)
        out |= {(a, b, -n) for n, b in found[:top]}
    return out


@pytest.mark.parametrize("longest", [2, 5, 1000])
def test_top_overlaps_equal_brute_force(spark, longest):
    rng = random.Random(longest)
    rows = [(i, m) for i in range(90) for m in {*rng.sample(range(6), rng.randint(0, 4)), *(rng.randint(10, 60) for _ in range(3)), *([99] if i % 3 else [])}]
    rows += [(None, 1), (1, None), rows[0], rows[1]]
    df = spark.createDataFrame(rows, "item long, member long")
    assert {tuple(r) for r in top_overlaps(df, 5, longest).collect()} == brute_overlaps(rows, 5)


@pytest.mark.parametrize("longest", [12, 1000])
def test_long_sets_make_no_row_for_each_shared_member(spark, monkeypatch, longest):
    from newsloom.operators import overlap

    rng = random.Random(longest)
    rows = [(f"e{i}", f"p{m}") for i in range(40) for m in rng.sample(range(60), rng.choice([2, 5, 30]))]
    df = spark.createDataFrame(rows, "item string, member string")
    joined = []
    plain = overlap.materialize

    def noted(frame, name):
        out = plain(frame, name)
        if name == "short-pairs":
            joined.append(out.agg(F.sum("rare")).first()[0])
        return out

    for name, value in (("LONG", 6), ("BLOCK", 5), ("SLAB", 7), ("materialize", noted)):
        monkeypatch.setattr(overlap, name, value)
    assert {tuple(r) for r in top_overlaps(df, 5, longest).collect()} == brute_overlaps(rows, 5)
    size = {m: sum(n == m for _, n in rows) for m in {m for _, m in rows}}
    assert joined and joined[0] < sum(n * n for n in size.values()) / 2


def test_one_person_in_very_many_events_makes_no_pairs(spark):
    n = 20_000
    hot = spark.range(n).select(F.col("id").alias("event_id"), F.lit("everywhere").alias("person_id"))
    rare = spark.range(n).select(F.col("id").alias("event_id"), F.concat(F.lit("p"), F.floor(F.col("id") / 2)).alias("person_id"))
    ev = spark.range(n).select(F.col("id").alias("event_id"), F.lit(datetime.date(2026, 1, 1)).alias("first_date"), F.lit(datetime.date(2026, 1, 3)).alias("last_date"))
    got = events.related_events(hot.unionByName(rare), ev)
    rows = {(r["source_event_id"], r["target_event_id"]): r["shared"] for r in got.where("source_event_id in (0, 7, 15000)").collect()}
    assert rows == {(0, 1): 2, (0, 2): 1, (0, 3): 1, (0, 4): 1, (0, 5): 1, (7, 6): 2, (7, 0): 1, (7, 1): 1, (7, 2): 1, (7, 3): 1, (15000, 15001): 2, (15000, 0): 1, (15000, 1): 1, (15000, 2): 1, (15000, 3): 1}
    assert got.count() == 5 * n
    sized = hot.unionByName(rare).select(F.col("event_id").alias("item"), F.col("person_id").alias("member"))
    sized = sized.join(sized.groupBy("member").agg(F.count("*").alias("n")), "member")
    assert rare_pairs(sized, 1000).count() == 2 * n  # not n * n


# digests


def test_digests_equal_hashes_of_joined_arrays(spark):
    rng = random.Random(8)
    rows = [(g, rng.choice(["a", "b", "é", "語", "10", "9"]) + str(rng.randint(0, 30))) for g in range(40) for _ in range(rng.randint(1, 60))] + [(None, "x"), (3, None)]
    want = defaultdict(set)
    for g, m in rows:
        if g is not None and m is not None:
            want[g].add(m)
    got = {r["group"]: (r["digest"], r["members"]) for r in member_digests(spark.createDataFrame(rows, "g long, m string"), "g", "m").collect()}
    assert got == {g: (hashlib.sha256(",".join(sorted(m, key=str.encode)).encode()).hexdigest(), len(m)) for g, m in want.items()}
    big = member_digests(spark.range(200_000).select(F.lit("all").alias("g"), "id"), "g", "id").first()
    assert big["members"] == 200_000 and big["digest"] == hashlib.sha256(",".join(sorted(map(str, range(200_000)))).encode()).hexdigest()


# review pairs

ARTICLE = "news_id string, title string, day date, topics array<string>, people array<string>, organizations array<string>, keywords array<string>"


def articles(n, seed=1):
    rng = random.Random(seed)
    names = lambda k, m: rng.sample([f"{k}{i}" for i in range(m)], rng.randint(0, 3))
    return [(f"a{i:04d}", f"Title {i} {rng.random()}", datetime.date(2026, 1, 1) + datetime.timedelta(days=rng.randint(0, 25)), names("t", 6), names("p", 200), names("o", 40) + [None] * (i % 9 == 0), []) for i in range(n)]


def brute_strata(rows, edges):
    out = Counter()
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if abs((a[2] - b[2]).days) <= 7:
                related = any(({*a[k]} & {*b[k]}) - {None} for k in (3, 4, 5))
                out["model_positive" if tuple(sorted((a[0], b[0]))) in edges else "topical_unmatched" if related else "random_control"] += 1
    return out


@pytest.mark.parametrize(("longest", "frequent"), [(100, 12), (3, 12), (0, 12), (0, 2)])
def test_strata_counts_equal_brute_force(spark, monkeypatch, longest, frequent):
    monkeypatch.setattr(annotation, "LONGEST", longest)
    monkeypatch.setattr(annotation, "FREQUENT", frequent)
    rows = articles(150)
    df = spark.createDataFrame(rows, ARTICLE)
    edges = {(r["left"], r["right"]) for r in annotation.accepted_pairs(df).collect()}
    assert {r["stratum"]: r["pairs"] for r in annotation.strata_counts(df).collect() if r["pairs"]} == brute_strata(rows, edges)


def test_queue_holds_the_least_drawn_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(annotation, "LOOK", 2)  # so that only a share of all pairs is looked at
    rows = articles(200, 2)
    df = spark.createDataFrame(rows, ARTICLE)
    edges = {(r["left"], r["right"]) for r in annotation.accepted_pairs(df).collect()}
    number = {r[0]: int(hashlib.sha256(f"5|{r[0]}".encode()).hexdigest()[:12], 16) for r in rows}
    strata = defaultdict(list)
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if abs((a[2] - b[2]).days) <= 7:
                l, r = sorted((a[0], b[0]))
                related = any(({*a[k]} & {*b[k]}) - {None} for k in (3, 4, 5))
                strata["model_positive" if (l, r) in edges else "topical_unmatched" if related else "random_control"].append(((number[l] + number[r]) % 2**48, l, r))
    want = {s: {x[1:] for x in sorted(p)[:5]} for s, p in strata.items()}
    got = defaultdict(set)
    for r in annotation.make_queue(df, limit=15, seed=5).collect():
        got[r["stratum"]].add((r["left"], r["right"]))
    spare = 15 - sum(len(want.get(s, ())) for s in annotation.STRATA)
    assert spare >= 0 and all(want[s] <= got[s] for s in want) and sum(map(len, got.values())) == 15


def test_a_share_of_pairs_is_drawn_without_making_the_rest(spark):
    rows = [(f"a{i:05d}", "t", datetime.date(2026, 1, 1), ["same"], [f"p{i}"], [], []) for i in range(3000)]
    df = spark.createDataFrame(rows, ARTICLE).withColumn("number", annotation._number(1))
    for by_name in (False, True):
        n = annotation.drawn_pairs(df, 7, 1 << 14, by_name).count()
        assert 150 < n < 450  # of 4,498,500 pairs
    assert {r["stratum"]: r["pairs"] for r in annotation.strata_counts(df.drop("number")).collect()}["topical_unmatched"] == 3000 * 2999 // 2


def test_loading_reports_what_an_import_cannot_take(spark):
    kind = "news_id string, title string, full_text string, broadcast_date date, order_in_broadcast int, url string"
    d = datetime.date(2026, 1, 1)
    df = spark.createDataFrame([("a", "T", "x", d, 1, None), ("a", "T", "y", d, 1, None), ("b", "", "x", d, 2, None), ("c", "T", "x", d, 3, None)], kind)
    old = spark.createDataFrame([("c", "T", "old", d, 3, None)], kind)
    assert {tuple(r) for r in loading.import_errors(df, old).collect()} == {("a", "several contents in the batch"), ("b", "no title or text"), ("c", "known with other content")}
