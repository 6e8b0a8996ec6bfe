"""Queues of pairs for human review, and what reviews amount to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.clusters import candidate_edges
from newsloom.plans.scratch import materialize
from newsloom.schema import REVIEW_LABELS

STRATA = ("model_positive", "topical_unmatched", "random_control")


#: Articles that may hold a name for the pairs under it to be made, names of an article that may have more, bits of drawn numbers, pairs looked at for each one wanted.
LONGEST, FREQUENT, BITS, LOOK = 100, 12, 48, 8


def _names(articles: DataFrame) -> DataFrame:
    """``news_id, day, name`` of each article's topics, people and organizations, each kind apart; repeated ones once."""
    marked = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(c[0]), x.cast("string")))
    each = F.array_distinct(F.concat(*map(marked, ("topics", "people", "organizations"))))
    return articles.select("news_id", "day", F.explode(each).alias("name")).where("name is not null")


def _related(articles: DataFrame) -> Column:
    """Whether a pair with columns ``_l`` and ``_r`` shares a topic, a person or an organization."""
    return F.coalesce(F.arrays_overlap("topics_l", "topics_r"), F.lit(False)) | F.coalesce(F.arrays_overlap("people_l", "people_r"), F.lit(False)) | F.coalesce(F.arrays_overlap("organizations_l", "organizations_r"), F.lit(False))


def _pairs_of_days(counts: DataFrame, keys: list[str], window_days: int) -> DataFrame:
    """``pairs`` for each row of ``counts (keys, day, n)``: those of its items among each other and with later ones within the window."""
    later = Window.partitionBy(*keys, F.lit(0)).orderBy(F.unix_date("day")).rangeBetween(1, max(window_days, 1))
    n, more = F.col("n").cast("decimal(38,0)"), F.coalesce(F.sum("n").over(later), F.lit(0)).cast("decimal(19,0)")
    own = F.col("n").cast("decimal(19,0)")
    return counts.withColumn("pairs", (own * (n - 1) / 2).cast("decimal(38,0)") + (own * (more if window_days else F.lit(0).cast("decimal(19,0)"))).cast("decimal(38,0)"))


def related_pairs(articles: DataFrame, window_days: int = 7) -> DataFrame:
    """One row ``related``: the pairs within the window that share a name, counted and not made.

    Names of many articles go by inclusion and exclusion: each set of such names that an
    article holds counts its articles by day, and its pairs follow from these counts.
    Pairs that share only names of few articles are made; these are at most as many as
    the entries times the longest list. An article may hold ``FREQUENT`` frequent names;
    where one holds more, the length from which a name is frequent grows.
    """
    names = _names(articles)
    sized = materialize(names.join(names.groupBy("name").agg(F.count("*").alias("n")), "name"), "names")
    of_article = sized.groupBy("news_id", "day").agg(F.sort_array(F.collect_list("n"), asc=False).alias("sizes"))
    longest = max(LONGEST, of_article.agg(F.max(F.get("sizes", F.lit(FREQUENT)))).first()[0] or 0)
    held = sized.groupBy("news_id", "day").agg(F.sort_array(F.collect_list(F.when(F.col("n") > longest, F.col("name")))).alias("held"))
    held = materialize(held, "frequent-names")
    classes = held.where(F.size("held") > 0).groupBy("day", "held").agg(F.count("*").alias("n"))
    masks = F.explode(F.expr("sequence(1, shiftleft(1, size(held)) - 1)"))
    subset = F.expr("filter(held, (x, i) -> (mask & shiftleft(1, i)) <> 0)")
    sets = classes.withColumn("mask", masks).select(subset.alias("names"), "day", "n").groupBy("names", "day").agg(F.sum("n").alias("n"))
    sign = F.when(F.size("names") % 2 == 1, 1).otherwise(-1).cast("decimal(1,0)")
    frequent = _pairs_of_days(sets, ["names"], window_days).agg(F.coalesce(F.sum((F.col("pairs") * sign).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("frequent"))
    rare = sized.where(F.col("n") <= longest)
    side = lambda s: rare.select("name", F.col("news_id").alias(f"news_id_{s}"), F.col("day").alias(f"day_{s}"))
    met = side("l").join(side("r"), "name").where((F.col("news_id_l") < F.col("news_id_r")) & (F.abs(F.datediff("day_l", "day_r")) <= window_days)).select("news_id_l", "news_id_r").distinct()
    hold = lambda s: held.where(F.size("held") > 0).select(F.col("news_id").alias(f"news_id_{s}"), F.col("held").alias(f"held_{s}"))
    met = met.join(hold("l"), "news_id_l", "left").join(hold("r"), "news_id_r", "left").where(~F.coalesce(F.arrays_overlap("held_l", "held_r"), F.lit(False)))
    return frequent.crossJoin(met.agg(F.count("*").alias("rare"))).select((F.col("frequent") + F.col("rare")).cast("decimal(38,0)").alias("related"))


def accepted_pairs(articles: DataFrame, window_days: int = 7) -> DataFrame:
    """``left, right, score`` of the pairs that the clustering accepts, written."""
    return materialize(candidate_edges(articles, window_days).select("left", "right", "score"), "accepted")


def strata_counts(articles: DataFrame, window_days: int = 7, accepted: DataFrame | None = None) -> DataFrame:
    """Pairs within the window by stratum: accepted, otherwise related by topic, person or organization, or neither. No pairs are made but those of rare names."""
    if window_days < 0:
        raise ValueError("window_days must not be negative")
    accepted = accepted_pairs(articles, window_days) if accepted is None else accepted
    days = articles.groupBy("day").agg(F.count("*").alias("n"))
    total = _pairs_of_days(days, [], window_days).agg(F.coalesce(F.sum("pairs"), F.lit(0)).cast("decimal(38,0)").alias("total"))
    one = total.crossJoin(related_pairs(articles, window_days)).crossJoin(accepted.agg(F.count("*").alias("accepted")))
    one = one.select(F.col("accepted").alias("a"), F.expr("cast(related - accepted as bigint)").alias("b"), F.expr("cast(total - related as bigint)").alias("c"))
    return one.select(F.expr(f"stack(3, '{STRATA[0]}', a, '{STRATA[1]}', b, '{STRATA[2]}', c) as (stratum, pairs)"))


def _number(seed: int) -> Column:
    """An article's drawn number of ``BITS`` bits, from the seed and its id."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col("news_id").cast("string")), 256), 1, BITS // 4), 16, 10).cast("long")


def drawn_pairs(articles: DataFrame, window_days: int, share: int, by_name: bool) -> DataFrame:
    """``left, right, draw, related``: one pair of ``share`` (a power of two) within the window, drawn evenly; with ``by_name`` only of those that share a name.

    A pair's draw is the sum of its articles' numbers modulo ``2 ** BITS``; the pairs of
    the least draws are those whose leading bits add up to nothing, or would with a
    carry, so that they meet by an equi join on day and bits and no others are made.
    """
    bits = share.bit_length() - 1
    own = articles.select("news_id", "day", "topics", "people", "organizations", "number").withColumn("lead", F.shiftright("number", BITS - bits) if bits else F.lit(0).cast("long"))
    if by_name:
        own = own.join(_names(articles).select("news_id", "name"), "news_id")
    side = lambda s: own.select(*[F.col(c).alias(f"{c}_{s}") for c in own.columns])
    left = side("l").withColumn("day_r", F.explode(F.expr(f"sequence(day_l, date_add(day_l, {window_days}), interval 1 day)")))
    left = left.withColumn("lead_r", F.explode(F.array_distinct(F.array(F.pmod(-F.col("lead_l"), F.lit(share)), F.pmod(-F.col("lead_l") - 1, F.lit(share))))))
    on = ["day_r", "lead_r"]
    right = side("r")
    if by_name:
        left, on = left.withColumnRenamed("name_l", "name"), [*on, "name"]
        right = right.withColumnRenamed("name_r", "name")
    p = left.join(right, on).where("day_l < day_r or news_id_l < news_id_r")
    draw = F.pmod(F.col("number_l") + F.col("number_r"), F.lit(2**BITS))
    p = p.withColumn("draw", draw).where(F.col("draw") < 2**BITS // share).select(F.least("news_id_l", "news_id_r").alias("left"), F.greatest("news_id_l", "news_id_r").alias("right"), "draw", _related(articles).alias("related"))
    return p.distinct() if by_name else p


def _least_drawn(articles: DataFrame, accepted: DataFrame, related: bool, wanted: int, limit: int, window_days: int) -> DataFrame:
    """The ``limit`` pairs of least draw of an unaccepted stratum that has ``wanted`` pairs, written. A larger share of all pairs is looked at until they are found."""
    share = 1 << max(0, (wanted // (LOOK * limit)).bit_length() - 1)
    while True:
        p = drawn_pairs(articles, window_days, share, related).where(F.col("related") == related)
        p = p.join(accepted.select("left", "right"), ["left", "right"], "left_anti").orderBy("draw", "left", "right").limit(limit)
        found = materialize(p.select("left", "right", F.lit(STRATA[1] if related else STRATA[2]).alias("stratum"), F.lit(None).cast("double").alias("score"), "draw"), "drawn")
        if share == 1 or found.count() >= min(limit, wanted):
            return found
        share = max(1, share >> 4)


def make_queue(articles: DataFrame, limit: int = 90, seed: int = 20261029, window_days: int = 7) -> DataFrame:
    """At most ``limit`` pairs for review, a third of each stratum where there are so many, then others in the order of strata.

    In each stratum the pairs of least draw are taken, of all its pairs. Each row has
    ``source`` (titles, dates, URLs, excerpts of both), ``evidence`` (score and shared
    names) and blank review columns. ``articles`` may have ``url``, ``excerpt`` and
    ``summary``.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    accepted = accepted_pairs(articles, window_days)
    wanted = {r["stratum"]: r["pairs"] for r in strata_counts(articles, window_days, accepted).collect()}
    numbered = articles.withColumn("number", _number(seed))
    side = lambda s: numbered.select(F.col("news_id").alias(s), F.col("number").alias(f"number_{s}"))
    first = accepted.join(side("left"), "left").join(side("right"), "right").withColumn("draw", F.pmod(F.col("number_left") + F.col("number_right"), F.lit(2**BITS)))
    tops = first.select("left", "right", F.lit(STRATA[0]).alias("stratum"), "score", "draw").orderBy("draw", "left", "right").limit(limit)
    for related, stratum in ((True, STRATA[1]), (False, STRATA[2])):
        if wanted[stratum]:
            tops = tops.unionByName(_least_drawn(numbered, accepted, related, wanted[stratum], limit, window_days))
    at = F.row_number().over(Window.partitionBy("stratum").orderBy("draw", "left", "right"))
    tops = materialize(tops, "queue").withColumn("at", at)
    quota = F.when(F.col("stratum") == STRATA[2], limit - 2 * (limit // 3)).otherwise(limit // 3)
    tops = tops.withColumn("late", (F.col("at") > quota).cast("int")).withColumn("turn", F.array_position(F.array(*map(F.lit, STRATA)), F.col("stratum")))
    rows = tops.orderBy("late", "turn", "at").limit(limit)
    more = [c for c in ("url", "excerpt", "summary") if c in articles.columns]
    side = lambda s: articles.select(F.col("news_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("title", "day", "topics", "people", "organizations", *more)])
    rows = rows.join(side("left"), "left").join(side("right"), "right")
    text = lambda c, s: F.col(f"{c}_{s}") if c in more else F.lit(None).cast("string")
    excerpt = lambda s: F.coalesce(F.nullif(text("excerpt", s), F.lit("")), text("summary", s))
    both = ("left", "right")
    source = F.struct(*[F.col(f"title_{s}").alias(f"{s}_title") for s in both], *[F.col(f"day_{s}").alias(f"{s}_date") for s in both], *[text("url", s).alias(f"{s}_url") for s in both], *[excerpt(s).alias(f"{s}_excerpt") for s in both])
    shared = lambda c: F.array_sort(F.array_intersect(f"{c}_left", f"{c}_right")).alias(f"shared_{c}")
    evidence = F.struct(F.col("score").alias("matched_pair_score"), shared("topics"), shared("people"), shared("organizations"))
    blank = F.lit(None).cast("struct<id:string,label:string,evidence:string>")
    return rows.orderBy("late", "turn", "at").select("left", "right", "stratum", source.alias("source"), evidence.alias("evidence"), blank.alias("reviewer_1"), blank.alias("reviewer_2"), F.lit(None).cast("struct<label:string,reviewer:string,note:string>").alias("adjudication"))


def check_reviews(reviews: DataFrame) -> None:
    """Raise on unknown labels, pairs of an item with itself, repeated pairs, and two labels by one reviewer."""
    a, b = F.col("reviewer_1"), F.col("reviewer_2")
    known = lambda c: c.isNull() | c.isin(*REVIEW_LABELS)
    wrong = ~known(a["label"]) | ~known(b["label"]) | ~known(F.col("adjudication.label")) | (F.col("left") == F.col("right"))
    same = a["label"].isNotNull() & b["label"].isNotNull() & (F.coalesce(a["id"], F.lit("")).eqNullSafe(F.coalesce(b["id"], F.lit(""))) | a["id"].isNull() | b["id"].isNull())
    bad = reviews.where(wrong | same).count()
    twice = reviews.groupBy(F.least("left", "right"), F.greatest("left", "right")).count().where("count > 1").count()
    if bad or twice:
        raise ValueError(f"{bad} invalid reviews, {twice} repeated pairs")


def review_state(reviews: DataFrame) -> DataFrame:
    """Each review's ``state``: unreviewed (a label is missing), ready or needs_adjudication, and its final ``label`` if ready."""
    a, b, c = (F.col(x) for x in ("reviewer_1.label", "reviewer_2.label", "adjudication.label"))
    both = a.isNotNull() & b.isNotNull()
    agreed = both & (a == b) & (a != "UNSURE")
    settled = both & c.isNotNull() & (c != "UNSURE") & (F.coalesce(F.trim("adjudication.reviewer"), F.lit("")) != "")
    state = F.when(agreed | settled, "ready").when(both, "needs_adjudication").otherwise("unreviewed")
    return reviews.withColumn("state", state).withColumn("label", F.when(agreed, a).when(settled, c))


def agreement(ratings: DataFrame) -> DataFrame:
    """Of doubly rated rows ``(a, b)``: their number, observed agreement, and Cohen's kappa (null without rows or where chance explains all)."""
    own = ratings.where("a is not null and b is not null").select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    cells = own.groupBy("a", "b").agg(F.count("*").alias("n"))
    top = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("agreed"))
    margin = cells.groupBy("a").agg(F.sum("n").alias("x")).join(cells.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("y")), "a").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("m"))
    po = F.try_divide(F.col("agreed").cast("double"), F.col("n"))
    pe = F.try_divide(F.col("m").cast("double"), F.col("n") * F.col("n"))
    return top.crossJoin(margin).select("n", "agreed", F.round(po, 6).alias("agreement"), F.round(F.when(pe < 1, F.try_divide(po - pe, 1 - pe)), 6).alias("kappa"))


def review_summary(reviews: DataFrame) -> DataFrame:
    """One row: pairs in all, unreviewed, doubly reviewed, agreed on a definitive label, adjudicated, still to adjudicate, ready, and the reviewers' agreement."""
    state = review_state(reviews)
    a, b = F.col("reviewer_1.label"), F.col("reviewer_2.label")
    ready = F.col("state") == "ready"
    counts = state.agg(
        F.count("*").alias("total_pairs"),
        F.count_if(F.col("state") == "unreviewed").alias("unreviewed"),
        F.count_if(F.col("state") != "unreviewed").alias("double_reviewed"),
        F.count_if(ready & (a == b) & (a != "UNSURE")).alias("agreed_and_definitive"),
        F.count_if(ready & ((a != b) | (a == "UNSURE"))).alias("adjudicated"),
        F.count_if(F.col("state") == "needs_adjudication").alias("needs_adjudication"),
        F.count_if(ready).alias("ready_definitive_pairs"),
    )
    own = agreement(reviews.select(a.alias("a"), b.alias("b")))
    return counts.crossJoin(own.select(F.col("agreement").alias("reviewer_agreement"), F.col("kappa").alias("cohens_kappa")))
