"""Near-duplicate embeddings with an inverted multi-index.

Two codebooks, trained on the halves of a bounded sample of vectors, form a product
grid. Every vector has a home cell and visits cells in the order of two sorted
sequences of costs, one for each half: the squared distances to the planes between
its nearest centroid and the others. A neighbour cannot lie in a cell whose summed
cost exceeds the squared distance at the threshold. How far a search has to go for the
recall that is asked for is measured on simulated neighbours at the threshold, one of
each sampled vector in a random direction, and on the sample's own links, each vector
counting once; so neither the input's size nor hot groups change the rule. Visits
meet home vectors cell by cell, in blocks of bounded size, and are verified in
double precision. Equal vectors are one class from the start, and a block returns
sums and a spanning forest, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import forest
from newsloom.plans.components import connected_components
from newsloom.plans.scratch import materialize
from newsloom.session import ship

#: Vectors that the codebooks are trained on at most (about), wanted vectors of the largest label in a cell, most centroids of a half (the sample has 20 for each),
#: home and visiting vectors of a block, share of neighbours at the threshold that a search must reach, and what rounding may add to a cost.
SAMPLE, PER_CELL, CENTROIDS, HOME_BLOCK, VISIT_BLOCK, RECALL, SLACK = 20_000, 100, 1_024, 512, 1_024, 0.9995, 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; first scaled by their largest component, as squares of very large or small ones leave the range of doubles."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's rounds from rows evenly spaced in the sample."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = distances(x, c).argmin(1)
        for i in range(len(c)):
            if (near == i).any():
                c[i] = x[near == i].mean(0)
    return np.unique(c, axis=0)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


def costs(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid, and for each centroid the squared distance to the plane between it and the nearest."""
    d = distances(x, c)
    home = d.argmin(1)
    gap = np.sqrt(np.maximum(distances(c, c), 0))[home]
    far = np.maximum(d - d[np.arange(len(x)), home][:, None], 0) / np.where(gap > 0, 2 * gap, 1)
    return home, far * far


def visits(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``x``, cells they visit, and whether the cell is the row's home."""
    h = x.shape[1] // 2
    (home1, c1), (home2, c2) = costs(x[:, :h], books[0]), costs(x[:, h:], books[1])
    o1, o2 = np.argsort(c1, 1, kind="stable"), np.argsort(c2, 1, kind="stable")
    s1, s2 = np.take_along_axis(c1, o1, 1), np.take_along_axis(c2, o2, 1)
    rows, cells = [], []
    for a in range(len(books[0])):  # the a-th nearest in one half with as many of the other as the radius leaves
        r, b = np.nonzero(s2 <= (radius - s1[:, a])[:, None])
        if not len(r):
            break
        rows.append(r)
        cells.append(o1[r, a] * len(books[1]) + o2[r, b])
    rows, cells = np.concatenate(rows), np.concatenate(cells)
    return rows, cells, cells == (home1 * len(books[1]) + home2)[rows]


def stop_radius(x: np.ndarray, key: np.ndarray, books: tuple[np.ndarray, np.ndarray], least: float) -> float:
    """Cost within which ``RECALL`` of the neighbours at the threshold are reached, and for as many sampled vectors all their links in the sample; never more than the exact bound."""
    h, rng = x.shape[1] // 2, np.random.default_rng(0)
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    y = least * x + (1 - least**2) ** 0.5 * away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
    (home1, c1), (home2, c2) = costs(x[:, :h], books[0]), costs(x[:, h:], books[1])
    (near1, _), (near2, _) = costs(y[:, :h], books[0]), costs(y[:, h:], books[1])
    rows = np.arange(len(x))
    reach = float(np.quantile(c1[rows, near1] + c2[rows, near2], RECALL))
    furthest = []
    for k in np.unique(key):
        at = np.flatnonzero(key == k)
        for lo in range(0, len(at), 1000):
            some = at[lo : lo + 1000]
            linked = (x[some] @ x[at].T >= least) & (some[:, None] != at)
            cost = np.where(linked, c1[some][:, home1[at]] + c2[some][:, home2[at]], -1).max(1)
            furthest.append(cost[cost >= 0])
    furthest = np.concatenate(furthest)
    if len(furthest):
        reach = max(reach, float(np.quantile(furthest, RECALL)))
    return min(2 - 2 * least, reach) + SLACK


def valid(embedding: str = "embedding", label: str = "label"):
    e = F.col(embedding)
    fine = F.size(e) > 0
    fine = fine & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & e.isNotNull() & fine & F.exists(e, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors (vec_id, embedding, label)``.

    Rows link when their labels are equal and their cosine is at least ``least``.
    Null, zero or empty vectors, such with null or non-finite components, and rows
    without a label link with nothing; vectors of different lengths neither. Equal
    vectors of a label always link. A null vec_id takes part in counts, but its
    component is null unless a link leads to an id; rows that repeat a vec_id are each
    scored. An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    e = F.col("embedding") if dict(vectors.dtypes)["embedding"] in ("array<float>", "array<double>") else F.transform("embedding", lambda x: x.cast("double"))
    own = vectors.select("vec_id", F.when(valid(), F.concat_ws(":", F.size("embedding").cast("string"), F.col("label").cast("string"))).alias("key"), e.alias("e"))
    classes = materialize(own.where("key is not null").groupBy("key", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("c", F.xxhash64("key", "e")), "vectors")
    n = classes.count()
    met = None
    for (dim,) in [tuple(r) for r in classes.select(F.size("e")).distinct().toLocalIterator()] if n else []:
        part = _links(classes.where(F.size("e") == dim), least, n)
        met = part if met is None else met.unionByName(part)
    if met is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    met = materialize(met, "links")
    labels_of = connected_components(met.where("other is not null"), "c", "other")
    counts = met.groupBy("c").agg(F.sum("links").alias("links"))
    low = classes.select("key", "e", "rep", "n", "c").join(counts, "c", "left").join(labels_of, F.col("c") == F.col("node"), "left").withColumn("at", F.coalesce("component", "c"))
    low = materialize(low.select("key", "e", "rep", "n", "links", "at"), "classes")
    least_of = low.groupBy(F.col("at").alias("root")).agg(F.min("rep").alias("least"))
    done = low.join(least_of, F.col("at") == F.col("root")).select(F.col("key").alias("k"), F.col("e").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "least")
    out = own.join(done, (own["key"] == F.col("k")) & (own["e"] == F.col("v")), "left")
    component = F.coalesce("least", "vec_id").cast("long")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _links(classes: DataFrame, least: float, n: int) -> DataFrame:
    """``c, links, other``: partial counts of each class's links to other classes' vectors, and edges of spanning forests."""
    spark = classes.sparkSession
    step = -(-n // SAMPLE)
    drawn = classes.where(F.pmod(F.xxhash64("c"), F.lit(step)) == 0).select("key", "e").toPandas()
    if drawn.empty:
        drawn = classes.select("key", "e").limit(1).toPandas()
    x = unit(np.stack(drawn["e"].to_numpy()))
    most = classes.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    h, k = x.shape[1] // 2, int(np.clip(round((most / PER_CELL) ** 0.5), 2, CENTROIDS))
    books = kmeans(x[:, :h], k), kmeans(x[:, h:], k)
    index = spark.sparkContext.broadcast((books, stop_radius(x, drawn["key"].to_numpy().astype(str), books, least)))

    def visit(batches):
        b2, r = index.value
        for b in (whole.slice(lo, 1000) for whole in batches for lo in range(0, whole.num_rows, 1000)):
            if b.num_rows:
                v = unit(np.stack(b.column(1).to_numpy(zero_copy_only=False)))
                rows, cells, home = visits(v, b2, r)
                take = b.take(pa.array(rows))
                yield pa.record_batch({"key": take.column(0), "c": take.column(2), "n": take.column(3), "cell": pa.array(cells.astype(np.int64)), "home": pa.array(home), "e": take.column(1)})

    seen = materialize(classes.select("key", "e", "c", "n").mapInArrow(visit, f"key string, c long, n long, cell long, home boolean, e {dict(classes.dtypes)['e']}"), "visits")
    size = seen.groupBy("key", "cell").agg(F.ceil(F.count_if("home") / HOME_BLOCK).cast("int").alias("hb"), F.ceil(F.count("*") / VISIT_BLOCK).cast("int").alias("vb")).where("hb > 0")
    cut = seen.join(size, ["key", "cell"])
    block = lambda n: F.pmod(F.col("c"), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    visitor = cut.select("key", "cell", block("vb").alias("i"), all_("hb").alias("j"), F.lit(False).alias("at_home"), "c", "n", "e")
    at_home = cut.where("home").select("key", "cell", all_("vb").alias("i"), block("hb").alias("j"), F.lit(True).alias("at_home"), "c", "n", "e")

    def verify(t: pa.Table) -> pa.Table:
        where = t.column("at_home").to_numpy()
        v = unit(np.stack(t.column("e").to_numpy()))
        c, m = t.column("c").to_numpy(), t.column("n").to_numpy()
        p, b = np.flatnonzero(~where), np.flatnonzero(where)
        a = (v[p] @ v[b].T >= least) & (c[p][:, None] != c[b])
        links = a @ m[b]
        root = forest(a)
        of = np.r_[c[p], c[b]]
        in_tree = np.flatnonzero(root >= 0)
        one, other = of[in_tree], c[p][root[in_tree]]
        edges = np.unique(np.stack([one, other], 1)[one != other], axis=0) if len(one) else np.empty((0, 2), np.int64)
        some = np.flatnonzero(links)
        return pa.table({"c": pa.array(np.r_[c[p][some], edges[:, 0]].astype(np.int64)), "links": pa.array(np.r_[links[some], np.zeros(len(edges))].astype(np.int64)), "other": pa.array([None] * len(some) + edges[:, 1].tolist(), pa.int64())})

    return visitor.unionByName(at_home).groupBy("key", "cell", "i", "j").applyInArrow(verify, "c long, links long, other long")
