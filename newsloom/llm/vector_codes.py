"""Product codes of vectors, learned and assigned in exact integers, with LAESA pivots.

A vector's components become integers and fall into four parts; each part position has
a codebook of up to 256 entries that some rounds of assignment and averaging refine.
Pivots are fixed parts, chosen far apart from the first entries. The distances of all
parts to their pivots are computed once and written beside the parts. In each round the
entries' distances to the pivots are computed anew; their differences to a part's own
are lower bounds of the distance between part and entry, which order the entries and
rule most of them out, so that few squared distances are evaluated, in integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.plans.scratch import materialize
from newsloom.session import ship

#: Parts of a vector, entries of a codebook, rounds, integer steps of one, pivots of a part position.
PARTS, ENTRIES, ROUNDS, SCALE, PIVOTS = 4, 256, 4, 1024, 6
#: Rows that are assigned together, slack of bounds computed in single precision, share of entries left above which a block evaluates them together.
BLOCK, SLACK, MANY = 1_024, np.float32(1e-6), 0.05


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, in integers."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def choose_pivots(entries: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Entries far apart: the one furthest from the mean, then always the one furthest from those chosen."""
    near = ((entries - entries.mean(0)) ** 2).sum(1)
    chosen: list[int] = []
    for _ in range(min(n, len(entries))):
        chosen.append(int(near.argmax()))
        d = ((entries - entries[chosen[-1]]) ** 2).sum(1).astype(float)
        near = d if len(chosen) == 1 else np.minimum(near, d)
    return entries[chosen]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of each row to each pivot."""
    return np.sqrt(np.stack([squares(x, p) for p in pivots], 1).astype(np.float64)).astype(np.float32)


def all_squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries: integers, by a product of matrices; in doubles where these hold every sum exactly."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * most * most < 2**53:
        x, entries = x.astype(np.float64), entries.astype(np.float64)
    return (np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ entries.T) + np.einsum("ij,ij->i", entries, entries)).astype(np.int64)


def assign(x: np.ndarray, own: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each row (the lower index on ties), its squared distance, and how many distances had to be evaluated.

    ``own`` has the rows' distances to ``pivots``. No lower bound may pass the true
    distance, so bounds are lessened by what rounding can have added. The entries of
    least bounds are evaluated first; those that the best of them doesn't rule out are
    taken one by one where they are few, and by a product of matrices where they are many.
    """
    theirs = to_pivots(entries, pivots)
    low = np.zeros((len(x), len(entries)), np.float32)
    for p in range(own.shape[1]):
        np.maximum(low, np.abs(own[:, p, None] - theirs[None, :, p]), out=low)
    low -= SLACK * (own.max(1, keepdims=True) + theirs.max())
    np.maximum(low, 0, out=low)
    low *= low
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)

    def better(r, d, e):
        less = (d < best[r]) | ((d == best[r]) & (e < at[r]))
        best[r[less]], at[r[less]] = d[less], e[less]

    rows = np.arange(len(x))
    first = low.argmin(1)  # the most promising gives an upper bound
    better(rows, squares(x, entries[first]), first)
    left = low <= (best * (1 + SLACK))[:, None]
    evaluated = int(left.sum()) + len(x)
    if evaluated > left.size * MANY:
        d = np.where(left, all_squares(x, entries), np.iinfo(np.int64).max)
        nearest = d.argmin(1)
        better(rows, d[rows, nearest], nearest)
    else:
        left_r, left_e = np.nonzero(left)
        if len(left_r):
            d = squares(x[left_r], entries[left_e])
            cut = np.r_[0, np.flatnonzero(np.diff(left_r)) + 1]
            least = np.minimum.reduceat(d, cut)
            nearest = np.minimum.reduceat(np.where(d == np.repeat(least, np.diff(np.r_[cut, len(d)])), left_e, len(entries)), cut)
            better(left_r[cut], least, nearest)
    return at, best, evaluated


def integers(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, size, v`` of the rows to be coded; ``v`` has ``floor(SCALE * x)``, with zeros to a multiple of ``PARTS``."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.select("vec_id", "label", e.alias("e")).where(fine).withColumn("size", F.size("e"))
    most = F.floor(F.sqrt(F.lit(2.0**63) / F.greatest("size", F.lit(1))) / 2) - 1
    whole = F.transform("e", lambda x: F.greatest(-most, F.least(most, F.when(F.abs(x) > 2.0**40, F.signum(x) * 2.0**50).otherwise(F.floor(x * SCALE)).cast("long"))))
    pad = F.array_repeat(F.lit(0).cast("long"), F.when(F.col("size") == 0, F.lit(PARTS)).otherwise(F.pmod(-F.col("size"), F.lit(PARTS))))
    return own.select("vec_id", F.col("label"), "size", F.concat(whole, pad).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def _blocks(batches):
    """Blocks of rows of one size: the batch's rows and their vectors as (row, part, component)."""
    for b in batches:
        sizes = b.column("size").to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            for lo in range(0, len(at), BLOCK):
                some = b if len(at) == b.num_rows <= BLOCK else b.take(pa.array(at[lo : lo + BLOCK]))
                wide = len(some.column("v")[0])
                yield int(size), some, _matrix(some.column("v"), wide).reshape(-1, PARTS, wide // PARTS)


def train(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, dict[int, np.ndarray], dict[int, list[np.ndarray]]]:
    """The rows of :func:`integers` with their pivot distances, written; and by size of vector the final codebooks (part, entry, component) and the pivots of each part.

    What the driver and the tasks hold are codebooks: ``entries`` vectors for each size.
    """
    spark = rows.sparkSession
    ship(spark)
    place = F.struct(F.col("vec_id").isNull(), "vec_id", "v")
    first = rows.groupBy("size").agg(F.count("*").alias("n")).select("size").collect()
    books, pivots = {}, {}
    for (size,) in first:
        start = rows.where(F.col("size") == size).orderBy(place).limit(entries).select("v").collect()
        v = np.array([r["v"] for r in start], np.int64)
        books[size] = np.ascontiguousarray(v.reshape(len(v), PARTS, -1).transpose(1, 0, 2))
        pivots[size] = [choose_pivots(books[size][p]) for p in range(PARTS)]
    shared = spark.sparkContext.broadcast(pivots)

    def measure(batches):
        for size, some, x in _blocks(batches):
            own = np.stack([to_pivots(x[:, p], shared.value[size][p]) for p in range(PARTS)], 1).reshape(len(x), -1)
            ends = pa.array(np.arange(len(x) + 1) * own.shape[1], pa.int32())
            yield pa.record_batch({**{c: some.column(c) for c in ("vec_id", "label", "size", "v")}, "own": pa.ListArray.from_arrays(ends, pa.array(own.ravel()))})

    kinds = dict(rows.dtypes)
    written = materialize(rows.mapInArrow(measure, f"vec_id {kinds['vec_id']}, label {kinds['label']}, size int, v array<long>, own array<float>"), "pivot-distances")
    for _ in range(rounds):
        for (size, part, entry), n, sums in _sums(written, books, pivots):
            books[size][part, entry] = [int(s) // n for s in sums]
    return written, books, pivots


def _assigned(size: int, some, x: np.ndarray, books: np.ndarray, pivots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = len(pivots[0])
    own = _matrix(some.column("own"), PARTS * n).reshape(-1, PARTS, n)
    found = [assign(x[:, p], own[:, p], books[p], pivots[p]) for p in range(PARTS)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _sums(written: DataFrame, books: dict[int, np.ndarray], pivots: dict[int, list[np.ndarray]]) -> list[tuple[tuple[int, int, int], int, list]]:
    """Counts and component sums of the parts that each entry gets, for used entries only: a task adds up its rows, Spark the tasks."""
    shared = written.sparkSession.sparkContext.broadcast((books, pivots))

    def run(batches):
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        books, pivots = shared.value
        for size, some, x in _blocks(batches):
            code, _ = _assigned(size, some, x, books[size], pivots[size])
            count, sums = total.setdefault(size, (np.zeros(books[size].shape[:2], np.int64), np.zeros(books[size].shape, np.int64)))
            for p in range(PARTS):
                np.add.at(count[p], code[:, p], 1)
                np.add.at(sums[p], code[:, p], x[:, p])
            if count[0].max() > 2**20:  # long before a sum could overflow
                yield from _rows(size, *total.pop(size))
        for size, (count, sums) in total.items():
            yield from _rows(size, count, sums)

    parts = written.select("size", "v", "own").mapInArrow(run, "size int, part int, entry int, n long, sums array<decimal(38,0)>")
    each = parts.select("size", "part", "entry", "n", F.posexplode("sums").alias("i", "s")).groupBy("size", "part", "entry", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    rows = each.groupBy("size", "part", "entry").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "s"))).alias("s"))  # an entry's components
    return [((r["size"], r["part"], r["entry"]), r["n"], [x["s"] for x in r["s"]]) for r in rows.collect()]


def _rows(size: int, count: np.ndarray, sums: np.ndarray):
    part, entry = np.nonzero(count)
    if len(part):
        flat = pa.array(sums[part, entry].ravel()).cast(pa.decimal128(38, 0))
        ends = pa.array(np.arange(len(part) + 1) * sums.shape[2], pa.int32())
        yield pa.record_batch({"size": pa.array(np.full(len(part), size), pa.int32()), "part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(count[part, entry]), "sums": pa.ListArray.from_arrays(ends, flat)})


def encode(written: DataFrame, books: dict[int, np.ndarray], pivots: dict[int, list[np.ndarray]]) -> DataFrame:
    """``vec_id, label, size, code, error`` of rows that :func:`train` wrote."""
    shared = written.sparkSession.sparkContext.broadcast((books, pivots))

    def run(batches):
        books, pivots = shared.value
        for size, some, x in _blocks(batches):
            code, error = _assigned(size, some, x, books[size], pivots[size])
            text = np.ascontiguousarray(code.astype(np.uint8)).tobytes().hex()
            yield pa.record_batch({**{c: some.column(c) for c in ("vec_id", "label", "size")}, "code": pa.array([text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]), "error": pa.array(error.sum(1))})

    kinds = dict(written.dtypes)
    return written.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, size int, code string, error long")


def decode(code: str, books: np.ndarray) -> list[int]:
    """The integer vector that a code stands for."""
    return [int(x) for p in range(PARTS) for x in books[p, int(code[2 * p : 2 * p + 2], 16)]]


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for each row of ``vectors (vec_id, embedding, label)`` that can be coded.

    Rows whose vector is null, or holds null or non-finite components, go. Codebooks
    start from the rows of least vec_id, of equal ones from those of least vector; null
    ids come last, and are coded. Repeated rows each count. Vectors of different
    lengths are coded apart, each length with codebooks of its own; a length that four
    doesn't divide is filled up with zeros, an empty one too. A component so large that a squared distance
    could pass 64 bits (190,000 / sqrt(length / 64), about) counts as the largest
    that can't. Sums of errors beyond 64 bits are null. An empty table gives no rows;
    other columns are ignored.
    """
    written, books, pivots = train(integers(vectors))
    out = materialize(encode(written, books, pivots), "codes")
    of_label = out.groupBy(F.col("label").alias("l")).agg(F.try_sum("error").alias("label_error"))
    sha = F.create_map(*[F.lit(x) for size, b in books.items() for x in (size, digest(b))]) if books else F.create_map(F.lit(0), F.lit(""))
    met = out.join(of_label, F.col("label").eqNullSafe(F.col("l")))
    return met.select("vec_id", "code", "error", "label_error", sha[F.col("size")].alias("codebooks_sha256"))


def _codes_sql(rounds: int = ROUNDS) -> str:
    """DuckDB SQL for :func:`vector_codes` over vectors of one length that four divides."""
    nearest = "a{k} as materialized (select r, p, any_value(x) as x, min({{'d': xx - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'entry': entry}}) as near from parts join b{k} using (p) group by r, p)"
    moved = (
        "s{k} as materialized (select p, near.entry as entry, i, floor(sum(x[i]) / count(*)) as m from a{j}, range(1, (select any_value(len(x)) + 1 from parts)) as places(i) group by p, near.entry, i),\n"
        "b{k} as materialized (select p, entry, coalesce(m, c) as c from b{j} left join (select p, entry, list(m order by i) as m from s{k} group by p, entry) using (p, entry))"
    )
    steps = [nearest.format(k=0)]
    for k in range(1, rounds + 1):
        steps += [moved.format(k=k, j=k - 1), nearest.format(k=k)]
    return f"""
with kept as materialized (select row_number() over (order by vec_id, embedding) as r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cut as (select r, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] as x from kept, range({PARTS}) as t(p)),
parts as materialized (select *, list_inner_product(x, x) as xx from cut),
b0 as materialized (select p, r - 1 as entry, x as c from parts where r <= {ENTRIES}),
{(","+chr(10)).join(steps)},
codes as (select r, string_agg(printf('%02x', near.entry), '' order by p) as code, sum(near.d)::bigint as error from a{rounds} group by r),
books as (select sha256(string_agg(array_to_string(list_transform(c, lambda x: x::bigint), ','), ',' order by p, entry)) as sha from b{rounds})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, sha as codebooks_sha256 from codes join kept using (r), books
"""


CODES_SQL = _codes_sql()
