"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts, accented letters and
digits that stand for letters to one skeleton, and turns the rest into single
spaces. The lexicon starts from a short built-in list and learns words and word
stems with their log odds from labelled documents. Hits inside exception phrases
don't count. A logistic function of the summed weights, plain and by length, gives
the score.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import HASHES, shingles, slices, texts
from newsloom.llm.lm import crc
from newsloom.session import ship

#: Labelled rows that the lexicon and the logistic function are fitted on at most (about, chosen by hash of the id).
FIT_ROWS = 20_000
#: Least documents and log odds of a learned term, share of terms learned by chance, lengths of stems, weight of a built-in term that isn't learned.
LEAST_DOCS, LEAST_ODDS, BY_CHANCE, STEMS, PRIOR = 3, 2.0, 0.001, (4, 5, 6, 7), 3.0
THRESHOLD = 0.3

# Built-in terms, phrases that excuse the terms in them, and letters and digits that stand for Latin letters.
SEEDS = "idiot idiots moron morons stupid loser losers scum worthless pathetic disgusting trash clown imbecile dumbass bastard arschloch wichser abschaum idiota imbecil basura escoria connard salaud ordure abruti"
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "clown fish", "circus clown", "stupid question", "idiot proof", "pathetic fallacy", "pond scum")
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ı": "i", "ɑ": "a", "ɡ": "g", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
    "0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "l", "€": "e", "£": "l",
}


class _Fold(dict):
    """Code point to its skeleton; i, l, j and 1 look alike and become i."""

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        if unicodedata.category(c) in ("Cf", "Mn"):  # joiners, marks
            out = ""
        else:
            plain = "".join(LOOKALIKES.get(x, x) for x in unicodedata.normalize("NFKD", c).lower() if unicodedata.category(x) != "Mn")
            plain = LOOKALIKES.get(c.lower(), plain)
            out = "".join("i" if x in "lj" else x if x.isalnum() else " " for x in plain) or " "
        self[cp] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """Folded words with a space before, between and after them."""
    return f" {' '.join(text.translate(_FOLD).split())} "


def terms_of(folded: str) -> set[str]:
    """Words as ``" word "``, stems of longer words as ``" stem"``."""
    out = set()
    for w in set(folded.split()):
        if 3 <= len(w) <= 30:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in STEMS if len(w) > k)
    return out


@dataclass
class Model:
    """Terms with weights, and the coefficients of (1, sum, sum by length)."""

    weights: dict[str, float]
    coef: np.ndarray

    def matcher(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for t, w in self.weights.items():
            a.add_word(t, (len(t), w))
        for p in EXCEPTIONS:
            a.add_word(p := fold(p), (len(p), None))
        a.make_automaton()
        return a


def sums(matcher: ahocorasick.Automaton, text: str) -> tuple[float, float]:
    """Summed weights of hit words, each by its heaviest term and none inside an exception phrase; and the same by length."""
    folded = fold(text)
    hits: dict[int, float] = {}
    excused: set[int] = set()
    for end, (size, w) in matcher.iter(folded):
        start = end - size + 1
        if w is None:
            excused.update(range(start, end))
        else:
            hits[start] = max(w, hits.get(start, w))
    total = sum(w for at, w in hits.items() if at not in excused)
    return total, total / np.log2(8 + folded.count(" "))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Coefficients of a ridge logistic regression by Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
        step = np.linalg.solve(h, x.T @ (p - y) / len(x) + ridge * w * np.array([1e-3] + [1.0] * (x.shape[1] - 1)))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def surprise(pos: int, neg: int, n_pos: int, n_neg: int) -> float:
    """Log-likelihood ratio (G) of the documents that hold a term, against the share of toxic ones."""
    all_, n = pos + neg, n_pos + n_neg
    return 2 * sum(k * float(np.log(k * n / (all_ * m))) for k, m in ((pos, n_pos), (neg, n_neg)) if k)


def log_odds(n_pos: int, n_neg: int) -> Column:
    """Log odds of a row ``(pos, neg)``, as :func:`choose` takes them."""
    return F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))


def surprise_of(n_pos: int, n_neg: int) -> Column:
    """:func:`surprise` of a row ``(pos, neg)``."""
    share = (F.col("pos") + F.col("neg")) / (n_pos + n_neg)
    part = lambda k, m: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (share * m))).otherwise(0.0)
    return 2 * (part("pos", n_pos) + part("neg", max(n_neg, 1)))


def least_surprise(counts: dict[float, int], tested: int, by_chance: float = BY_CHANCE) -> float:
    """The log-likelihood ratio from which terms are learned: of the ``tested`` terms so many reach it (``counts`` by value, of terms likelier in toxic documents) that at most the share ``by_chance`` of them is expected to do so by chance (Benjamini and Hochberg)."""
    least, reached = float("inf"), 0
    for g in sorted(counts, reverse=True):
        reached += counts[g]
        if 0.5 * math.erfc(math.sqrt(max(g, 0.0) / 2)) <= by_chance * reached / tested:
            least = g
    return least


def choose(pos: dict[str, int], neg: dict[str, int], n_pos: int, n_neg: int, least: float) -> dict[str, float]:
    """Terms of a log-likelihood ratio of ``least`` and their log odds, most telling first: a term goes if a kept stem begins it, or if a kept longer term explains nearly all of its documents."""
    kept: dict[str, float] = {}
    covered: dict[str, int] = {}
    g = {t: surprise(n, neg.get(t, 0), n_pos, n_neg) for t, n in pos.items()}
    for t in sorted(pos, key=lambda x: (-g[x], -len(x), x)):
        n, odds = pos[t], float(np.log((pos[t] + 0.5) / (n_pos + 1)) - np.log((neg.get(t, 0) + 0.5) / (n_neg + 1)))
        if odds < LEAST_ODDS or g[t] < least or any(t[:k] in kept for k in range(4, len(t))) or n <= 1.1 * covered.get(t, 0):
            continue
        kept[t] = odds
        for k in range(4, len(t)):
            covered[t[:k]] = max(covered.get(t[:k], 0), n)
    return kept


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn from about ``rows`` of ``labels (doc_id, toxic)``, chosen by hash of the id, or from all where there are fewer; near copies count once.

    ``rows`` is the one bound: the lexicon has every term of their texts that is
    telling enough. With no usable labels the built-in terms and fixed coefficients
    remain.
    """
    spark = docs.sparkSession
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    step = -(-max(1, own.count()) // rows)
    drawn = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)

    def keys(batches):  # three min-hashes by which near copies meet
        salt = np.array([0, 0x5851F42D4C957F2D, 0x14057B7EF767814F], np.uint64)[:, None]
        for b in slices(batches):
            m = [((s ^ salt) * np.uint64(0x9E3779B97F4A7C15)).min(1).view(np.int64) if len(s := shingles(t.encode(), HASHES)) else np.zeros(3, np.int64) for t in b.column(1).to_pylist()]
            m = np.array(m).reshape(-1, 3)
            yield pa.record_batch({"doc_id": b.column(0), "text": b.column(1), "toxic": b.column(2), **{f"m{i}": pa.array(np.ascontiguousarray(m[:, i])) for i in range(3)}})

    once = texts(docs).join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic").mapInArrow(keys, "doc_id long, text string, toxic int, m0 long, m1 long, m2 long")
    for k in range(3):
        once = once.groupBy(f"m{k}", "toxic").agg(F.min_by(F.struct("doc_id", "text", *[f"m{i}" for i in range(3) if i != k]), "doc_id").alias("r")).select("r.*", "toxic", f"m{k}")
    once = once.select("text", "toxic").persist()
    n = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count("*").alias("n")).collect()}

    def counted(batches):
        seen: dict[str, list[int]] = {}
        for b in slices(batches):
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for x in terms_of(fold(t)):
                    seen.setdefault(x, [0, 0])[y] += 1
        yield pa.record_batch({"t": pa.array(list(seen), pa.string()), "neg": pa.array([v[0] for v in seen.values()], pa.int64()), "pos": pa.array([v[1] for v in seen.values()], pa.int64())})

    learned: dict[str, float] = {}
    if n_pos := n.get(1, 0):
        n_neg = n.get(0, 0)
        terms = once.mapInArrow(counted, "t string, neg long, pos long").groupBy("t").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") >= LEAST_DOCS).withColumn("g", surprise_of(n_pos, n_neg)).persist()
        binned = terms.groupBy((F.floor(F.col("g") * 2) / 2).alias("g")).agg(F.count("*").alias("n"), F.count_if(log_odds(n_pos, n_neg) > 0).alias("up")).collect()
        least = least_surprise({r["g"]: r["up"] for r in binned}, sum(r["n"] for r in binned))
        some = {r["t"]: (r["pos"], r["neg"]) for r in terms.where((log_odds(n_pos, n_neg) >= LEAST_ODDS) & (F.col("g") >= least)).toLocalIterator()}
        terms.unpersist()
        learned = choose({t: v[0] for t, v in some.items()}, {t: v[1] for t, v in some.items()}, n_pos, n_neg, least)
    weights = {f" {fold(s).strip()} ": PRIOR for s in SEEDS.split()} | learned
    model = Model(weights, np.array([-3.0, 0.5, 1.0]))

    def features(batches):
        m = model.matcher()
        for b in slices(batches):
            s = np.array([sums(m, t) for t in b.column(0).to_pylist()]).reshape(-1, 2)
            yield pa.record_batch({"s": pa.array(np.ascontiguousarray(s[:, 0])), "d": pa.array(np.ascontiguousarray(s[:, 1])), "y": b.column(1)})

    if min(n.get(0, 0), n.get(1, 0)):
        f = np.array([tuple(r) for r in once.mapInArrow(features, "s double, d double, y int").toLocalIterator()])
        model.coef = logistic(np.log1p(f[:, :2]), f[:, 2])
    once.unpersist()
    return model


def scorer(model: Model):
    """Texts to scores between 0 and 1."""
    matcher = model.matcher()

    def run(batch: list[str | None]) -> np.ndarray:
        s = np.array([sums(matcher, t or "") for t in batch]).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(s)), np.log1p(s)] @ model.coef, -30, 30)))

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of each row of ``docs (doc_id, text)``; a null text is empty and scores like a text without hits."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        f = scorer(shared.value)
        for b in slices(batches):
            s = f(b.column(1).to_pylist())
            yield pa.record_batch({"doc_id": b.column(0), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with the columns they have."""
    ship(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        f = scorer(shared.value)
        for b in slices(batches):
            yield b.filter(pa.array(f(b.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(folds: int = 4, fold_: int = 2):
    return F.pmod(crc(), F.lit(folds)) == fold_


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``, learned from labels outside the held-out fold only.

    A null or empty text has no hits; null ids and repeated rows are scored like
    others; a text of any length is matched whole; labels that are null or not 0 or 1
    aren't used, and of labels that disagree on an id the toxic one counts; an empty
    table gives no rows; other columns, whatever their names, are ignored.
    """
    model = fit(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
