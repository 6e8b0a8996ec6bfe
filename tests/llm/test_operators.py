"""The ten operators against brute force on small tables, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import embeddings, fingerprints, licenses, line_dedup, lm, mixing, ngram_join, packing, token_counts, toxicity
from newsloom.llm.common import tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n string, block long, sig long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), 0.5, "x", 1, 2) for d, t, s in rows], DOCS)


def sample():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocab, n)) for n in rng.integers(1, 120, 60)]
    out = base + base[:8]  # exact copies
    for t in base[:30]:  # near copies
        w = t.split()
        w[rng.integers(len(w))] = "changed"
        out.append(" ".join(w))
    shared = "this very common boilerplate line stands on many sites"
    out = [f"{shared}\n{t}" if i % 3 == 0 else t for i, t in enumerate(out)]
    out += ["", "   ", "one", "Two words", "a b c d", "ünïcode façade \x1c odd", "x" * 3000, " ".join(vocab * 12), "<|endoftext|> special it's  spaced   out \n\n end ", "idiot moron scum trash", "▁a  b<s>"]
    rows = [(i, t, f"s{i % 7}") for i, t in enumerate(out)]
    return rows + [(1000, None, None), (1001, "null source " * 4, None), (5, rows[5][1], "s5")]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, sample()).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def brute_components(rows, percent=80, k=5):
    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    root = {i: i for i in range(len(sets))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = defaultdict(lambda: math.inf)
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least[find(i)], d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def test_line_dedup_matches_brute_force(docs):
    rows = sample()
    sites = defaultdict(set)
    first = {}
    for d, t, s in rows:
        for x in (t or "").split("\n"):
            if k := x.strip(" \t\r"):
                sites[k].add(s or "")
                first[k] = min(d, first.get(k, d))
    want = []
    for d, t, _ in rows:
        kept, met = [], set()
        for x in t.split("\n") if t is not None else []:
            k = x.strip(" \t\r")
            if not (k and len(sites[k]) >= 5 and not (first[k] == d and k not in met)):
                kept.append(x)
            met.add(k)
        text = "\n".join(kept)
        n = len(t.split("\n")) if t is not None else 0
        want.append((d, n, n - len(kept), len(text), hashlib.sha256(text.encode()).hexdigest()))
    got = sorted(tuple(r) for r in line_dedup.line_digest(docs).collect())
    assert got == sorted(want) and sum(r[2] for r in got) > 20


def test_only_lines_near_the_threshold_are_counted_exactly(docs, monkeypatch):
    lines = line_dedup.places(docs)
    found = {}
    for most in (line_dedup.NEAR, 0):
        monkeypatch.setattr(line_dedup, "NEAR", most)
        out = line_dedup.boilerplate(lines)
        found[most] = sorted(tuple(r) for r in out.collect())
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        if most:  # the semi join lies below the distinct
            assert "LeftSemi" in plan and plan.index("Aggregate [h#") < plan.index("LeftSemi")
    assert found[0] == found[line_dedup.NEAR] and found[0]


def test_line_dedup_keeps_columns_and_clean_documents(docs, none):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    ids = {r["doc_id"] for r in out.collect()}
    assert {r[0] for r in sample()} == ids
    assert line_dedup.dedup_lines(none).count() == 0
    only = docs.sparkSession.createDataFrame([(i, "same line everywhere", f"s{i}") for i in range(8)], "doc_id long, text string, source string")
    assert [r["doc_id"] for r in line_dedup.dedup_lines(only).collect()] == [0]


def test_near_threshold_sites_are_counted_exactly(spark):
    rows = [(100 * n + i, f"line {n}", f"s{i}") for n in range(3, 9) for i in range(n)]
    out = line_dedup.line_digest(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r["doc_id"] // 100 for r in out.where("n_removed > 0").collect()} == {5, 6, 7, 8}


CLASHES = "gone once h i n lines kept key site first row removed blocks block copy node at of gap words rest passes shards sig cells part s a b c e label base text_hash"


def clashing(spark, rows):
    """Documents with an extra column for each helper name that an operator might use."""
    names = [x for x in CLASHES.split() if x not in ("doc_id", "text", "source")]
    df = spark.createDataFrame([(d, t, s, len(t or "")) for d, t, s in rows], "doc_id long, text string, source string, n_chars long")
    return df.select("*", *[F.lit(f"own {x}").alias(x) for x in names])


def test_line_dedup_with_clashing_columns_and_repeated_ids(spark):
    line = "everywhere the same"
    rows = [(i, f"{line}\nown {i}", f"s{i}") for i in range(6)] + [(0, f"other text\n{line}\n{line}", "s9"), (None, f"{line}\nnull id", "s1"), (None, None, None), (7, "\n\n", "s2"), (8, line, "s3")]
    docs = clashing(spark, rows)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and all(r["gone"] == "own gone" and r["row"] == "own row" for r in out.collect())
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    key = {d: docs.where("doc_id = 0").select(F.xxhash64("text").alias("k"), "text").collect() for d in (0,)}[0]
    least = min(key, key=lambda r: r["k"])["text"]  # of the rows of the least id, that of the least text hash has the first occurrence
    zero = ["own 0", f"other text\n{line}"] if least.startswith("other") else [f"{line}\nown 0", "other text"]
    want = [(0, zero[0]), (0, zero[1]), *((i, f"own {i}") for i in range(1, 6)), (None, "null id"), (None, None), (7, "\n\n")]
    assert got == Counter(want)
    assert line_dedup.mark_lines(docs).columns == [*docs.columns, line_dedup.OUT]


def test_line_dedup_of_a_very_long_text(spark):
    long = "\n".join(["shared"] * 200_000 + [f"line {i}" for i in range(300_000)])
    rows = [(i, "shared", f"s{i}") for i in range(6)] + [(9, long, "s9")]
    r = line_dedup.line_digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id = 9").first()
    assert (r["n_lines"], r["n_removed"]) == (500_000, 200_000)


def test_fingerprints(docs, none):
    rows = sorted(((d, t or "") for d, t, _ in sample()))
    got = sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["near_edited"], r["near_next"]) for r in fingerprints.fingerprints(docs, ranges=5).collect())
    want = []
    for i, (d, t) in enumerate(rows):
        n = len(t) // 4
        e = t[: len(t) - n] + rows[(i + 1) % len(rows)][1][:n]
        f, g = (fingerprints.digest(fingerprints.signature(x.encode())) for x in (t, e))
        h = fingerprints.digest(fingerprints.signature(rows[(i + 1) % len(rows)][1].encode()))
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), f, fingerprints.likeness(f, g), fingerprints.likeness(f, h)))
    assert got == sorted(want)
    assert fingerprints.fingerprints(none).count() == 0


def test_fingerprints_estimate_jaccard():
    rng = np.random.default_rng(1)
    w = [f"w{i}" for i in rng.integers(0, 10_000, 600)]
    v = w[:450] + [f"v{i}" for i in range(150)]
    a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, v))
    f, g = (fingerprints.digest(fingerprints.signature(" ".join(x).encode())) for x in (w, v))
    assert abs(fingerprints.likeness(f, g) - len(a & b) / len(a | b)) < 0.15
    assert fingerprints.likeness(f, f) == 1


def test_band_join_finds_copies(docs):
    want = {d: c for d, n, c in brute_components([(d, t) for d, t, _ in sample()]) if n}
    got = {r[0]: r[1] for r in fingerprints.near_duplicates(docs).collect()}
    assert got == want


def test_band_join_links_classes_that_no_pivot_links(spark, monkeypatch):
    """Versions near their twin only, made of variants that many others hold too, so that a third text can be the pivot of every shared band."""
    for name, n in {"SMALL": 2, "OUTSIDE": 8, "BLOCK": 16, "FEW": 1}.items():
        monkeypatch.setattr(ngram_join, name, n)
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(60):
        v = rng.random(200) < 0.12
        twin = v.copy()
        at = rng.choice(200, 12, replace=False)
        twin[at] = ~twin[at]
        for z in (v, twin):
            rows.append((len(rows), " ".join(f"a{i} b{i} c{i} d{i} e{i} {'yes' if x else 'no'}" for i, x in enumerate(z)), "s"))
    got = fingerprints.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(d, c) for d, _, c in brute_components([(d, t) for d, t, _ in rows])]


def brute_kn(train, text):
    """Interpolated modified Kneser-Ney bigrams from plain dictionaries."""
    tok = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["</s>"]
    bi = Counter(p for t in train for p in zip(["<s>"] + tok(t), tok(t), strict=False))
    uni = Counter(w for t in train for w in tok(t))
    cont = Counter(w for _, w in bi)
    d2 = lm.discounts(np.array([sum(c == k for c in bi.values()) for k in (1, 2, 3, 4)]))
    d1 = lm.discounts(np.array([sum(c == k for c in cont.values()) for k in (1, 2, 3, 4)]))
    n, v, total = sum(uni.values()), len(uni), len(bi)
    ctx = defaultdict(list)
    for (u, _), c in bi.items():
        ctx[u].append(c)
    rest = sum(d1[min(c, 3)] for c in cont.values()) / total
    score = base = 0.0
    prev = "<s>"
    for w in tok(text):
        low = max(cont[w] - d1[min(cont[w], 3)], 0) / total + rest / (v + 1)
        s = sum(ctx[prev])
        p = max(bi[prev, w] - d2[min(bi[prev, w], 3)], 0) / s + sum(d2[min(c, 3)] for c in ctx[prev]) / s * low if s else low
        score += math.log10(p)
        base += math.log10((uni[w] + 1) / (n + v + 1))
        prev = w
    return len(tok(text)), sum(uni[w] > 0 for w in tok(text)), n, base, score


def test_kneser_ney_matches_brute_force(docs, none):
    rows = sample()
    fold = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    train = [t for d, t, _ in rows if not fold(d)]
    got = defaultdict(list)
    for r in lm.kneser_ney_scores(docs).collect():
        got[r["doc_id"]].append(r)
    for d, t, _ in rows:
        r = got[d].pop()
        want = brute_kn(train, t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(d), *want[:3])
        assert r["base_score"] == pytest.approx(want[3]) and r["score"] == pytest.approx(want[4])
    assert lm.kneser_ney_scores(none).count() == 0


def test_kneser_ney_sums_to_one():
    train = ["a b a c", "a b b", "c a b a"]
    for context in ("a", "a b", "c b", "unknown"):
        n, _, _, _, whole = brute_kn(train, context)
        end = 10 ** whole
        # the score of "context w" is that of context without its end, times the steps to w and from w to the end
        steps = {w: brute_kn(train, f"{context} {w}")[4] - (brute_kn(train, w)[4] - first_step(train, w)) for w in ("a", "b", "c", "unknown")}
        before = whole - last_step(train, context)
        assert sum(10 ** (s - before) for s in steps.values()) + end / 10**before == pytest.approx(1)


def first_step(train, w):
    """Log10 probability of a word at a text's start: that of the one-word text without its end."""
    return brute_kn(train, w)[4] - last_step(train, w)


def last_step(train, text):
    """Log10 probability of the end after a text's last word."""
    return brute_last(train, text.split()[-1])


def brute_last(train, w):
    tok = lambda t: t.split() + ["</s>"]
    bi = Counter(p for t in train for p in zip(["<s>"] + tok(t), tok(t), strict=False))
    cont = Counter(x for _, x in bi)
    d2 = lm.discounts(np.array([sum(c == k for c in bi.values()) for k in (1, 2, 3, 4)]))
    d1 = lm.discounts(np.array([sum(c == k for c in cont.values()) for k in (1, 2, 3, 4)]))
    v, total, c = len(cont), len(bi), [n for (u, _), n in bi.items() if u == w]
    low = max(cont["</s>"] - d1[min(cont["</s>"], 3)], 0) / total + sum(d1[min(x, 3)] for x in cont.values()) / total / (v + 1)
    return math.log10(max(bi[w, "</s>"] - d2[min(bi[w, "</s>"], 3)], 0) / sum(c) + sum(d2[min(x, 3)] for x in c) / sum(c) * low if c else low)


def brute_license(text, least=0.8):
    parts = [p for s in re.split(r"\n|(?<=[.!?;:]) ", text or "") if (p := licenses.normal_words(s.encode()))]
    out = {}
    for name, t in licenses.TEMPLATES.items():
        want = licenses.bigrams(licenses.normal_words(t.encode()))
        best = max((licenses.dice(licenses.bigrams(sum(parts[i : j + 1], [])), want) for i in range(len(parts)) for j in range(i, len(parts))), default=0)
        if best >= least:
            out[name] = best
    return out


def test_license_scans(spark, docs, none):
    t = licenses.TEMPLATES
    rows = [(0, t["MIT"]), (1, f"Intro text here. {t['Apache-2.0']} And more."), (2, "a\n" + t["BSD-3-Clause"].replace("COPYRIGHT HOLDER", "REGENTS") + "\nb"), (3, t["GPL-3.0 line"] + "\n" + t["MIT line"]), (4, None), (5, ""), (6, "nothing of the kind"), (7, t["ISC"][: len(t["ISC"]) // 3]), (8, "LICENSED under the apache licence version 2.0"), (9, "Some words. All rights reserved.")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for (d, text), r in zip(rows, sorted(got), strict=True):
        want = brute_license(text)
        assert r["licenses"] == "; ".join(sorted(want)), d
        assert r["dice"] == pytest.approx(max(want.values(), default=0))
    assert [r["license"] for r in sorted(got)][:3] == ["MIT", "Apache-2.0", "BSD-3-Clause"]
    assert licenses.scan_licenses(none).count() == 0
    assert licenses.scan_licenses(docs).count() == docs.count()


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    near = x[:80] + rng.normal(size=(80, 16)) * 0.1
    hub = x[0] + rng.normal(size=(120, 16)) * 0.05
    rows = [(i, [float(f) for f in v], i % 3 if i < 300 else 0) for i, v in enumerate(np.concatenate([x, near, hub, x[:40]]))]
    rows = [(i, v, 0 if i < 380 else k) for i, v, k in rows]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [math.nan] * 16, 0), (903, [None, *[1.0] * 15], 0), (904, rows[0][1], None), (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0), (907, [], 0), (908, [math.inf] * 16, 0)]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows + odd], "vec_id long, embedding array<double>, label int, key string, n int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    v = {i: np.array(e) for i, e, k in rows + odd if k is not None and e and None not in e and np.isfinite(e).all() and np.any(e)}
    label = {i: k for i, _, k in rows + odd}
    root = {i: i for i, _, _ in rows + odd}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = Counter()
    for a in v:
        for b in v:
            if a < b and label[a] == label[b] and len(v[a]) == len(v[b]) and v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]) >= 0.98:
                links.update((a, b))
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert sum(r["n_links"] for r in got.values()) >= 0.98 * sum(links.values()) > 1000
    assert all(r["n_links"] <= links[i] for i, r in got.items())
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i in root}
    assert embeddings.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_embeddings_of_any_finite_size(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1.0, 1.0], 0), (3, [1e-200, 1e-200], 0), (4, [5e-324, 0.0], 0), (5, [1e308, 0.0], 0), (6, [-1e200, 1e-200], 0), (None, [2.0, 2.0], 0), (None, [0.0, -3.0], 0), (5, [7.0, 0.0], 0), (5, [0.0, 1e-300], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r["vec_id"] or -1, r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 3, 1), (2, 3, 1), (3, 3, 1), (-1, 3, 1), (4, 2, 4), (5, 2, 4), (5, 2, 4), (6, 0, 6), (-1, 0, None), (5, 0, 5)], key=str)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_small_groups_are_found_beside_a_hot_one(spark, kind):
    rng = np.random.default_rng(17)
    hot = rng.normal(size=32) + 0.05 * rng.normal(size=(700, 32))
    small = rng.normal(size=(900, 32))
    twin = small / np.linalg.norm(small, axis=1, keepdims=True)
    side = rng.normal(size=twin.shape)
    side -= (side * twin).sum(1, keepdims=True) * twin
    twin = 0.9815 * twin + (1 - 0.9815**2) ** 0.5 * side / np.linalg.norm(side, axis=1, keepdims=True)  # just above the threshold
    x = np.concatenate([hot, small, twin]).astype(np.float32 if kind == "float" else np.float64)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>, label int").repartition(4)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.98).sum(1) - 1
    assert (links[700:] >= 1).all()
    got = np.array([r["n_links"] for r in embeddings.near_duplicates(df).orderBy("vec_id").collect()])
    assert (got <= links).all()
    assert got[700:].sum() >= 0.999 * links[700:].sum() and got[:700].sum() >= 0.999 * links[:700].sum()


def test_the_search_radius_does_not_follow_the_hot_group():
    rng = np.random.default_rng(3)
    x = embeddings.unit(rng.normal(size=(1500, 32)))
    hot = embeddings.unit(x[0] + 0.01 * rng.normal(size=(1500, 32)))
    radii = []
    for extra in (0, 20, 1500):
        all_ = np.concatenate([x, hot[:extra]])
        books = embeddings.kmeans(x[:, :16], 8), embeddings.kmeans(x[:, 16:], 8)
        radii.append(embeddings.stop_radius(all_, np.zeros(len(all_)), books, 0.98))
    assert max(radii) < 1.3 * min(radii) < 0.04


def test_token_counts_match_the_library(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    want = sorted((d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for d, t, _ in sample())
    assert sorted(tuple(r) for r in token_counts.count_tokens(docs, tokenizer("piece_bpe_32k.model")).collect()) == want
    assert token_counts.count_tokens(none, tokenizer("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("text", ["a ", " a", "  ", "a  b   c", "▁▁a b", "\n\n", "\t x", "é ü", "a　b", "<s> </s> <unk>", "x" * 500 + " y"])
def test_pre_tokens_add_up(text):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    length = token_counts.Lengths(sp, {})
    assert sum(length[p] for p in token_counts.pre_tokens(text.encode())) == len(sp.encode(text))


def test_jaccard_join_matches_brute_force(docs, none):
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(docs).collect())
    assert got == brute_components([(d, t) for d, t, _ in sample()])
    assert ngram_join.jaccard_components(none).count() == 0


def test_a_null_id_among_copies_keeps_their_links(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (7, text), (8, text + " end"), (9, "another text"), (None, "a text of no id"), (4, ""), (None, None)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter([(None, 7), (7, 7), (8, 7), (9, 9), (None, None), (4, 4), (None, None)])


def test_jaccard_join_of_large_groups(spark, monkeypatch):
    """Groups above the all-pairs size: a hub of near copies, and sets that share a part without linking to the pivot."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(1 + i % 4):
            w[rng.integers(60)] = f"x{rng.integers(10**6)}"
        if i >= 60:
            w = base[:45] + [f"y{i // 2}-{j}" for j in range(15)]
        rows.append((i, " ".join(w)))
    for hot in (0, 1000):
        monkeypatch.setattr(ngram_join, "HOT", hot or 1)
        monkeypatch.setattr(ngram_join, "SMALL", 3)
        got = sorted(tuple(r) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == brute_components(rows)


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken")).collect()
    ids = {d: np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for d, t, _ in sample()}
    own = defaultdict(list)
    for r in rows:
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        own[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    copies = Counter(d for d, _, _ in sample())
    for d, x in ids.items():
        p = sorted(own[d])[:: copies[d]]
        assert [a for a, _, _ in p] == list(range(len(p)))
        assert sum(n for _, _, n in p) == len(x) and all(n == 1024 for _, _, n in p[1:]) and len(p) == -(-len(x) // 1024)
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= -(-sum(r["length"] for r in rows) // 1024) + 1
    assert packing.pack_documents(none, tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken")).count() == 0


def test_packing_meets_its_bounds(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(1, 1025, 3000)
    b, at, fill = packing.best_fit_decreasing(x, 1024)
    assert fill.max() <= 1024 and np.bincount(b, x).astype(int).tolist() == fill.tolist()
    assert packing.lower_bound(x, 1024) <= len(fill)
    assert packing.lower_bound(np.full(10, 600), 1024) == 10
    assert math.ceil(packing.lower_bound(np.full(9, 342), 1024)) == 5
    items = spark.createDataFrame([(i, 0, 0, int(n), 1) for i, n in enumerate(x)], packing.PIECES)
    out = packing.pack(items, group=200)
    assert out.count() == len(x) and out.select("sequence_id").distinct().count() <= 1.01 * packing.lower_bound(x, 1024) + 1


def test_very_long_texts(spark):
    """One text of some 400,000 words, and one without any white space, beside short ones."""
    rng = np.random.default_rng(6)
    long = " ".join(f"word{i}" if i % 3 else "trash can, idiot." for i in rng.integers(0, 50_000, 300_000))
    rows = [(1, long), (2, "a short text of seven words here"), (3, "z" * 1_000_000), (4, long + " and a little more")]
    docs = spark.createDataFrame([(d, t, f"s{d}") for d, t in rows], "doc_id long, text string, source string")
    n = {d: len(WORD.findall(t)) for d, t in rows}
    got = {r["doc_id"]: r for r in ngram_join.jaccard_components(docs).collect()}
    assert got[1]["component_id"] == got[4]["component_id"] == 1 and got[3]["component_id"] == 3
    scored = {r["doc_id"]: r for r in lm.kneser_ney_scores(docs).collect()}
    assert all(scored[d]["n_tokens"] == n[d] + 1 for d in n)
    tox = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, docs.selectExpr("doc_id", "1 as toxic").where("false")).collect()}
    assert tox[1] > tox[3]
    size = {r["doc_id"]: r["size"] for r in mixing.mix_digest(docs).collect()}
    assert size == n
    packed = packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("length").alias("most")).collect()
    assert all(r["most"] <= 1024 for r in packed) and len(packed) == 4
    tokens = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, tokenizer("piece_bpe_32k.model")).collect()}
    assert tokens[1] > n[1] and tokens[3] > 1000
    prints = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    assert prints[1]["n_chars"] == len(long) and prints[3]["n_chars"] == 1_000_000
    assert licenses.scan_licenses(docs).where("license is not null").count() == 0
    assert line_dedup.line_digest(docs).agg(F.sum("n_lines")).first()[0] == 4


def test_packing_ids_equal_the_tokenizer():
    import random

    e = packing.encoder(tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"))
    rng = random.Random(5)
    parts = [*"aabbCé1,.;!?'-", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", *"\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2009\u200b\u2028\u3000\u0301\x00…", packing.SPECIAL, "it's", "we'll", "word,", "日本", "🙂", "x,y."]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(25_000)]
    texts += ["a \x1eb", "b\xa0b\n\xa0", "1\t1\n\xa0", "x" * 100_000, "ab " * 50_000, "日本" * 30_000]
    for t in texts:
        assert np.frombuffer(e.ids(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t[:50]


def test_packing_tells_gaps_and_certificates(spark):
    items = spark.createDataFrame([(i, 0, 0, n, 1) for i, n in enumerate([600] * 5 + [424] * 4 + [1024, 3])], packing.PIECES)
    rows = packing.pack(items).collect()
    fill = defaultdict(int)
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    assert len(fill) == 6 and all(r["gap"] == 1024 - fill[r["sequence_id"]] and r["certified"] for r in rows)
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 0, 1025, 1)], packing.PIECES))


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(4)
    vocab = [f"word{i}" for i in range(300)]
    bad = ["idiot", "scum", "moron", "zorkling", "zorkler", "blemp"]
    rows = []
    for i in range(800):
        w = list(rng.choice(vocab, 40))
        if i % 5 == 0:
            for b in rng.choice(bad, 3):
                w[rng.integers(40)] = b
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    rows += [(9000, "you 1d10t and mоrоn, what scüm", 1), (9002, None, 0), (9003, "", 0), (9004, "the trash can and the clown fish", 0)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t, _ in rows], "doc_id long, text string, toxic string, predicted int")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows if d < 9000] + [(1, None), (None, 1), (5, 1), (2, 7)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity_scores(df, labels).collect()}
    hit = [d for d, _, y in rows if out[d]["predicted"] == y]
    assert len(hit) >= 0.97 * len(rows) and {9000, 9002, 9003, 9004} <= set(hit)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in out.items())
    assert toxicity.toxicity_scores(none, labels).count() == 0
    assert toxicity.toxicity_scores(docs, labels.where("false")).count() == docs.count()


def brute_fold(text):
    """Skeleton of a text, letter by letter."""
    import unicodedata

    out = []
    for c in text:
        if unicodedata.category(c) in ("Cf", "Mn"):
            continue
        if c.lower() in toxicity.LOOKALIKES:
            plain = toxicity.LOOKALIKES[c.lower()]
        else:
            plain = ""
            for x in unicodedata.normalize("NFKD", c).lower():
                if unicodedata.category(x) != "Mn":
                    plain += toxicity.LOOKALIKES.get(x, x)
        new = ""
        for x in plain:
            new += "i" if x in ("l", "j") else x if x.isalnum() else " "
        out.append(new or " ")
    return " " + " ".join("".join(out).split()) + " "


def brute_score(model, text):
    """The score by trying each term and phrase at each place."""
    folded = brute_fold(text)
    spans = []
    for phrase in map(brute_fold, toxicity.EXCEPTIONS):
        spans += [(i, i + len(phrase) - 1) for i in range(len(folded)) if folded[i : i + len(phrase)] == phrase]
    best = {}
    for term, w in model.weights.items():
        for i in range(len(folded)):
            if folded[i : i + len(term)] == term:
                best[i] = max(w, best.get(i, -math.inf))
    total = 0.0
    for i, w in best.items():
        if not any(a <= i < b for a, b in spans):
            total += w
    by_length = total / math.log2(8 + folded.count(" "))
    z = model.coef[0] + model.coef[1] * math.log1p(total) + model.coef[2] * math.log1p(by_length)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_toxicity_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    vocab = [f"word{i}" for i in range(60)] + ["ünïcode", "Ωmega", "l1l", "trash", "can", "clown", "fish", "stupid", "question"]
    bad = ["idiot", "scum", "zorkling", "zorkler", "blempish"]
    rows = [(i, " ".join([*rng.choice(vocab, 12), *(rng.choice(bad, 2) if i % 4 == 0 else [])]), int(i % 4 == 0)) for i in range(240)]
    odd = ["1d10t ID\u200bIOT m\u043er\u043en sc\u00fcm", "the trash can, trash; can TRASH", "clown fish clown", "zorklings zork zorkle", "", None, "  \n ", "!!!", "idiotidiot scumscum", "stupid question stupid", "s7upid 5cum", "x" * 5000 + " scum"]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int"))
    assert any("zork" in t for t in model.weights) and all(f == brute_fold(t) for t in odd if t for f in [toxicity.fold(t)])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == pytest.approx(brute_score(model, r["text"] or ""), abs=1e-12)
    # learned terms and their log odds, counted plainly
    pos, neg = Counter(), Counter()
    kept = {}
    for d, t, y in rows:
        kept.setdefault((y, t), d)
    for y, t in kept:
        (pos if y else neg).update(toxicity.terms_of(toxicity.fold(t)))
    n_pos, n_neg = sum(y for y, _ in kept), sum(1 - y for y, _ in kept)
    tested = {t: n for t, n in pos.items() if n >= toxicity.LEAST_DOCS}
    up = sorted((math.floor(2 * toxicity.surprise(n, neg[t], n_pos, n_neg)) / 2 for t, n in tested.items() if (n + 0.5) / (n_pos + 1) > (neg[t] + 0.5) / (n_neg + 1)), reverse=True)
    least = min(g for g in up if math.erfc(math.sqrt(g / 2)) / 2 * len(tested) <= toxicity.BY_CHANCE * sum(x >= g for x in up))
    want = toxicity.choose(tested, neg, n_pos, n_neg, least)
    assert {t: w for t, w in model.weights.items() if t in want} == {t: pytest.approx(w) for t, w in want.items()}


def brute_targets(sizes):
    """Resharing the excess by weight until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return out


def test_mixing(spark, docs, none):
    got = mixing.mix_digest(docs).collect()
    again = mixing.mix_digest(docs.repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    rows = sample()
    size = lambda t: len(WORD.findall(t or ""))
    per = defaultdict(int)
    for _, t, s in rows:
        per[s] += size(t)
    want = brute_targets(per)
    source = {d: s for d, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == per[source[r["doc_id"]]] and r["target"] == pytest.approx(want[source[r["doc_id"]]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((d, size(t)) for d, t, _ in rows)
    for s, n in taken.items():
        assert abs(n - want[s]) <= 0.02 * want[s] + 20
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    copies = Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    assert copies == Counter({r["doc_id"]: n for r in got if (n := r["copies"])} | {5: 2 * next(r["copies"] for r in got if r["doc_id"] == 5)}) - Counter()
    assert mixing.mix_digest(none).count() == 0


def test_mixing_fills_the_rest_past_one_long_document(spark, monkeypatch):
    names = "abcdefghij"
    monkeypatch.setattr(mixing, "BLOCKS", 9 * len(names))
    monkeypatch.setattr(mixing, "targets", lambda s: spark.createDataFrame([(x, 2001, 30_000, 19_000.0) for x in names], "source string, docs long, source_size long, target double"))
    rows = [(10_000 * k + i, x, 10 if i else 10_000) for k, x in enumerate(names) for i in range(2001)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.draws(sizes, sizes).groupBy("source").agg(F.sum(F.col("size") * F.size("__shards")).alias("n")).collect()
    assert [r["n"] for r in got] == [19_000] * len(names)


def test_mixing_meets_targets_of_small_sources(spark):
    rng = np.random.default_rng(11)
    rows, d = [], 0
    for k in range(24):  # sources of 1 to 20 documents, half of them with one giant
        for j in range(int(rng.integers(1, 21))):
            n = int(rng.integers(1, 80)) if j or k % 2 else 3000
            rows.append((d, " ".join(f"w{d}x{i}" for i in range(n)), f"s{k:02d}"))
            d += 1
    rows += [(None, "a null id", "s00"), (None, "another null id", "s00"), (3, "the same id once more", "s05"), (d, None, "s07"), (d + 1, "", None)]
    docs = clashing(spark, rows)
    got = mixing.mix_digest(docs).collect()
    per = defaultdict(int)
    for _, t, s in rows:
        per[s] += len((t or "").split())
    want, taken = brute_targets(per), defaultdict(int)
    source = {len(t.split()): None for _, t, _ in rows if t}  # sizes alone don't tell sources; targets do
    assert len(got) == len(rows) and source
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["copies"] == len(r["shards"])
        taken[round(r["target"], 6), r["source_size"]] += r["taken"]
    for (target, _), n in taken.items():
        assert abs(n - target) <= 0.005 * target + 1 or sum(abs(want[s] - target) < 1e-6 for s in want) > 1
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    words = defaultdict(int)
    whole = {(d, t) for d, t, _ in rows}
    cut = 0
    for r in mix.collect():
        assert r["blocks"] == "own blocks" and r["n_chars"] == len(r["text"] or "")
        words[r["source"]] += len((r["text"] or "").split())
        cut += (r["doc_id"], r["text"]) not in whole
    assert all(abs(words[s] - want[s]) <= 0.005 * want[s] + 1 for s in want)
    assert cut <= len(per)


def test_mixing_water_fills(spark):
    sizes = {"a": 5, "b": 1000, "c": 300, "d": 7, "e": 90, None: 40}
    df = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "doc_id long, source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == {s: pytest.approx(t) for s, t in brute_targets(sizes).items()}


def test_blocks_and_shards_follow_the_words(docs, monkeypatch):
    assert mixing.extent(0) == mixing.extent(10**9) == (mixing.BLOCKS, mixing.LEVELS)
    blocks, levels = mixing.extent(16 * 10**12)  # some 100 TB
    assert 16 * 10**12 / blocks <= mixing.BLOCK_WORDS and mixing.SHARD_WORDS / 2 < 16 * 10**12 / 2**levels <= mixing.SHARD_WORDS
    monkeypatch.setattr(mixing, "SHARD_WORDS", 30)
    shards = [s for r in mixing.mix_digest(docs).collect() for s in r["shards"]]
    assert max(shards) >= 64 and len(set(shards)) > 32

def test_splitting_tree_meets_every_quota(spark):
    sizes = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"), (F.lit(1) + F.col("id") % 9).cast("long").alias("size"))
    _, units, _, _ = mixing.plan(sizes)
    shards = Counter(s for r in units.collect() for s in r["shards"])
    assert set(shards) <= set(range(16)) and max(shards.values()) - min(shards.values()) <= 4
