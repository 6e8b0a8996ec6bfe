"""Vector codes, conversation repair and secret scans against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import conversations, secrets, vector_codes

VECTORS = "vec_id long, embedding array<double>, label int, code string, size int, v string, own int"
TALK = "conv_id long, turn long, role string, text string, copies int, h string, task int, whole string"
DOCS = "doc_id long, text string, kind string, value string, n int, base string, spans string"


# vector codes


def vectors():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 8))
    rows = [(i, (centres[i % 40] + rng.normal(scale=0.2, size=8)).tolist(), int(i % 5) if i % 7 else None) for i in range(700)]
    rows += [(3, rows[3][1], 1), (3, rows[9][1], 1), (None, rows[5][1], 2), (None, None, 2), (800, None, 1), (801, [1.0] * 7 + [None], 1), (802, [1.0] * 7 + [math.nan], 1), (803, [math.inf] + [0.0] * 7, 1)]
    rows += [(1000 + i, [0.25 * (i % 3)] * 8, 4) for i in range(20)]
    return rows


def brute_codes(rows, entries=256, rounds=4):
    kept = [(i, [math.floor(x * 1024) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 4
    parts = [[r[1][p * w : p * w + w] for r in kept] for p in range(4)]
    books = [[list(x) for x in parts[p][:entries]] for p in range(4)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(books[p])) for x in parts[p]] for p in range(4)]

    for _ in range(rounds):
        for p, found in enumerate(assign()):
            groups = defaultdict(list)
            for x, (_, k) in zip(parts[p], found):
                groups[k].append(x)
            for k, xs in groups.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    found = assign()
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    error = [sum(found[p][i][0] for p in range(4)) for i in range(len(kept))]
    of = Counter()
    for (_, _, y), e in zip(kept, error):
        of[y] += e
    return Counter((r[0], "".join(f"{found[p][i][1]:02x}" for p in range(4)), error[i], of[r[2]], sha) for i, r in enumerate(kept))


def test_vector_codes_match_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], VECTORS).repartition(3)
    assert Counter(tuple(r) for r in vector_codes.vector_codes(df).collect()) == brute_codes(rows)


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in vectors()[:5]], VECTORS)
    assert Counter(tuple(r) for r in vector_codes.vector_codes(df).collect()) == brute_codes(vectors()[:5])
    assert vector_codes.vector_codes(df.where("false")).collect() == []
    assert vector_codes.vector_codes(df.where("vec_id is null or embedding is null")).collect() == []


def test_lengths_that_differ_and_large_components(spark):
    rows = [(1, [1.0] * 8, 1), (2, [2.0] * 6, 1), (3, [], 1), (4, [1e200, -1e200, 1e-200, 3e38, 0.0, 0.0, 0.0, 0.0], None), (5, [0.5] * 6, 1)]
    out = {r["vec_id"]: r for r in vector_codes.vector_codes(spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], VECTORS)).collect()}
    assert {k: r["error"] for k, r in out.items()} == dict.fromkeys(range(1, 6), 0)  # each is an entry of its length's codebooks
    assert len({r["codebooks_sha256"] for r in out.values()}) == 3
    assert out[2]["code"] == "00000000" and out[5]["code"] == "01010100"  # the last part is filled up


def test_assignment_is_exact_and_pivots_rule_entries_out():
    rng = np.random.default_rng(2)
    for spread, scale in ((30, 1000), (1, 10**8), (5, 3)):  # well apart, huge, many ties
        centres = rng.integers(-scale * spread, scale * spread + 1, (64, 6))
        x = (centres[rng.integers(0, 64, 3000)] + rng.integers(-scale // 3, scale // 3 + 1, (3000, 6))).astype(np.int64)
        entries = centres.astype(np.int64)
        pivots = vector_codes.choose_pivots(entries)
        at, best, evaluated = vector_codes.assign(x, vector_codes.to_pivots(x, pivots), entries, pivots)
        d = ((x[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
        assert best.tolist() == d.min(1).tolist()
        assert at.tolist() == [int(np.flatnonzero(r == r.min())[0]) for r in d]
        if spread == 30:
            assert evaluated < 0.2 * d.size


def test_decoding_gives_the_entries(spark):
    written, books, pivots = vector_codes.train(vector_codes.integers(spark.createDataFrame([(*r, "x", 1, "y", 2) for r in vectors()], VECTORS)))
    rows = vector_codes.encode(written, books, pivots).join(written.select("vec_id", "v"), "vec_id").where("vec_id between 10 and 60").collect()
    assert rows and all(sum((a - b) ** 2 for a, b in zip(vector_codes.decode(r["code"], books[8]), r["v"])) == r["error"] for r in rows)


# conversations


def brute_conversations(rows):
    """Damage, faults and the least (cost, audit) by a plain dynamic program over rows and states, audits and texts carried whole."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, hit = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        role = "user" if hit == 4 else role
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        by[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(hit, 1)
    out = set()
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    full = {"u": "user", "a": "assistant"}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        turns = {t for t, _, _ in own if t is not None}
        counts, seen, faults = Counter(), set(), []
        for _, role, text in own:
            held = text.strip(" \t\n\v\f\r")
            fault = "blank" if not held else "duplicate" if (role, text) in seen else "truncated" if held[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            counts[fault] += 1
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        best = {0: (0, "", ())}

        def put(table, state, value):
            if state not in table or value < table[state]:
                table[state] = value

        def inserted(table):
            for _ in range(3):
                for q, (c, a, t) in list(table.items()):
                    for letter, to in step[q].items():
                        if letter in full:
                            put(table, to, (c + 5, a + "I", (*t, full[letter] + ":")))
            return table

        for (_, role, text), fault in zip(own, faults):
            then = {}
            for q, (c, a, t) in inserted(best).items():
                put(then, q, (c + 2, a + "D", t))
                if fault in ("blank", "duplicate"):
                    continue
                more = 5 if fault == "truncated" else 0
                for letter, to in step[q].items():
                    if role[:1] == letter:
                        put(then, to, (c + more, a + "K", (*t, f"{role}:{text}")))
                    if letter in full:
                        put(then, to, (c + 1 + more, a + "R", (*t, f"{full[letter]}:{text}")))
            best = then
        cost, audit, lines = min(v for q, v in inserted(best).items() if q in (0, 3))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.add((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def talk():
    rng = random.Random(12)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else "user" if turn % 2 == 0 else "assistant"
            role = "system" if turn == 0 and rng.random() < 0.4 else rng.choice(["tool", "", "System"]) if rng.random() < 0.05 else role
            text = rng.choice(["Yes.", "What now?", " \t\n", "Cut off here", "Fine!  \n", "é ü 語.", "ok"]) if rng.random() < 0.6 else f"Text {rng.random()}."
            rows.append((conv if conv else None, turn * rng.choice([1, 1, 1, 3]), role, text))
    rows += [(7, None, None, None), (7, None, "user", "No turn."), (7, 2, "user", None), (8, 3, None, "No role."), (9, 1, "user", "Tie."), (9, 1, "user", "Tie."), (9, 1, "assistant", "Tie.")]
    rows += [(500, t, "user" if t % 2 else "assistant", "Same." if t % 3 else f"Long {t}" + "." * (t % 5)) for t in range(400)]
    rows += [(501, 5, "user", "Again and again.")] * 50 + [(502, 1, "user", "word " * 50_000 + ".")]
    return rows


@pytest.mark.parametrize(("segment", "chars"), [(128, 1_000_000), (3, 40)])
def test_conversations_match_brute_force(spark, segment, chars):
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in talk()], TALK).repartition(3)
    got = conversations.repair_conversations(conversations.damaged(df), segment, chars).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute_conversations(talk())


def test_a_conversation_of_nothing(spark):
    gone = next((c, t) for c in range(100) for t in range(5) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(*gone, "user", "x", 1, "x", 2, "y")], TALK)
    (row,) = conversations.conversation_repairs(df).collect()
    assert tuple(row) == (gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.conversation_repairs(df.where("false")).collect() == []
    far = spark.createDataFrame([(1, -(2**63), "user", "a.", 1, "x", 2, "y"), (1, 2**63 - 1, "assistant", "b.", 1, "x", 2, "y")], TALK)
    assert conversations.conversation_repairs(far).count() == 1


def test_the_bound_never_passes_the_cost_and_the_search_stays_short():
    rng = random.Random(4)

    def some(n):
        return [conversations.Row("", "", rng.randint(1, 3), False) if rng.random() < 0.15 else conversations.Row(rng.choice(["user", "assistant", "system", "tool", "user", "assistant"]), "x", 0, rng.random() < 0.2) for _ in range(n)]

    for _ in range(300):
        rows, goals = some(rng.randint(0, 12)), rng.choice([conversations.GOALS, frozenset((rng.randint(0, 3),))])
        low = conversations.bounds(rows, goals)
        for state in range(4):
            for i in range(len(rows) + 1):
                best = conversations.repair(rows[i:], state, goals)
                assert best is None or best[0] >= low[i][(0, 1, 2, 1)[state]]
    rows = some(3000)
    assert conversations.repair(rows)[0] > 0  # in well under a second


# secrets


def plain_base(text):
    kinds = (("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?P<v>[A-Za-z0-9+/_.=-]+)""", 6), ("access", "(?P<v>AKIA[A-Z0-9]+)", 20), ("hex", "(?P<v>[0-9a-f]+)", 24))
    found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, least) in enumerate(kinds) for m in re.finditer(p, text, re.ASCII) if len(m["v"]) >= least]
    return [x for *_, x in sorted(found)]


def secret_docs():
    rng = random.Random(13)
    word = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    hexa, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    prose = lambda: " ".join(word(rng.randint(2, 14), "etaoinshrdluéü") for _ in range(30))
    rows = []
    for i in range(300):
        one = rng.choice([f"password={word(18, hexa)}", f'Token = "{word(40, hexa)}"', f"AKIA{word(16, upper)}", f"API_KEY: {word(18, hexa)}", "mail8.example.com 4041894974608795", "secret=abc password : 12345"])
        rows.append((i, f"{prose()} {one} {prose()}"))
    rows += [(300, None), (301, ""), (302, "語" * 10 + " secret='" + word(30, hexa) + "' é"), (303, f"bare {word(18, hexa)} here"), (304, f"key AKIA{word(16, upper).lower()} and AKIASHORT"), (305, prose() * 200), (None, f"token={word(18, hexa)}"), (5, rows[5][1])]
    rows += [(306, "secret=token'=abcdefghi"), (307, "token" + " " * 3 + "=" + "x" * 5000), (308, "ſecret=abcdefgh Key"), (309, "a\nb" * 3 + "\npassword=\nabcdefgh")]
    return rows


def test_secret_spans_match_the_patterns_and_bare_ones_are_found(spark):
    rows = secret_docs()
    df = spark.createDataFrame([(*r, "x", "y", 1, "z", "w") for r in rows], DOCS).repartition(3)
    got = secrets.secret_spans(df).collect()
    want = Counter((d, ",".join(plain_base(t or ""))) for d, t in rows)
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == Counter({(d, hashlib.sha256(b.encode()).hexdigest()): n for (d, b), n in want.items()})
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        base, spans = plain_base(text), [x for x in r["spans"].split(",") if x]
        kinds = Counter(x.split(":")[0] for x in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert set(base) <= set(spans) and len(spans) == len(base) + r["n_added"]
        assert (r["n_added"] > 0) == (r["doc_id"] == 303), (r, text[-80:])
    (bare,) = [r["spans"] for r in got if r["doc_id"] == 303]
    assert bare == "assign:5:23"


def test_no_documents_and_no_secrets(spark):
    df = spark.createDataFrame([(1, "just words and letters here", "x", "y", 1, "z", "w")], DOCS)
    (row,) = secrets.secret_spans(df).collect()
    assert (row["spans"], row["n_added"]) == ("", 0)
    assert secrets.secret_spans(df.where("false")).collect() == []


def test_automata_keep_fixed_lengths_and_prefixes_and_make_loops():
    rng = random.Random(1)
    hexa = "0123456789abcdef"
    fixed = secrets.learn(["".join(rng.choice(hexa) for _ in range(20)) for _ in range(2000)])
    assert len(fixed.bits) == 22  # a state for each length and one for what left the grammar
    loose = secrets.learn(["ab_" + "".join(rng.choice(hexa) for _ in range(rng.choice([4, 5, 6, 7, 8, 9, 10, 11, 12]))) for _ in range(2000)])
    model = secrets.Model({"hex": fixed, "assign": loose}, np.full((len(secrets.ALPHABET) + 1,) * 2, -np.log2(len(secrets.ALPHABET) + 1)))

    def gain(text):
        return model.judge(secrets.look([text.encode()]))[1][0]

    value = "".join(rng.choice(hexa) for _ in range(20))
    assert gain(value) > 35 and gain(value[:-2]) < gain(value) - 5 and gain(value.upper()) < gain(value) - 10
    loop = [secrets.State() for _ in range(1)]
    assert loop[0].total == 0
    geometric = []
    for _ in range(3000):
        n = 1
        while rng.random() < 0.7:
            n += 1
        geometric.append("x" * n)
    assert len(secrets.learn(geometric).bits) <= 4  # the repeated part is one state


def test_scores_follow_the_automaton():
    rng = random.Random(3)
    a = secrets.learn(["k" + "".join(rng.choice("01") for _ in range(14)) for _ in range(500)])
    runs = ["k01010101010101", "k0101010101010", "zzzzzzzzzzzzzzzz"]
    found = secrets.look([r.encode() for r in runs])
    flat = secrets._CODES[np.frombuffer(found.joined, np.uint8)]
    order = np.argsort(-(found.ends - found.starts), kind="stable")
    together = a.likelihood(flat, found.starts[order], (found.ends - found.starts)[order])
    for i, r in zip(order, together):
        state, total = 0, 0.0
        for c in runs[i]:
            total += a.bits[state, secrets.ALPHABET.index(c)]
            state = a.to[state, secrets.ALPHABET.index(c)]
        assert r == pytest.approx(total + a.bits[state, -1])


def test_a_credential_that_repeats_counts_once(spark):
    rows = [(i, "password=0123456789abcdef01") for i in range(500)] + [(500 + i, f"token={i:018x}") for i in range(40)]
    seen = secrets.observed(spark.createDataFrame([(*r, "x", "y", 1, "z", "w") for r in rows], DOCS))
    assert seen.where("kind = 'assign'").agg(F.count("*"), F.max("n")).first()[:] == (41, 500)
