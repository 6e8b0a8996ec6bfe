"""Secrets: pattern matches, and further strings that have the format of the credentials matched.

Grammar inference: the labelled credentials of a kind are put into a prefix tree whose
states count strings. States that are statistically compatible (Hoeffding's bound on
the frequencies of ends and next characters, here and in all states that follow) are
merged, first those of one depth, so that a fixed length stays fixed, then a state with
any before it, so that repeated parts become loops. What is left is a probabilistic
automaton for each kind. All maximal runs of credential characters in all texts are
scored by the automata against a bigram model of the other runs of the whole corpus;
a run that an automaton explains better by a stated number of bits is a span too.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import texts, utf8
from newsloom.plans.scratch import materialize

#: Labelled credentials of a kind that an automaton is learned from at most (distinct ones, the least by hash), and the longest of them.
FIT_VALUES, FIT_LENGTH = 4_000, 200
#: Least characters of a candidate, bits by which it must be likelier as a credential, risk of Hoeffding's bound, share of a state left for what it never saw.
CANDIDATE, BITS, ALPHA, UNSEEN = 12, 24.0, 0.001, 0.001

# Kinds in order, their patterns with the least length that counts and the group it holds for, and words without which the first can't match.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": (re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE), 2, 6),
    "access": (re.compile(rb"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(rb"[0-9a-f]{24,}"), 0, 24),  # the runs of 24 or more that [0-9a-f]+ finds
}
CUES = (b"passw", b"secret", b"token", b"api")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_CODES = np.full(256, -1)
_CODES[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
#: Bytes of text that a task looks at together (a longer text by itself).
CHUNK = 1_000_000


@dataclass
class Found:
    """What some texts hold: the texts joined by newlines and where each begins; pattern matches ``(text, start, kind's place, end, credential)`` in order; and starts and ends of the candidates, maximal runs of credential characters that touch no match."""

    joined: bytes
    begins: np.ndarray
    matches: list[tuple[int, int, int, int, bytes]]
    starts: np.ndarray
    ends: np.ndarray


def look(docs: list[bytes]) -> Found:
    """Matches and candidates of UTF-8 texts. Neither patterns nor runs can cross a newline."""
    joined = b"\n".join(docs)
    begins = np.cumsum([0, *(len(t) + 1 for t in docs)])[:-1]
    inside = np.r_[False, _CODES[np.frombuffer(joined, np.uint8)] >= 0, False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= CANDIDATE
    starts, ends = starts[long], ends[long]
    matches = []

    def take(text: int, k: int, at: int, end: int) -> None:
        pattern, group, least = PATTERNS[KINDS[k]]
        matches.extend((text, m.start(), k, m.end(), m[group]) for m in pattern.finditer(joined, at, end) if m.end(group) - m.start(group) >= least)

    for i, t in enumerate(docs):
        low = t.lower()
        if any(c in low for c in CUES):
            take(i, 0, begins[i], begins[i] + len(t))
        if b"AKIA" in t:
            take(i, 1, begins[i], begins[i] + len(t))
    runs = np.flatnonzero(ends - starts >= PATTERNS["hex"][2])
    for i, r in zip(np.searchsorted(begins, starts[runs], "right") - 1, runs, strict=True):
        take(int(i), 2, starts[r], ends[r])
    matches.sort()
    if matches:
        free = np.ones(len(starts), bool)
        for _, s, _, e, _ in matches:
            free[np.searchsorted(ends, s, "right") : np.searchsorted(starts, e)] = False
        starts, ends = starts[free], ends[free]
    return Found(joined, begins, matches, starts, ends)


def chunks(docs: list[bytes]):
    """Neighbouring texts of ``CHUNK`` bytes together, or one longer text."""
    at, size = 0, 0
    for i, t in enumerate(docs):
        if i > at and size + len(t) > CHUNK:
            yield docs[at:i]
            at, size = i, 0
        size += len(t)
    if docs:
        yield docs[at:]


@dataclass
class State:
    """Strings that reach a state, those that end in it, and by character those that go on and where to."""

    total: int = 0
    ends: int = 0
    seen: Counter = field(default_factory=Counter)
    to: dict[str, State] = field(default_factory=dict)


def prefix_tree(values: list[str]) -> State:
    root = State()
    for value in values:
        state = root
        state.total += 1
        for c in value:
            state.seen[c] += 1
            state = state.to.setdefault(c, State())
            state.total += 1
        state.ends += 1
    return root


def compatible(a: State, b: State, alpha: float = ALPHA) -> bool:
    """Whether the strings through ``b``, the root of a tree, may come from ``a``: no frequency differs by more than Hoeffding's bound, here and in all states below ``b``."""
    stack, c = [(a, b)], float(np.sqrt(0.5 * np.log(2 / alpha)))
    while stack:
        a, b = stack.pop()
        if a is b or not a.total or not b.total:
            continue
        bound = c * (a.total**-0.5 + b.total**-0.5)
        if bound >= 1:  # no frequencies can differ by more, nor those of rarer states that follow
            continue
        if abs(a.ends / a.total - b.ends / b.total) > bound or any(abs(a.seen[x] / a.total - b.seen[x] / b.total) > bound for x in a.seen.keys() | b.seen.keys()):
            return False
        stack += [(a.to[x], y) for x, y in b.to.items() if x in a.to]
    return True


def fold(a: State, b: State) -> None:
    """Add the tree ``b`` to ``a``: counts are summed, what only ``b`` has is hung in."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        a.total += b.total
        a.ends += b.ends
        a.seen.update(b.seen)
        for x, y in b.to.items():
            if x in a.to:
                stack.append((a.to[x], y))
            else:
                a.to[x] = y


def merged_by_depth(root: State) -> list[State]:
    """Merge compatible states of one depth, depth by depth; the states left, by depth."""
    level, out = [root], []
    while level:
        out += level
        below: list[State] = []
        for parent, x in sorted(((p, x) for p in level for x in p.to), key=lambda e: (-e[0].seen[e[1]], e[1])):
            child = parent.to[x]
            if any(child is s for s in below):
                continue
            if (old := next((s for s in below if compatible(s, child)), None)) is not None:
                fold(old, child)
                parent.to[x] = old
            else:
                below.append(child)
        level = below
    return out


def merged_in_loops(root: State, states: list[State]) -> None:
    """Merge a state with one before it that is compatible: what follows it then repeats. The graph has a handful of states by now; counts are of whole depths."""
    kept = [root]
    for state in states[1:]:
        into = next((k for k in kept if _alike(k, state)), None)
        if into is None:
            kept.append(state)
            continue
        for s in states:
            for x, y in s.to.items():
                if y is state:
                    s.to[x] = into
        into.total += state.total
        into.ends += state.ends
        into.seen.update(state.seen)
        for x, y in state.to.items():
            into.to.setdefault(x, y)


def _alike(a: State, b: State, alpha: float = ALPHA) -> bool:
    """:func:`compatible` on a graph: pairs of states are compared once."""
    stack, done, c = [(a, b)], set(), float(np.sqrt(0.5 * np.log(2 / alpha)))
    while stack:
        a, b = stack.pop()
        if a is b or (id(a), id(b)) in done:
            continue
        done.add((id(a), id(b)))
        bound = c * (a.total**-0.5 + b.total**-0.5)
        keys = a.seen.keys() | b.seen.keys()
        if abs(a.ends / a.total - b.ends / b.total) > bound or any(abs(a.seen[x] / a.total - b.seen[x] / b.total) > bound for x in keys):
            return False
        stack += [(a.to[x], b.to[x]) for x in keys if x in a.to and x in b.to]
    return True


@dataclass
class Automaton:
    """Rows are states, the last one for strings that left the grammar: log2 of the chance of each character and of the end, and the next state."""

    bits: np.ndarray
    to: np.ndarray

    def likelihood(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log2 of the probabilities of strings, longest first, each given by start and length in ``flat``, places in ``ALPHABET``; all step together."""
        state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts))
        n = len(starts)
        for i in range(int(lengths[0]) if n else 0):
            n = int(np.searchsorted(-lengths[:n], -i))  # strings with a character at i
            c = flat[starts[:n] + i]
            total[:n] += self.bits[state[:n], c]
            state[:n] = self.to[state[:n], c]
        return total + self.bits[state, len(ALPHABET)]


def learn(values: list[str], alphabet: str = ALPHABET) -> Automaton:
    """The automaton of a list of credentials."""
    root = prefix_tree(values)
    merged_in_loops(root, merged_by_depth(root))
    place, order, at = {c: i for i, c in enumerate(alphabet)}, [root], {id(root): 0}
    for s in order:
        for x in sorted(s.to):
            if id(s.to[x]) not in at:
                at[id(s.to[x])] = len(order)
                order.append(s.to[x])
    n, m = len(order), len(alphabet)
    bits, to = np.full((n + 1, m + 1), np.log2(1 / (m + 1))), np.full((n + 1, m), n)
    for i, s in enumerate(order):
        p = np.zeros(m + 1)
        for x, k in s.seen.items():
            p[place[x]] = k
            to[i, place[x]] = at[id(s.to[x])]
        p[m] = s.ends
        bits[i] = np.log2((1 - UNSEEN) * p / max(p.sum(), 1) + UNSEEN / (m + 1))
    return Automaton(bits, to)


@dataclass
class Model:
    """Automata by kind, and log2 of the chance of a character, or the end, after a character, or the start, in other runs."""

    automata: dict[str, Automaton]
    other: np.ndarray

    def judge(self, found: Found) -> tuple[np.ndarray, np.ndarray]:
        """For each candidate the place of the kind that explains it best, and the bits by which it does so better than the other runs' model."""
        flat, lengths = _CODES[np.frombuffer(found.joined, np.uint8)], found.ends - found.starts
        order = np.argsort(-lengths, kind="stable")
        if not len(order) or not self.automata:
            return np.zeros(len(order), np.int64), np.full(len(order), -np.inf)
        each = np.stack([a.likelihood(flat, found.starts[order], lengths[order]) for a in self.automata.values()])
        pairs = _pairs(found)
        plain = np.r_[0, np.cumsum(self.other.ravel()[pairs])]
        ends = np.cumsum(lengths + 1)
        kind, gain = np.empty(len(order), np.int64), np.empty(len(order))
        places = np.array([KINDS.index(k) for k in self.automata])
        kind[order], gain[order] = places[each.argmax(0)], each.max(0)
        return kind, gain - (plain[ends] - plain[ends - lengths - 1])


def _pairs(found: Found) -> np.ndarray:
    """Neighbouring characters of all candidates one after the other, start and end included, as places in a square of ``ALPHABET`` and a mark for start and end."""
    side, lengths = len(ALPHABET) + 1, found.ends - found.starts
    at = np.repeat(found.starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
    c = np.insert(_CODES[np.frombuffer(found.joined, np.uint8)[at]], np.r_[0, np.cumsum(lengths)], side - 1)
    return c[:-1] * side + c[1:]


def observed(docs: DataFrame) -> DataFrame:
    """``kind, value, n``: the distinct credentials that the patterns find in ``docs``, and under kind ``other`` the pairs of neighbouring characters of the other runs, space for start and end; counts over all texts."""
    marks = ALPHABET + " "

    def run(batches):
        for b in batches:
            seen, pairs = Counter(), np.zeros(len(marks) ** 2, np.int64)
            for part in chunks(utf8(b.column(1))):
                found = look(part)
                seen.update((KINDS[k], v.decode()) for *_, k, _, v in found.matches)
                pairs += np.bincount(_pairs(found), minlength=len(pairs)) if len(found.starts) else 0
            seen.update({("other", marks[i // len(marks)] + marks[i % len(marks)]): int(pairs[i]) for i in np.flatnonzero(pairs)})
            yield pa.record_batch({"kind": pa.array([k for k, _ in seen], pa.string()), "value": pa.array([v for _, v in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    return texts(docs).mapInArrow(run, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, rows: int = FIT_VALUES, longest: int = FIT_LENGTH) -> Model:
    """Learn from ``labelled (kind, value, n)`` as :func:`observed` gives it, or from any table of labelled credentials.

    An automaton is learned from ``rows`` distinct values of its kind at most, those of
    least hash, none longer than ``longest``: the bounds of what the driver holds. How
    often a value occurs plays no part. The model of other runs has the counts of all.
    """
    fine = labelled.where("value is not null").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    automata = {}
    for kind in KINDS:
        drawn = fine.where((F.col("kind") == kind) & (F.length("value") <= longest)).orderBy(F.xxhash64("value"), "value").limit(rows)
        if values := sorted(r["value"] for r in drawn.select("value").collect()):
            automata[kind] = learn(values)
    marks = ALPHABET + " "
    pairs = np.full((len(marks), len(marks)), 0.5)
    for r in fine.where((F.col("kind") == "other") & (F.length("value") == 2)).collect():  # one row for a pair of characters at most
        pairs[marks.index(r["value"][0]), marks.index(r["value"][1])] += r["n"]
    return Model(automata, np.log2(pairs / pairs.sum(1, keepdims=True)))


def scan(docs: DataFrame, model: Model, bits: float = BITS) -> DataFrame:
    """``doc_id``, base spans and all spans of each row: arrays of ``kind, start, end, bits`` in code points; base spans have no bits."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))

    def run(batches):
        for b in batches:
            base, spans = [], []
            for part in chunks(utf8(b.column(1))):
                found = look(part)
                kinds, gains = shared.value.judge(found)
                hits = [(i, s, k, e, None) for i, s, k, e, _ in found.matches]
                more = np.flatnonzero(gains >= bits)
                of = np.searchsorted(found.begins, found.starts[more], "right") - 1
                hits += [(int(i), int(found.starts[r]), int(kinds[r]), int(found.ends[r]), float(gains[r])) for i, r in zip(of, more, strict=True)]
                first = len(base)
                base += [[] for _ in part]
                spans += [[] for _ in part]
                points: dict[int, np.ndarray] = {}
                for i, s, k, e, gain in sorted(hits, key=lambda h: h[:4]):
                    if i not in points:  # code points before each byte
                        points[i] = np.cumsum(np.frombuffer(part[i], np.uint8) & 0xC0 != 0x80)
                    s, e = s - int(found.begins[i]), e - int(found.begins[i])
                    one = {"kind": KINDS[k], "start": int(points[i][s]) - 1, "end": int(points[i][e - 1]), "bits": gain}
                    spans[first + i].append(one)
                    if gain is None:
                        base[first + i].append(one)
            yield pa.record_batch({"doc_id": b.column(0), "base": pa.array(base, span), "spans": pa.array(spans, span)})

    kind = "array<struct<kind:string,start:long,end:long,bits:double>>"
    return texts(docs).mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def secret_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added`` for each row of ``docs (doc_id, text)``.

    Labels come from the patterns' matches in all of ``docs``. A null or empty text has
    no spans; a text of any length is scanned whole; null ids and rows that repeat one
    are rows like others; in a corpus without matches nothing is learned and nothing
    added; an empty table gives no rows; other columns are ignored.
    """
    found = scan(docs, fit(materialize(observed(docs), "credentials")))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), added)
