"""Conversations damaged by rule, their faults, and the cheapest repair to alternating roles.

Rows are dealt by ranges of conversation and turn, so that a conversation of any length
is spread over tasks; what is seen before a row anywhere in its conversation comes as a
marker row of hashes beside it. A task reads its rows in order, with constant memory,
and repairs each conversation that lies whole in it by depth-first branch and bound.
Longer ones, and those at the borders of a range, are cut into segments. A segment is
repaired for each state of the grammar before and after it; a pass over the segments of
a conversation, without its texts, chooses among these, and a last pass hashes the
repaired texts in order. Prefixes of the same rows and equal cost never continue one
another, so the least audit of a whole is made of least audits of its parts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.plans.scratch import materialize
from newsloom.session import ship

#: Rows and characters of a segment at most (about).
SEGMENT, SEGMENT_CHARS = 128, 1_000_000

# Costs of the edits, and the grammar (s?(ua)+)? of role initials as the states that each letter leads to.
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
GOALS = frozenset((0, 3))
ROLES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\v\f\r"


@dataclass
class Row:
    """A row, or a run of equal rows that have to go: ``must`` of them."""

    role: str
    text: str
    must: int
    cut: bool


def bounds(rows: list[Row], goals: frozenset) -> list[tuple[int, int, int]]:
    """Lower bounds of the cost of the rows from each place on, by what is wanted next: nothing was kept yet, a user, an assistant.

    Summed from the end under a looser grammar, in which a system row may be followed by
    the end.
    """
    fresh, user, assistant = ((0 if goals & states else INSERT) for states in ({0}, {1, 3}, {2}))
    out = [(0, 0, 0)] * (len(rows) + 1)
    for i in range(len(rows), -1, -1):
        if i < len(rows):
            r, c = rows[i], rows[i].role[:1]
            if r.must:
                fresh, user, assistant = (x + DELETE * r.must for x in (fresh, user, assistant))
            else:
                extra = UNFINISHED if r.cut else 0
                as_user, as_assistant = (extra + (KEEP if c == x else REROLE) for x in "ua")
                start = min(assistant + as_user, user + extra + KEEP) if c == "s" else assistant + as_user
                fresh, user, assistant = min(fresh + DELETE, start), min(user + DELETE, assistant + as_user), min(assistant + DELETE, user + as_assistant)
        user, assistant = min(user, assistant + INSERT), min(assistant, user + INSERT)
        fresh = min(fresh, assistant + INSERT)
        out[i] = fresh, user, assistant
    return out


def repair(rows: list[Row], state: int = 0, goals: frozenset = GOALS) -> tuple[int, str] | None:
    """Least (cost, audit) that leads from a state of the grammar to one of ``goals``, or None.

    Branch and bound, depth first on a stack of its own: a prefix goes where its cost
    and the bound of what follows exceed the best whole repair so far, or equal it with
    a greater audit, and where a prefix to the same row and state was no worse.
    """
    n, low = len(rows), bounds(rows, goals)
    wanted = (0, 1, 2, 1)  # by state, the place of its bound
    best: tuple[int, str] | None = None
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, state, 0, "")]
    while stack:
        i, q, cost, audit = stack.pop()
        least = cost + low[i][wanted[q]]
        if best is not None and (least > best[0] or (least == best[0] and audit > best[1][: len(audit)])):
            continue
        if (old := table.get((i, q))) is not None and old <= (cost, audit):
            continue
        table[i, q] = cost, audit
        if i == n and q in goals:
            if best is None or (cost, audit) < best:
                best = cost, audit
            continue
        more = [(i, to, cost + INSERT, audit + "I") for c, to in NEXT[q].items() if c in ROLES]
        if i < n:
            r = rows[i]
            if r.must:
                more.append((i + 1, q, cost + DELETE * r.must, audit + "D" * r.must))
            else:
                more.append((i + 1, q, cost + DELETE, audit + "D"))
                extra = UNFINISHED if r.cut else 0
                for c, to in NEXT[q].items():
                    if r.role[:1] == c:
                        more.append((i + 1, to, cost + KEEP + extra, audit + "K"))
                    elif c in ROLES:
                        more.append((i + 1, to, cost + REROLE + extra, audit + "R"))
        more.sort(key=lambda x: (x[2] + low[x[0]][wanted[x[1]]], x[3]), reverse=True)
        stack += more  # the most promising on top
    return best


def repaired(rows: list[Row], audit: str, state: int = 0) -> tuple[list[str], int]:
    """``role:text`` of the rows that an audit leaves, and the state that it ends in."""
    out, i, gone = [], 0, 0
    for edit in audit:
        if edit == "D":
            gone += 1
            if gone >= max(rows[i].must, 1):
                i, gone = i + 1, 0
            continue
        need = next(c for c in NEXT[state] if c in ROLES)
        role, text = ROLES[need], ""
        if edit != "I":
            text = rows[i].text
            if edit == "K":
                role = rows[i].role
                need = role[:1]
            i += 1
        out.append(f"{role}:{text}")
        state = NEXT[state][need]
    return out, state


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: each row as the rule of damage leaves it; a dropped one has no copies and stays as a mark of its conversation. Null values are one space in what is written."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    at = F.pmod(F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")), F.lit(20))
    text = F.when(at.isin(0, 1), F.lit("")).when(at == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    return conversations.select("conv_id", "turn", F.when(at == 4, F.lit("user")).otherwise(filled("role")).alias("role"), text.alias("text"), F.when(at == 0, 0).when(at == 3, 2).otherwise(1).alias("copies"))


_ROW = "conv_id long, turn long, role string, h binary, text string, copies int"


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows and, before them, markers of those whose role and text an earlier turn of the conversation has; dealt by ranges and sorted."""
    keyed = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.unhex(F.md5("text")).alias("h"), "text", "copies")
    place = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    narrow = keyed.where("copies > 0").groupBy("conv_id", "turn", "role", "h").agg(F.count("*").alias("n"))
    first = narrow.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("k")).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = narrow.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("k"))).where(place > F.col("first"))
    marks = materialize(again.select("conv_id", "turn", "role", "h"), "seen-before")
    both = keyed.unionByName(marks.select("*", F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies")))
    key = ["conv_id", "turn", "role", "h"]
    return both.repartitionByRange(*key).sortWithinPartitions(*key, "text")  # a marker has no text and comes first


@dataclass
class Segment:
    """Neighbouring rows of a conversation, and what the report needs of them."""

    conv: int | None
    rows: list[Row] = field(default_factory=list)
    chars: int = 0
    counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0])  # blank, duplicate, truncated, illegal
    first: str | None = None
    last: str | None = None
    turns: list = field(default_factory=lambda: [None, None, 0])  # least, greatest, distinct; nulls aside

    def add(self, role: str, text: str, turn: int | None, copies: int, seen: bool) -> None:
        """``copies`` equal rows; ``seen`` if their role and text came before."""
        end = text.rstrip(BLANKS)[-1:]
        pairs = copies - 1 + (self.last is not None and self.last + role[:1] not in ("su", "ua", "au"))
        self.counts[3] += pairs
        self.first = role[:1] if self.first is None else self.first
        self.last = role[:1]
        self.chars += len(text)
        if turn is not None:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + (self.turns[1] != turn)]
        gone = copies if not end or seen else copies - 1
        self.counts[0 if not end else 1] += gone
        if gone < copies:
            cut = end not in ".!?"
            self.counts[2] += cut
            self.rows.append(Row(role, text, 0, cut))
        if gone:
            if self.rows and self.rows[-1].must:
                self.rows[-1].must += gone
            else:
                self.rows.append(Row("", "", gone, False))


_MOVES = "array<struct<entry:int,exit:int,cost:long,audit:string>>"
_PIECE = f"conv_id long, task int, seg int, whole boolean, counts array<long>, first string, last string, turns array<long>, moves {_MOVES}, sha string, roles array<string>, texts array<string>, musts array<long>, cuts array<boolean>"


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _piece(s: Segment, task: int, seg: int, whole: bool) -> dict:
    one = {"conv_id": s.conv, "task": task, "seg": seg, "whole": whole, "counts": s.counts, "first": s.first, "last": s.last, "turns": s.turns}
    if whole:
        cost, audit = repair(s.rows)
        text = "\n".join(repaired(s.rows, audit)[0])
        return one | {"moves": [{"entry": 0, "exit": 0, "cost": cost, "audit": audit}], "sha": hashlib.sha256(text.encode()).hexdigest()}
    moves = [{"entry": p, "exit": q, "cost": m[0], "audit": m[1]} for p in range(4) for q in range(4) if (m := repair(s.rows, p, frozenset((q,)))) is not None]
    return one | {"moves": moves, "roles": [r.role for r in s.rows], "texts": [r.text for r in s.rows], "musts": [r.must for r in s.rows], "cuts": [r.cut for r in s.rows]}


def _batches(rows, schema: pa.Schema, size: int = 500, chars: int = 4_000_000):
    """Record batches of dicts, of bounded size."""
    some, held = [], 0
    for r in rows:
        some.append(r)
        held += sum(map(len, r.get("texts") or r.get("lines") or ()))
        if len(some) >= size or held > chars:
            yield pa.RecordBatch.from_pylist(some, schema)
            some, held = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, schema)


def _pieces(rows: DataFrame, segment: int, chars: int) -> DataFrame:
    """Whole conversations, repaired, and segments of the others."""
    schema = _schema(_PIECE)

    def cut(batches):
        task, seg, now, cuts, marked, before = TaskContext.get().partitionId(), 0, None, 0, None, None
        for b in batches:
            for conv, turn, role, h, text, copies in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:  # the first conversation may have begun in the task before
                        yield _piece(now, task, seg, seg > 0 and not cuts)
                        seg, cuts = seg + 1, 0
                    now, marked, before = Segment(conv), None, None
                elif len(now.rows) >= segment or now.chars > chars:
                    yield _piece(now, task, seg, False)
                    seg, cuts, now = seg + 1, cuts + 1, Segment(conv)
                if text is None:
                    marked = (turn, role, h)
                elif copies:
                    this = (turn, role, h)
                    now.add(role, text, turn, copies, this in (marked, before))
                    before = this
        if now is not None:  # and the last one may go on in the next
            yield _piece(now, task, seg, False)

    return rows.mapInArrow(lambda batches: _batches(cut(batches), schema), _PIECE)


def _rest(a: str, b: str) -> tuple[str, str]:
    """What follows the common beginning of two audits; only the first letters where they differ."""
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[i:], b[i:]
    return (a[0], b[0]) if a and b else (a, b)


class Paths:
    """Cheapest ways through the segments seen so far, by the state they end in, without their audits: how these differ is kept for each pair of states."""

    def __init__(self):
        self.cost: dict[int, int] = {0: 0}
        self.rests: dict[tuple[int, int], tuple[str, str]] = {(0, 0): ("", "")}
        self.back: list[dict[int, int]] = []

    def add(self, moves: list[dict]) -> None:
        best: dict[int, tuple[int, int, str]] = {}  # by exit: cost, entry, audit of the segment
        for m in moves:
            p, q = m["entry"], m["exit"]
            if p not in self.cost:
                continue
            cost = self.cost[p] + m["cost"]
            old = best.get(q)
            if old is None or cost < old[0] or (cost == old[0] and self._less(p, m["audit"], old[1], old[2])):
                best[q] = cost, p, m["audit"]
        self.rests = {(q, r): _rest(self.rests[best[q][1], best[r][1]][0] + best[q][2], self.rests[best[q][1], best[r][1]][1] + best[r][2]) if q != r else ("", "") for q in best for r in best}
        self.cost = {q: c for q, (c, _, _) in best.items()}
        self.back.append({q: p for q, (_, p, _) in best.items()})

    def _less(self, p: int, x: str, q: int, y: str) -> bool:
        a, b = self.rests[p, q]
        return a + x < b + y

    def end(self) -> tuple[int, list[tuple[int, int]]]:
        """Cost of the best whole way, and entry and exit of each segment."""
        goals = [q for q in sorted(GOALS) if q in self.cost]
        best = goals[0]
        for q in goals[1:]:
            if self.cost[q] < self.cost[best] or (self.cost[q] == self.cost[best] and self._less(q, "", best, "")):
                best = q
        cost, way = self.cost[best], []
        for back in reversed(self.back):
            way.append((back[best], best))
            best = back[best]
        return cost, way[::-1]


_PATH = "conv_id long, task int, seg int, entry int, exit int, head boolean, gaps long, counts array<long>, cost long"


def _of_conversations(df: DataFrame) -> DataFrame:
    """Rows of a conversation in one task, in order."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "task", "seg")


def _ways(pieces: DataFrame) -> DataFrame:
    """For each segment of a cut conversation the states that the best repair enters and leaves it in; the first also has the conversation's figures."""
    schema = _schema(_PATH)

    def run(batches):
        now = None
        for b in batches:
            for r in b.to_pylist():
                if now is None or now[0] != r["conv_id"]:
                    if now:
                        yield from done(*now)
                    now = (r["conv_id"], Paths(), [], [0, 0, 0, 0], [None, None, 0], [None])
                _, paths, at, counts, turns, last = now
                paths.add(r["moves"])
                at.append((r["task"], r["seg"]))
                for i, c in enumerate(r["counts"]):
                    counts[i] += c
                if r["first"] is not None:
                    counts[3] += last[0] is not None and last[0] + r["first"] not in ("su", "ua", "au")
                    last[0] = r["last"]
                low, high, n = r["turns"]
                if low is not None:
                    turns[2] += n - (turns[1] == low)
                    turns[:2] = [low if turns[0] is None else turns[0], high]
        if now:
            yield from done(*now)

    def done(conv, paths, at, counts, turns, last):
        cost, way = paths.end()
        for i, ((task, seg), (p, q)) in enumerate(zip(at, way, strict=True)):
            head = {"gaps": _gaps(turns), "counts": counts, "cost": cost} if i == 0 else {}
            yield {"conv_id": conv, "task": task, "seg": seg, "entry": p, "exit": q, "head": i == 0} | head

    narrow = pieces.select("conv_id", "task", "seg", "counts", "first", "last", "turns", "moves")
    return _of_conversations(narrow).mapInArrow(lambda batches: _batches(run(batches), schema), _PATH)


def _gaps(turns: list) -> int | None:
    """Turns missing between the least and the greatest; None beyond 64 bits."""
    gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
    return gaps if gaps < 2**63 else None


_OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _joined(pieces: DataFrame, ways: DataFrame) -> DataFrame:
    """Cut conversations: segments are edited where they lie, then their lines are hashed in order."""
    lines = f"{_PATH}, audit string, lines array<string>"
    edited, out = _schema(lines), _schema(_OUT)
    way = ways.select(F.col("task").alias("t"), F.col("seg").alias("s"), *[c for c in ways.columns if c not in ("conv_id", "task", "seg")])
    met = pieces.select("conv_id", "task", "seg", "moves", "roles", "texts", "musts", "cuts").join(way, (F.col("task") == F.col("t")) & (F.col("seg") == F.col("s"))).drop("t", "s")

    def edit(batches):
        for b in batches:
            for i in range(b.num_rows):
                (r,) = b.slice(i, 1).to_pylist()
                rows = [Row(*x) for x in zip(r["roles"], r["texts"], r["musts"], r["cuts"], strict=True)]
                audit = next(m["audit"] for m in r["moves"] if (m["entry"], m["exit"]) == (r["entry"], r["exit"]))
                yield {k: r[k] for k in ("conv_id", "task", "seg", "entry", "exit", "head", "gaps", "counts", "cost")} | {"audit": audit, "lines": repaired(rows, audit, r["entry"])[0]}

    def end(batches):
        head, sha, audits, lines = None, None, [], 0
        for b in batches:
            for i in range(b.num_rows):
                (r,) = b.slice(i, 1).to_pylist()
                if r["head"]:
                    if head:
                        yield close(head, sha, audits)
                    head, sha, audits, lines = r, hashlib.sha256(), [], 0
                audits.append(r["audit"])
                for line in r["lines"]:
                    sha.update((b"\n" if lines else b"") + line.encode())
                    lines += 1
        if head:
            yield close(head, sha, audits)

    def close(head, sha, audits):
        names = ("blank", "duplicate", "truncated", "illegal")
        return {"conv_id": head["conv_id"], "gaps": head["gaps"], **dict(zip(names, head["counts"], strict=True)), "cost": head["cost"], "audit": "".join(audits), "repaired_sha256": sha.hexdigest()}

    shaped = met.mapInArrow(lambda batches: _batches(edit(batches), edited), lines)
    return _of_conversations(shaped).mapInArrow(lambda batches: _batches(end(batches), out), _OUT)


def repair_conversations(rows: DataFrame, segment: int = SEGMENT, chars: int = SEGMENT_CHARS) -> DataFrame:
    """Faults and the cheapest repair of each conversation of ``rows (conv_id, turn, role, text, copies)``.

    ``copies`` equal rows stand one after the other; rows without copies only name
    their conversation. Rows go by turn, nulls first; those of one turn by role, then
    by the MD5 of their text. ``segment`` and ``chars`` change no result.
    """
    ship(rows.sparkSession)
    pieces = materialize(_pieces(_ordered(rows), segment, chars), "pieces")
    cut = pieces.where("not whole")
    done = pieces.where("whole")
    count = lambda i, name: F.col("counts")[i].alias(name)
    turns = F.col("turns")
    gaps = F.when(turns[2] > 0, F.try_add(F.try_subtract(F.try_subtract(turns[1], turns[0]), turns[2]), F.lit(1))).otherwise(F.lit(0))
    move = F.col("moves")[0]
    whole = done.select("conv_id", gaps.cast("long").alias("gaps"), count(0, "blank"), count(1, "duplicate"), count(2, "truncated"), count(3, "illegal"), move["cost"].alias("cost"), move["audit"].alias("audit"), F.col("sha").alias("repaired_sha256"))
    ways = materialize(_ways(cut), "ways")
    return whole.unionByName(_joined(cut, ways))


def conversation_repairs(conversations: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` for each conversation of ``conversations (conv_id, turn, role, text)``, damaged by rule.

    Null ids are one conversation; null turns come first; a null role or text is one
    space. A conversation left without rows has zeros, an empty audit and the hash of
    the empty string. Repeated rows of a turn are duplicates; an empty role fits
    nowhere; a text of any length is one row; gaps beyond 64 bits are null. An empty
    table gives no rows; other columns are ignored.
    """
    return repair_conversations(damaged(conversations))


REPAIRS_SQL = r"""
with recursive crc_table as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n::ubigint, range(8)::ubigint[]), lambda c, k: case when c & 1 = 1 then xor(3988292384::ubigint, c >> 1) else c >> 1 end)) as t),
filled as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
hashed as (select conv_id, turn, role, text, xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(k, ''), lambda x: ord(x)::ubigint)), lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::bigint]))) % 20 as hit from filled, crc_table),
damaged as (
  select conv_id, turn, case when hit = 4 then 'user' else role end as role, case when hit = 1 then '' when hit = 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when hit = 3 then 2 else 1 end)) as copy
  from hashed where hit <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as i, rtrim(text, e' \t\n\u000b\f\r') as trimmed from damaged),
judged as (select *, substr(role, 1, 1) as c, case when trimmed = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when right(trimmed, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    lag(substr(role, 1, 1)) over (partition by conv_id order by i) as before from placed),
faults as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (before is not null and before || c not in ('su', 'ua', 'au')) as illegal, count(*) as n from judged group by conv_id),
inserts as (from (values (0, 0, '', ''), (0, 2, 'I', 'user:'), (0, 3, 'II', 'user:' || chr(10) || 'assistant:'), (1, 1, '', ''), (1, 2, 'I', 'user:'), (1, 3, 'II', 'user:' || chr(10) || 'assistant:'), (2, 2, '', ''), (2, 3, 'I', 'assistant:'), (3, 3, '', ''), (3, 2, 'I', 'user:')) as t(p, q, edits, lines)),
steps as (from (values ('D', 0, 0, 2, null, null), ('D', 1, 1, 2, null, null), ('D', 2, 2, 2, null, null), ('D', 3, 3, 2, null, null), ('K', 0, 1, 0, 's', null), ('K', 0, 2, 0, 'u', null), ('K', 1, 2, 0, 'u', null), ('K', 3, 2, 0, 'u', null), ('K', 2, 3, 0, 'a', null),
    ('R', 0, 2, 1, null, 'user'), ('R', 1, 2, 1, null, 'user'), ('R', 3, 2, 1, null, 'user'), ('R', 2, 3, 1, null, 'assistant')) as t(edit, p, q, price, needs, becomes)),
ways as (
  select conv_id, 0::bigint as i, 0 as q, {'cost': 0::bigint, 'audit': '', 'lines': null::varchar} as best from faults
  union all
  select w.conv_id, w.i + 1, s.q, min({'cost': w.best.cost + 5 * length(x.edits) + s.price + case when j.fault = 'truncated' and s.edit <> 'D' then 5 else 0 end, 'audit': w.best.audit || x.edits || s.edit,
      'lines': nullif(concat_ws(chr(10), w.best.lines, nullif(x.lines, ''), case when s.edit = 'K' then j.role || ':' || j.text when s.edit = 'R' then s.becomes || ':' || j.text end), '')})
  from ways w join judged j on j.conv_id is not distinct from w.conv_id and j.i = w.i + 1 join inserts x on x.p = w.q join steps s on s.p = x.q and (s.edit = 'D' or j.fault not in ('blank', 'duplicate')) and (s.needs is null or s.needs = j.c)
  group by w.conv_id, w.i, s.q),
ends as (select w.conv_id, min({'cost': w.best.cost + 5 * length(x.edits), 'audit': w.best.audit || x.edits, 'lines': nullif(concat_ws(chr(10), w.best.lines, nullif(x.lines, '')), '')}) as best
  from ways w join faults f on f.conv_id is not distinct from w.conv_id and f.n = w.i join inserts x on x.p = w.q and x.q in (0, 3) group by w.conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit, sha256(coalesce(best.lines, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join faults f on f.conv_id is not distinct from c.conv_id left join ends e on e.conv_id is not distinct from c.conv_id
"""
