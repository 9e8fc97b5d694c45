"""Structure repair of conversations by a Viterbi search with coalescing
survivors.

The roles of a repaired conversation read ``(s?(ua)+)?`` by their initials.
An automaton of four states (nothing yet, after s, after u, after a) follows
a conversation row by row; a row is kept, given another role or deleted, and
turns without text may be inserted before it.  Of all ways to a state only
the cheapest survives, and of equally cheap ones that with the ASCII-least
edits.  Survivors are nodes of a backpointer tree with reference counts: what
no survivor descends from is freed at once, and as soon as all survivors
descend from one node, the edits up to it are final, are emitted and
forgotten.  So a task holds the rows on which the survivors still disagree,
not the conversation.  Equally cheap survivors are told apart by their whole
unresolved edits, back to the last node that they share: the edits of a row
end in D, K or R and hold none before, so no row's edits begin another's, and
the first row that differs decides.

A survivor that costs more than another one could make up for at most
(``ABOVE``) can be in no cheapest result and is dropped; equal costs stay.

A row is a duplicate if its role and text came at an earlier turn, which is
decided by an aggregate over digests (combined on the map side) and a join of
those that come at several turns, or if it equals the row before it in order.
A conversation's rows are read by one task, in order and a batch at a time,
because its digest is one hash over all its text.

Defined results: null conversation ids form one conversation; null turns come
first; rows of one turn are ordered by role, then text; a null role or text
reads as one space; a role's initial is its first character, none if it is
empty; an empty table gives no row.  Only the four named columns are read, so
others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE, SYSTEM, USER, ASSISTANT = range(4)
#: What comes next after each state but s: its state.
NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
INITIAL = {SYSTEM: "s", USER: "u", ASSISTANT: "a"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Turns to insert at the end of a conversation in each state.
CLOSE = {NONE: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: ABOVE[q]: (p, most that what follows can cost more from state p than from q).
ABOVE = {
    NONE: ((ASSISTANT, DELETE), (USER, DELETE + INSERT), (SYSTEM, DELETE + 2 * INSERT)),
    SYSTEM: ((NONE, 0), (ASSISTANT, 0), (USER, INSERT)),
    USER: ((NONE, INSERT), (ASSISTANT, INSERT), (SYSTEM, INSERT + 2 * INSERT)),
    ASSISTANT: ((NONE, 0), (USER, INSERT), (SYSTEM, 2 * INSERT)),
}


def moves(initial: str, must_go: bool, truncated: bool) -> list[tuple[int, str, int, int]]:
    """(state, edits, next state, cost) of every way to treat a row."""
    out = []
    for state in NEXT:
        out.append((state, "D", state, DELETE))
        if must_go:
            continue
        extra, at, inserted = TRUNCATED * truncated, state, 0
        while inserted <= 2:
            before, cost = "I" * inserted, INSERT * inserted + extra
            if initial == "s" and at == NONE:
                out.append((state, before + "K", SYSTEM, cost + KEEP))
            if initial == INITIAL[NEXT[at]]:
                out.append((state, before + "K", NEXT[at], cost + KEEP))
            out.append((state, before + "R", NEXT[at], cost + REROLE))
            at, inserted = NEXT[at], inserted + 1
    return out


class Node:
    """One row's edits on the way of at least one survivor."""

    __slots__ = ("parent", "edits", "refs")

    def __init__(self, parent: Node | None, edits: str):
        self.parent, self.edits, self.refs = parent, edits, 0
        if parent is not None:
            parent.refs += 1


def release(node: Node | None) -> None:
    """Give one reference up; free what nothing refers to any more."""
    while node is not None:
        node.refs -= 1
        if node.refs:
            return
        node = node.parent


def earlier(a: Node, b: Node, edits_a: str, edits_b: str) -> bool:
    """Whether a's unresolved edits, then ``edits_a``, are ASCII-less than b's."""
    while a is not b:
        edits_a, edits_b = a.edits, b.edits
        a, b = a.parent, b.parent
    return edits_a < edits_b


_MOVES: dict[tuple[str, bool, bool], list] = {}


class Survivors:
    """The cheapest ways through a conversation, row by row.

    ``add`` takes a row and returns the edits that it makes final, those of
    the oldest unresolved rows; ``finish`` returns the rest."""

    def __init__(self):
        self.root = Node(None, "")
        self.best = {NONE: (0, self.root)}
        self.root.refs = 1

    def add(self, initial: str, must_go: bool, truncated: bool) -> list[str]:
        initial = initial if initial in ("s", "u", "a") else ""
        key = (initial, must_go, truncated)
        if key not in _MOVES:
            _MOVES[key] = moves(*key)
        found: dict[int, tuple[int, Node, str]] = {}
        for state, edits, to, cost in _MOVES[key]:
            if (own := self.best.get(state)) is None:
                continue
            total = own[0] + cost
            other = found.get(to)
            if other is None or total < other[0] or (
                    total == other[0] and earlier(own[1], other[1], edits, other[2])):
                found[to] = (total, own[1], edits)
        kept = {q: way for q, way in found.items()
                if not any(p in found and found[p][0] + b < way[0] for p, b in ABOVE[q])}
        old, self.best = self.best, {}
        for q, (cost, parent, edits) in kept.items():
            node = Node(parent, edits)
            node.refs = 1
            self.best[q] = (cost, node)
        for _, node in old.values():
            release(node)
        return self._resolved()

    def _resolved(self) -> list[str]:
        """Edits up to the last node that all survivors descend from."""
        if self.root.refs > 1:
            return []
        chain, node = [], next(iter(self.best.values()))[1]
        while node is not self.root:
            chain.append(node)
            node = node.parent
        out = []
        for node in reversed(chain):
            # the only way on from the root, and not the end of one survivor while others go on
            if self.root.refs > 1:
                break
            out.append(node.edits)
            node.parent = None
            self.root = node
        return out

    def finish(self) -> tuple[int, list[str], int]:
        """(cost, edits of the rows not yet final, turns inserted at the end)."""
        won = None
        for state, (cost, node) in self.best.items():
            total, closing = cost + INSERT * CLOSE[state], "I" * CLOSE[state]
            if won is None or total < won[0] or (total == won[0] and earlier(node, won[1], closing, won[2])):
                won = (total, node, closing)
        edits, node = [], won[1]
        while node is not self.root:
            edits.append(node.edits)
            node = node.parent
        return won[0], edits[::-1], len(won[2])


def apply_edits(edits: str, state: int, role: str, text: str) -> tuple[int, list[tuple[str, str]]]:
    """The state after a row's edits and the turns that they leave."""
    out = []
    for e in edits:
        if e == "D":
            continue
        if e == "K" and state == NONE and role[:1] == "s":
            state = SYSTEM
        else:
            state = NEXT[state]
        out.append((role, text) if e == "K" else (ROLE[state], text if e == "R" else ""))
    return state, out


def flagged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            present: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text, present, blank, again, cut): rows by
    conversation, sorted within it.  ``again`` marks the role and text of an
    earlier turn; rows that are not ``present`` only carry their id."""
    there = F.col(present) if present else F.lit(True)
    own = rows.select(F.col(conv).cast("long").alias("conv_id"),
                      F.when(there, F.col(turn).cast("long")).alias("turn"),
                      F.when(there, F.coalesce(F.col(role), F.lit(" "))).alias("role"),
                      F.when(there, F.coalesce(F.col(text), F.lit(" "))).alias("text"), there.alias("present"))
    own = own.withColumn("digest", F.sha2(F.to_json(F.struct("role", "text")), 256))
    # where a conversation has a role and text at several turns: its first turn
    repeated = (own.filter("present").groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"))
                .agg(F.min("turn").alias("_low"), F.max("turn").alias("_high"),
                     F.bool_or(F.col("turn").isNull()).alias("_null"))
                .filter("_low < _high or (_null and _low is not null)"))
    again = F.col("turn").isNotNull() & (F.col("_null") | (F.col("turn") > F.col("_low")))
    return (own.join(repeated, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
            .select("conv_id", "turn", "role", "text", "present",
                    F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True)).alias("blank"),
                    F.coalesce(again, F.lit(False)).alias("again"),
                    F.coalesce(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), F.lit(True)).alias("cut"))
            .repartition("conv_id").sortWithinPartitions(
                F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"))


class Conversation:
    """Reads a conversation's rows in order; ``line`` gets each repaired turn
    (role, text) as soon as it is final."""

    def __init__(self, line: Callable[[str, str], None]):
        self.line = line
        self.search, self.state = Survivors(), NONE
        self.waiting: list[tuple[str, str]] = []  # rows whose edits are not final
        self.audit: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, again: bool, cut: bool) -> None:
        again = again or self.last == (turn, role, text)
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.last is not None and self.last[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = (turn, role, text)
        self.blank += blank
        self.duplicate += again and not blank
        cut = cut and not blank and not again
        self.truncated += cut
        self.waiting.append((role, text))
        self._final(self.search.add(role[:1], blank or again, cut))

    def _final(self, edits: list[str]) -> None:
        for (role, text), e in zip(self.waiting, edits, strict=False):
            self.state, turns = apply_edits(e, self.state, role, text)
            for t in turns:
                self.line(*t)
            self.audit.append(e)
        del self.waiting[:len(edits)]

    def finish(self) -> int:
        """The cost, after the last row's turns have been given out."""
        cost, edits, closing = self.search.finish()
        self._final(edits)
        for _ in range(closing):
            self.state = NEXT[self.state]
            self.line(ROLE[self.state], "")
        self.audit.append("I" * closing)
        return cost

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


class Digest:
    """sha256 of ``role:text`` lines joined by line feeds."""

    def __init__(self):
        self.hash, self.first = hashlib.sha256(), True

    def __call__(self, role: str, text: str) -> None:
        self.hash.update(f"{role}:{text}".encode() if self.first else f"\n{role}:{text}".encode())
        self.first = False


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of sorted batches."""
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_REPORT = f"conv_id long, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string"


def report(rows: DataFrame, present: str | None = None, **columns: str) -> DataFrame:
    """One row for each conversation: faults, cost, edits and the digest of
    the repaired turns.  Conversations of which no row is ``present`` are
    empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in list(zip(*done, strict=True))[:-2]],
                 *[pa.array(c, pa.string()) for c in list(zip(*done, strict=True))[-2:]]],
                [f.split()[0] for f in _REPORT.split(", ")])
            done.clear()
            return out
        current = own = digest = None

        def close() -> None:
            cost = own.finish()
            done.append((current, own.gaps, own.blank, own.duplicate, own.truncated, own.illegal, cost,
                         "".join(own.audit), digest.hash.hexdigest()))
        for conv, turn, role, text, there, blank, again, cut in _stream(batches):
            if own is None or conv != current:
                if own is not None:
                    close()
                    if len(done) >= 1000:
                        yield batch()
                current, digest = conv, Digest()
                own = Conversation(digest)
            if there:
                own.add(turn, role, text, blank, again, cut)
        if own is not None:
            close()
            yield batch()
    return flagged(rows, present=present, **columns).mapInArrow(run, _REPORT)


def repair(rows: DataFrame, **columns: str) -> DataFrame:
    """The repaired turns (conv_id, turn from 0, role, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
                ["conv_id", "turn", "role", "text"])
            out.clear()
            return made
        current = own = None
        at = 0

        def line(role: str, text: str) -> None:
            nonlocal at
            out.append((current, at, role, text))
            at += 1
        for conv, turn, role, text, _, blank, again, cut in _stream(batches):
            if own is None or conv != current:
                if own is not None:
                    own.finish()
                current, own, at = conv, Conversation(line), 0
            own.add(turn, role, text, blank, again, cut)
            if len(out) >= 1000:
                yield batch()
        if own is not None:
            own.finish()
        if out:
            yield batch()
    return flagged(rows, **columns).mapInArrow(run, "conv_id long, turn long, role string, text string")


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, present): rows damaged by the crc32 of
    ``conv_id:turn`` modulo 20.  0 drops the row (it stays, not present), 1
    empties its text, 2 removes ``[.!?]`` from it, 3 repeats the row, 4 sets
    the role user.  Nulls read as one space."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % 20
    own = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                      shown(role).alias("role"), shown(text).alias("text"), kind.alias("kind"))
    k = F.col("kind")
    return own.select(
        "conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(k == 1, "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (k != 0).alias("present"), F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        .alias("copy")).drop("copy")


def _sql_moves() -> str:
    """The moves of the search as SQL rows: state, edits, next state, cost,
    initial that the row must have (null: any), whether the row stays."""
    out = []
    for state in NEXT:
        out.append((state, "'D'", state, DELETE, "NULL", 0))
        at = state
        for inserted in range(3):
            before, cost = "I" * inserted, INSERT * inserted
            if at == NONE:
                out.append((state, f"'{before}K'", SYSTEM, cost, "'s'", 1))
            out.append((state, f"'{before}K'", NEXT[at], cost, f"'{INITIAL[NEXT[at]]}'", 1))
            out.append((state, f"'{before}R'", NEXT[at], cost + REROLE, "NULL", 1))
            at = NEXT[at]
    return ", ".join(f"({', '.join(map(str, r))})" for r in out)


#: The report of the damaged conversations for DuckDB: every state and row in
#: a recursive table that keeps the cheapest, then ASCII-least edits.
SQL = rf"""
WITH RECURSIVE bits(n, k, v) AS (
  SELECT n::BIGINT, 0, n::BIGINT FROM range(256) AS r(n)
  UNION ALL SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT n, v FROM bits WHERE k = 8),
keyed AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
crc(key, k, v) AS (
  SELECT DISTINCT key, 0, 4294967295::BIGINT FROM keyed
  UNION ALL SELECT c.key, c.k + 1, xor(c.v >> 8, t.v) FROM crc c
  JOIN crc_table t ON t.n = xor(c.v, ascii(substr(c.key, c.k + 1, 1))::BIGINT) & 255 WHERE c.k < length(c.key)),
kinds AS (SELECT key, xor(v, 4294967295::BIGINT) % 20 AS kind FROM crc WHERE k = length(key)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g')
    ELSE coalesce(text, ' ') END AS text
  FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM keyed JOIN kinds USING (key)) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM damaged),
faults AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, nth > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, substr(role, 1, 1) AS initial,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
    count(*) FILTER (WHERE cut AND NOT blank AND NOT again) AS truncated,
    count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
moves(q, edits, q2, cost, initial, stays) AS (VALUES {_sql_moves()}),
ways(conv_id, i, q, cost, audit) AS (
  SELECT conv_id, 0::BIGINT, 0, 0, '' FROM counted
  UNION ALL
  SELECT conv_id, i, q, cost, audit FROM (
    SELECT w.conv_id, f.i, m.q2 AS q, w.cost + m.cost + CASE WHEN m.stays = 1 AND f.cut THEN 1 ELSE 0 END AS cost,
      w.audit || m.edits AS audit, row_number() OVER (PARTITION BY w.conv_id, m.q2 ORDER BY w.cost + m.cost
        + CASE WHEN m.stays = 1 AND f.cut THEN 1 ELSE 0 END, w.audit || m.edits) AS nth
    FROM ways w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
    JOIN moves m ON m.q = w.q AND (m.initial IS NULL OR m.initial = f.initial) AND (m.stays = 0 OR NOT (f.blank OR f.again)))
  WHERE nth = 1),
ended AS (
  SELECT conv_id, cost, audit FROM (
    SELECT w.conv_id, w.cost + e.cost AS cost, w.audit || e.edits AS audit,
      row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + e.cost, w.audit || e.edits) AS nth
    FROM ways w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i
    JOIN (VALUES (0, '', 0), (1, 'II', 4), (2, 'I', 2), (3, '', 0)) AS e(q, edits, cost) ON e.q = w.q) WHERE nth = 1),
letters AS (
  SELECT conv_id, k, substr(audit, k, 1) AS e, length(replace(substr(audit, 1, k), 'I', '')) AS i,
    length(replace(substr(audit, 1, k), 'D', '')) AS j
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM ended)),
kept AS (
  SELECT l.conv_id, l.k, l.e, l.j, f.role, f.text,
    max(CASE WHEN l.j = 1 AND l.e = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS headed
  FROM letters l LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i AND l.e <> 'I' WHERE l.e <> 'D'),
lines AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role ELSE CASE WHEN (j - headed) % 2 = 1 THEN 'user' ELSE 'assistant' END END
    || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS said FROM kept GROUP BY conv_id)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(e.cost, 0)::BIGINT AS cost,
  coalesce(e.audit, '') AS audit, sha256(coalesce(l.said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM a.conv_id
"""
