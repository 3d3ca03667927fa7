"""Conversation structure repair by Knuth's lightest derivation (operator 13).

A conversation is sound when the initials of its roles read ``(s?(ua)+)?``. Its rows may be kept (K), given another role (R, cost 3), or
deleted (D, cost 4, the only choice for blank and duplicate rows), and empty rows may be inserted (I, cost 3); a truncated row
that stays adds 3. The repair is the cheapest list of edits, of equally cheap ones that whose letters come first.

Deductions: an item (i, state) says that i rows have been edited and what the initials may go on with. A row's edits are axioms
with weights; an item and an edit of the next row, or an inserted row, derive the next item; an item that may end derives the
goal. The agenda pops items by (cost, letters); what a rule concludes never comes before its premise, as costs
don't fall and letters are appended, and of two derivations of one item the better stays better under any rule: equally cheap ones
differ before either ends, since one that merely went on would have inserted more and cost more. So the first item
popped of a kind is its lightest derivation, and the search ends when the goal is popped.

1. Rows get their fault in columns. A row is a duplicate if its conversation has an earlier row of the same SHA-256 of role and
   text; the earliest of each is found by an aggregation.
2. Rows without texts are sorted by ranges of (conversation, turn, role, digest), so a long conversation lies in several tasks. Each
   task cuts its conversations into pieces of ``piece_rows``. A conversation that is one piece is repaired there. For
   pieces of longer ones an agenda for each state they may begin in finds the lightest derivation to each state they may end in,
   right after a row's edit (there letters of different items differ before either ends).
3. Pieces are such edits themselves: an agenda step over a conversation's pieces in their order joins items and pieces, holding four
   items whose letters are shared lists, until the goal.
4. Texts are sorted by conversation behind their row of letters and pass through SHA-256 as a stream. One
   conversation's hash is a chain, so its texts pass through one task, which holds one row at a time.

Defined cases: null texts and roles are one space, as are null conv_ids and turns where these name a row; rows without a conv_id
are one conversation; rows without a turn go first; rows of one turn go by role, then by digest, equal ones follow one another; a role
without an initial adds none; no rows give no result; texts of any length count whole; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, materialize
from .skew import spread_join

PIECE_ROWS = 512
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"
#: States: nothing yet, after a system row, after a user row, after an assistant row; and what each may go on with.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: Rows to insert before the end.
ENDING = (0, 2, 1, 0)
LEGAL = {"su", "ua", "au"}
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
PIECE = "conv_id long, part int, seq long, n long, first string, last string, illegal long, blank long, duplicate long, truncated long, begins array<int>, ends array<int>, costs array<long>, audits array<string>"
REPAIR = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


# deductions


def edits(row: tuple[str, int], state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, letter, next state) of each edit of a row (initial, fault) in a state."""
    initial, fault = row
    yield DELETE, "D", state
    if fault in (BLANK, DUPLICATE):
        return
    more = CUT if fault == TRUNCATED else 0
    after = state if not initial else NEXT[state].get(initial)
    if after is not None:
        yield more, "K", after
    yield REROLE + more, "R", ASSISTANT if state == USER else USER


def lightest(rows: list[tuple[str, int]], begin: int, to_goal: bool) -> dict[int, tuple[int, str]]:
    """State and (cost, letters) of the lightest derivations from a state before the first row to those after the last; with ``to_goal``, that of the goal."""
    n, done, found = len(rows), set(), {}
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, begin)]
    goal = (n + 1, START)
    while agenda:
        cost, letters, i, state = heapq.heappop(agenda)
        if (i, state) in done:
            continue
        done.add((i, state))
        if (i, state) == goal:
            return {START: (cost, letters)}
        if i == n:
            if to_goal:
                heapq.heappush(agenda, (cost + INSERT * ENDING[state], letters + "I" * ENDING[state], *goal))
            else:
                found[state] = (cost, letters)
            continue
        for more, letter, after in edits(rows[i], state):
            if (i + 1, after) not in done:
                heapq.heappush(agenda, (cost + more, letters + letter, i + 1, after))
        inserted = ASSISTANT if state == USER else USER
        if (i, inserted) not in done:
            heapq.heappush(agenda, (cost + INSERT, letters + "I", i, inserted))
    return found


class Prefix:
    """Items after some pieces of a conversation: state to (cost, rank among them by letters, shared list of letters)."""

    def __init__(self) -> None:
        self.items: dict[int, tuple[int, int, tuple | None]] = {START: (0, 0, None)}

    def step(self, piece: dict) -> None:
        best: dict[int, tuple[int, int, str, tuple | None]] = {}
        for begin, end, cost, letters in zip(piece["begins"], piece["ends"], piece["costs"], piece["audits"], strict=True):
            if begin in self.items:
                sofar, rank, chain = self.items[begin]
                new = (sofar + cost, rank, letters)
                if end not in best or new < best[end][:3]:
                    best[end] = (*new, (chain, letters))
        order = sorted(best, key=lambda s: best[s][1:3])
        self.items = {s: (best[s][0], r, best[s][3]) for r, s in enumerate(order)}

    def goal(self) -> tuple[int, str]:
        cost, _, state = min((cost + INSERT * ENDING[s], rank, s) for s, (cost, rank, _) in self.items.items())
        parts, chain = ["I" * ENDING[state]], self.items[state][2]
        while chain is not None:
            parts.append(chain[1])
            chain = chain[0]
        return cost, "".join(reversed(parts))


# tasks


def _pieces(batches: Iterator[pa.RecordBatch], piece_rows: int) -> Iterator[tuple[int | None, bool, bool, int, list[tuple[str, int]]]]:
    """(conv_id, begins within the task, ends within the task, number, rows) of each piece of a task's sorted rows."""
    held: list[tuple[str, int]] = []
    now, known, inside, number = None, False, False, 0
    for batch in batches:
        for conv, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if known and conv != now:
                yield now, inside, True, number, held
                now, inside, number, held = conv, True, 0, []
            elif not known:
                now, known = conv, True
            elif len(held) == piece_rows:
                yield now, inside, False, number, held
                number, held = number + 1, []
            held.append((initial, fault))
    if known:
        yield now, inside, False, number, held


def piece_items(batches: Iterator[pa.RecordBatch], piece_rows: int) -> Iterator[pa.RecordBatch]:
    """Pieces with what each can turn a state into; those that are whole conversations lead from the start to the goal. Columns: conv_id, initial, fault."""
    part, out = TaskContext.get().partitionId(), []
    names = [f.split()[0] for f in PIECE.split(", ")]

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for conv, inside, ends, number, rows in _pieces(batches, piece_rows):
        whole = inside and ends and not number
        found = []
        for begin in [START] if inside and not number else range(4):
            found += [(begin, -1 if whole else end, *item) for end, item in lightest(rows, begin, whole).items()]
        initials, faults = [r[0] for r in rows], [r[1] for r in rows]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        out.append((conv, part, number, len(rows), initials[0], initials[-1], illegal, *(faults.count(x) for x in (BLANK, DUPLICATE, TRUNCATED)), *map(list, zip(*found, strict=True))))
        if len(out) == 256:
            yield batch()
            out = []
    if out:
        yield batch()


def join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repair of each conversation from its pieces, sorted by conversation, task and number."""
    held: dict | None = None
    kinds = [pa.int64()] * 6 + [pa.string()]

    def repair() -> pa.RecordBatch:
        cost, audit = held["prefix"].goal()
        row = (held["conv_id"], held["blank"], held["duplicate"], held["truncated"], held["illegal"], cost, audit)
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [f.split()[0] for f in REPAIR.split(", ")])

    for batch in batches:
        for at in range(batch.num_rows):
            piece = batch.slice(at, 1).to_pylist()[0]
            if held is not None and held["conv_id"] != piece["conv_id"]:
                yield repair()
                held = None
            if held is None:
                held = {"conv_id": piece["conv_id"], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "last": None, "prefix": Prefix()}
            if held["last"] is not None:
                held["illegal"] += held["last"] + piece["first"] not in LEGAL
            held["last"] = piece["last"]
            for c in ("blank", "duplicate", "truncated", "illegal"):
                held[c] += piece[c]
            held["prefix"].step(piece)
    if held is not None:
        yield repair()


class Repaired:
    """The hash of a conversation's repaired rows, one row after the other."""

    def __init__(self, letters: str) -> None:
        self.letters, self.at, self.state, self.some, self.hash = letters, 0, START, False, hashlib.sha256()

    def _write(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) * self.some}{role}:{text}".encode())
        self.some = True

    def _turn(self) -> str:
        self.state = ASSISTANT if self.state == USER else USER
        return "assistant" if self.state == ASSISTANT else "user"

    def inserts(self) -> None:
        while self.letters[self.at : self.at + 1] == "I":
            self._write(self._turn(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self.state = NEXT[self.state][role[0]] if role else self.state
            self._write(role, text)
        elif letter == "R":
            self._write(self._turn(), text)


def hash_repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id and repaired_sha256 of each conversation. Columns: conv_id, letters (in its first row alone), role, text."""
    now, known, repaired = None, False, None

    def result() -> pa.RecordBatch:
        repaired.inserts()
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([repaired.hash.hexdigest()])], ["conv_id", "repaired_sha256"])

    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            for conv, letters, role, text in zip(*(c.to_pylist() for c in batch.slice(begin, 256).columns), strict=True):
                if not known or conv != now:
                    if known:
                        yield result()
                    now, known, repaired = conv, True, Repaired(letters)
                else:
                    repaired.row(role, text)
    if known:
        yield result()


# the job


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``kind`` of the damage; dropped rows stay, as kind 0, and a repeated row is there twice."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    out = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", (F.crc32(name) % 20).cast("int").alias("kind"))
    kind = F.col("kind")
    text = F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" ")))
    out = out.select("conv_id", "turn", role.alias("role"), text.alias("text"), "kind")
    return out.withColumn("copy", F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy")


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def _order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.col("role"), F.col("digest")]


def repairs(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost and audit of each conversation of ``rows`` (conv_id, turn, role, text; no null role or text)."""
    tail = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    fault = F.when(tail == "", BLANK).when(~tail.isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    light = rows.select("conv_id", "turn", "role", _digest().alias("digest"), fault.alias("fault"), F.monotonically_increasing_id().alias("uid"))
    light = materialize(light, "conversation-rows")
    place = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)), "uid")
    firsts = light.withColumn("place", place).groupBy("conv_id", "digest").agg(F.min("place").alias("earliest"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1").select(F.coalesce("conv_id", F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("none"), "digest", "earliest")
    keyed = light.withColumns({"conv": F.coalesce("conv_id", F.lit(0)), "none": F.col("conv_id").isNull()})
    told = spread_join(keyed, firsts, ["conv", "none", "digest"], ["uid"], "left")
    again = F.coalesce(place > F.col("earliest"), F.lit(False))
    told = told.select("conv_id", "turn", "role", "digest", "uid", F.when((F.col("fault") != BLANK) & again, DUPLICATE).otherwise(F.col("fault")).alias("fault"))
    order = [F.asc_nulls_first("conv_id"), *_order(), F.col("uid")]
    told = materialize(told, "conversation-faults", light)
    lines = told.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.substring("role", 1, 1).alias("initial"), "fault")
    pieces = materialize(lines.mapInArrow(lambda batches: piece_items(batches, piece_rows), PIECE), "conversation-pieces", told)
    whole = F.col("ends")[0] == -1
    single = pieces.where(whole).select("conv_id", "blank", "duplicate", "truncated", "illegal", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))
    parts = pieces.where(~whole).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return single.unionByName(parts.mapInArrow(join_pieces, REPAIR))


def repaired(conversations: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation, once damaged."""
    rows = damaged(conversations)
    there = rows.where("kind <> 0").select("conv_id", "turn", "role", "text")
    found = materialize(repairs(there, piece_rows), "conversation-repairs")
    head = found.select("conv_id", F.lit(0).alias("row"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit("").alias("text"), F.col("audit").alias("letters"))
    body = there.select("conv_id", F.lit(1).alias("row"), "turn", "role", _digest().alias("digest"), "text", F.lit("").alias("letters"))
    stream = head.unionByName(body).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "row", *_order())
    hashes = stream.select("conv_id", "letters", "role", "text").mapInArrow(hash_repaired, "conv_id long, repaired_sha256 string")
    turn = F.when(F.col("kind") != 0, F.col("turn"))
    spans = _gaps(rows.select("conv_id", turn.alias("turn")))
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    every = spans.unionByName(found, allowMissingColumns=True).unionByName(hashes, allowMissingColumns=True)
    out = every.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in ("gaps", *counts, "audit", "repaired_sha256")))
    zeros = (F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *counts))
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _gaps(rows: DataFrame) -> DataFrame:
    """conv_id and gaps: turns missing between the first and the last."""
    each = rows.groupBy("conv_id", "turn").agg(F.lit(0).alias("none")).groupBy("conv_id")
    return each.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0).cast("long")).alias("gaps"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(load(spark, sf_dir, "conversations"))


def _repair_sql() -> str:
    """The same by tables: a row of four strings (cost, letters) a step, and the chosen letters replayed."""
    add = lambda s, letters, cost: f"lpad(CAST(CAST(left({s}, 8) AS BIGINT) + {cost} AS VARCHAR), 8, '0') || substr({s}, 9) || '{letters}'"
    when = lambda test, value: f"CASE WHEN {test} THEN {value} END"
    stays = "fault NOT IN (1, 2)"
    from_any = lambda letter, cost: ", ".join(add(b, letter, cost) for b in ("b0", "b1", "c3"))
    empty = lambda b: when(f"{stays} AND ini = ''", add(b, "K", "more"))
    return rf"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
bytes AS (SELECT *, flatten(list_transform(range(1, len(name) + 1), lambda i: [CAST(ascii(substr(name, i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])) AS b FROM src),
kinds AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) % 2))), 4294967295) % 20 AS kind FROM bytes),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
keyed AS (SELECT *, sha256(CAST(len(role) AS VARCHAR) || ':' || role || text) AS digest FROM damaged),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, digest ORDER BY i) AS times FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS i FROM keyed)),
faults AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN times > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM placed),
best(conv_id, i, b0, b1, b2, b3) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '00000000', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM faults
    UNION ALL SELECT conv_id, i, least({add('b0', 'D', 4)}, {empty('b0')}), least({add('b1', 'D', 4)}, {when(f"{stays} AND ini = 's'", add('b0', 'K', 'more'))}, {empty('b1')}),
        least({add('c2', 'D', 4)}, {when(f"{stays} AND ini = 'u'", f"least({from_any('K', 'more')})")}, {when(stays, f"least({from_any('R', '3 + more')})")}, {empty('c2')}),
        least({add('c3', 'D', 4)}, {when(f"{stays} AND ini = 'a'", add('c2', 'K', 'more'))}, {when(stays, add('c2', 'R', '3 + more'))}, {empty('c3')})
    FROM (SELECT *, least(b3, {add('c2', 'I', 3)}) AS c3, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS more FROM (SELECT f.*, b0, b1, b3, least(b2, {add('b0', 'I', 3)}, {add('b1', 'I', 3)}, {add('b3', 'I', 3)}) AS c2
        FROM best JOIN faults f ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND f.i = best.i + 1))),
goals AS (SELECT conv_id, least(b0, b3, {add('b2', 'I', 3)}, {add('b1', 'II', 6)}) AS goal FROM best WHERE (conv_id, i) IN (SELECT (conv_id, max(i)) FROM faults GROUP BY conv_id) OR conv_id IS NULL AND i = (SELECT max(i) FROM faults WHERE conv_id IS NULL)),
repairs AS (SELECT conv_id, CAST(left(goal, 8) AS BIGINT) AS cost, substr(goal, 9) AS audit FROM goals),
replay(conv_id, p, i, st, n, lines) AS (SELECT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), '' FROM repairs
    UNION ALL SELECT conv_id, p + 1, CASE WHEN letter = 'I' THEN i ELSE i + 1 END, CASE letter WHEN 'D' THEN st WHEN 'K' THEN CASE WHEN ini = '' THEN st ELSE ini END ELSE left(turned, 1) END, CASE WHEN letter = 'D' THEN n ELSE n + 1 END,
        CASE WHEN letter = 'D' THEN lines ELSE lines || CASE WHEN n > 0 THEN chr(10) ELSE '' END || CASE letter WHEN 'I' THEN turned || ':' WHEN 'K' THEN role || ':' || text ELSE turned || ':' || text END END
    FROM (SELECT r.*, substr(q.audit, CAST(r.p + 1 AS BIGINT), 1) AS letter, CASE WHEN r.st = 'u' THEN 'assistant' ELSE 'user' END AS turned, f.role, f.text, f.ini FROM replay r JOIN repairs q ON q.conv_id IS NOT DISTINCT FROM r.conv_id AND r.p < len(q.audit)
        LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1)),
texts AS (SELECT r.conv_id, sha256(lines) AS repaired_sha256, cost, audit FROM replay r JOIN repairs q ON q.conv_id IS NOT DISTINCT FROM r.conv_id AND r.p = len(q.audit)),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated FROM faults GROUP BY conv_id),
illegals AS (SELECT conv_id, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT conv_id, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM faults) GROUP BY conv_id),
everyone AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
    CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM everyone e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN illegals l ON l.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""


SQL = _repair_sql()
