"""Conversation structure repair by dynamic programming.

A conversation's turns are edited at the least cost so that their roles follow
a grammar: perhaps a system turn, then user and assistant in turn. The cost to
go is found backwards over turn and grammar state; a greedy forward walk then
takes the ASCII-least edit among those that keep the cost tight. Duplicates and
other faults are found by aggregates over digests. Turns reach Python sorted and
pass by as a stream: of a conversation one byte a turn is held (as the audit in
its result row holds), never its texts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.lines import SPACE

#: Costs of edits; a truncated turn that is not deleted adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Grammar states: nothing yet, after system, after user, after assistant; the role each awaits, and the state that role leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
AWAITED, THEN = ("user", "user", "assistant", "user"), (USER, USER, ASSISTANT, USER)
INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER = 3
#: Turn classes: sound, truncated, to be deleted.
SOUND, CUT_SHORT, DOOMED = range(3)
#: Cost to go after the last turn, and the edit there.
AT_END, END_EDITS = (0, 6, 3, 0), (None, "I", "I", None)


def backward(code: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
    """Cost to go and best edit in each state before a turn, from the costs after it. ``code`` is initial + 4 * class."""
    initial, kind = code % 4, code // 4
    extra = TRUNCATED if kind == CUT_SHORT else 0
    ways: list[dict[str, int]] = []
    for state in range(4):
        way = {"D": DELETE + after[state]}
        if kind != DOOMED:
            way["R"] = REROLE + extra + after[THEN[state]]
            if initial == INITIALS[AWAITED[state][0]]:
                way["K"] = extra + after[THEN[state]]
            elif state == START and initial == 0:
                way["K"] = extra + after[SYSTEM]
        ways.append(way)
    plain = [min(way.values()) for way in ways]
    cost = list(plain)
    for state in (USER, ASSISTANT, START, SYSTEM):  # two insertions in a row would come back to where they began
        follow = plain[THEN[state]] if state in (USER, ASSISTANT) else cost[USER]
        ways[state]["I"] = INSERT + follow
        cost[state] = min(plain[state], INSERT + follow)
    return tuple(cost), "".join(min(e for e, c in way.items() if c == cost[s]) for s, way in enumerate(ways))


class Planner:
    """Finds cost and audit of coded conversations.

    Costs to go are kept relative to the least of them, so few vectors occur,
    and steps are remembered by turn code and vector.
    """

    def __init__(self) -> None:
        self.steps: dict[tuple[int, tuple[int, ...]], tuple[int, tuple[int, ...], int]] = {}
        self.edits: list[str] = []

    def step(self, code: int, after: tuple[int, ...]) -> tuple[int, tuple[int, ...], int]:
        found = self.steps.get((code, after))
        if found is None:
            cost, edits = backward(code, after)
            least = min(cost)
            found = self.steps[code, after] = (len(self.edits), tuple(c - least for c in cost), least)
            self.edits.append(edits)
        return found

    def plan(self, codes: bytes) -> tuple[int, str]:
        """The least cost and its ASCII-least audit."""
        vector, total, best = AT_END, 0, array("H", bytes(2 * len(codes)))
        for i in range(len(codes) - 1, -1, -1):
            best[i], vector, least = self.step(codes[i], vector)
            total += least
        cost, state, audit = total + vector[START], START, []
        for i, code in enumerate(codes):
            edits = self.edits[best[i]]
            while (edit := edits[state]) == "I":
                audit.append(edit)
                state = THEN[state]
            audit.append(edit)
            if edit != "D":
                state = SYSTEM if edit == "K" and code % 4 == 0 else THEN[state]
        while (edit := END_EDITS[state]) is not None:
            audit.append(edit)
            state = THEN[state]
        return cost, "".join(audit)


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns with faults put in by crc32 of ``conv:turn`` modulo 20, and ``copies``: 0 for a dropped turn, 2 for a repeated one.

    0 drops, 1 empties the text, 2 removes its ``.!?``, 3 repeats, 4 makes the
    role user. Nulls in the key, the role and the text are one space.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (conv_col, turn_col)])
    fate = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit(" ")) for c in (role_col, text_col))
    return turns.select(
        F.col(f"`{conv_col}`").alias(conv_col),
        F.col(f"`{turn_col}`").alias(turn_col),
        F.when(fate == 4, F.lit("user")).otherwise(role).alias(role_col),
        F.when(fate == 1, F.lit("")).when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias(text_col),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _rows(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies_col: str | None) -> DataFrame:
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit(" ")) for c in (role_col, text_col))
    copies = F.col(f"`{copies_col}`").cast("long") if copies_col else F.lit(1).cast("long")
    return turns.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"),
        F.xxhash64(role, text).alias("d1"), F.xxhash64(text, F.lit(1), role).alias("d2"),
    )


def _marked(rows: DataFrame) -> DataFrame:
    """One row for equal turns of one number: initial, fault (0 none, 1 blank, 2 truncated), again (seen at an earlier number), copies."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    initial: Column = F.substring("role", 1, 1)
    coded = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    fault = F.when(bare == "", 1).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(2)
    equal = rows.groupBy("conv", "turn", "d1", "d2", coded.alias("initial"), fault.alias("fault")).agg(F.sum("copies").alias("copies"))
    seen = (
        equal.where("copies > 0")
        .groupBy(F.col("conv").alias("of"), F.col("d1").alias("e1"), F.col("d2").alias("e2"))
        .agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("nameless"), F.count("*").alias("n"))
        .where("n > 1")
    )
    same = F.col("conv").eqNullSafe(F.col("of")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))
    again = F.col("turn").isNotNull() & (F.col("nameless") | (F.col("turn") > F.col("first")))
    return equal.join(seen, same, "left").select("conv", "turn", "d1", "d2", "initial", "fault", F.coalesce(again, F.lit(False)).alias("again"), "copies")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Tally:
    """Counts and codes of the conversation that passes by."""

    def __init__(self, conv):
        self.conv, self.codes, self.last = conv, bytearray(), None
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first_turn = self.turn = None

    def add(self, turn, initial, fault, again, copies):
        if not copies:
            return
        if turn is not None and turn != self.turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turn, self.distinct = turn, self.distinct + 1
        if self.last is not None and (self.last, initial) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.illegal += copies - 1  # no role may follow itself
        self.last = initial
        doomed = initial + 4 * DOOMED
        if fault == 1:
            self.blank += copies
            self.codes += bytes([doomed]) * copies
            return
        fresh = 0 if again else 1
        self.duplicate += copies - fresh
        if fresh:
            self.truncated += fault == 2
            self.codes.append(initial + 4 * (CUT_SHORT if fault == 2 else SOUND))
        self.codes += bytes([doomed]) * (copies - fresh)

    def row(self, planner: Planner) -> tuple:
        cost, audit = planner.plan(bytes(self.codes))
        gaps = 0 if self.turn is None else self.turn - self.first_turn + 1 - self.distinct
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


#: Result rows sent at once.
SEND_ROWS = 512


def _sent(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == SEND_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_KINDS = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _schema(columns: list[tuple[str, str]]) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in columns])


def _in_order(df: DataFrame, *order: str) -> DataFrame:
    """Conversations dealt by key, rows in order: what follows sees them as a stream."""
    return df.repartition("conv").sortWithinPartitions("conv", *order)


def audits(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """Faults, least cost and audit of every conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit.

    See ``repaired`` for what they mean. No texts are shuffled here, only digests.
    """
    kind = "long" if turns.schema[conv_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else "string"
    marked = _marked(_rows(turns, conv_col, turn_col, role_col, text_col, copies_col)).withColumn("conv", F.col("conv").cast(kind))
    columns = [("conv", kind), *((c, "long") for c in COUNTS), ("audit", "string")]
    schema = _schema(columns)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        planner, tally = Planner(), None
        for conv, turn, _, _, initial, fault, again, copies in _streamed(batches):
            if tally is None or conv != tally.conv:
                if tally is not None:
                    yield tally.row(planner)
                tally = _Tally(conv)
            tally.add(turn, initial, fault, again, copies)
        if tally is not None:
            yield tally.row(planner)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sent(told(batches), schema)

    return _in_order(marked, "turn", "d1", "d2").mapInArrow(step, ", ".join(f"{n} {k}" for n, k in columns))


def rewrite(audit: str, rows: Iterator[tuple[str, str, int]]) -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) of each step of an audit over the rows (role, text, copies); deleted turns have no role."""
    at, state = 0, START
    for role, text, copies in rows:
        for _ in range(copies):
            while audit[at] == "I":
                yield "I", AWAITED[state], ""
                at, state = at + 1, THEN[state]
            edit, at = audit[at], at + 1
            if edit == "D":
                yield edit, None, None
            elif edit == "K":
                yield edit, role, text
                state = SYSTEM if role[:1] == "s" else THEN[state]
            else:
                yield edit, AWAITED[state], text
                state = THEN[state]
    for edit in audit[at:]:
        yield edit, AWAITED[state], ""
        state = THEN[state]


def _with_audits(turns: DataFrame, found: DataFrame, *names: str) -> DataFrame:
    """Each conversation as a stream: its audit first, then its turns."""
    kind = dict(found.dtypes)["conv"]
    head = F.struct(*COUNTS, "audit")
    rows = _rows(turns, *names).where("copies > 0").withColumn("conv", F.col("conv").cast(kind))
    heads = found.select("conv", F.lit(0).alias("part"), head.alias("head"))
    bodies = rows.select("conv", F.lit(1).alias("part"), "turn", "d1", "d2", "role", "text", "copies")
    both = heads.unionByName(bodies, allowMissingColumns=True).select("conv", "part", "turn", "d1", "d2", "role", "text", "copies", "head")
    return _in_order(both, "part", "turn", "d1", "d2")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict, Iterator[tuple]]]:
    """(conv, head, its turns as they come) one after another; turns must be read before the next conversation."""
    for conv, rows in groupby(_streamed(batches), key=lambda r: (r[0],)):
        head = next(rows)[8]
        yield conv[0], head, ((r[5], r[6], r[7]) for r in rows)


def repaired(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """Every conversation's faults, least cost, audit and repaired_sha256.

    Turns are taken by number, nulls first, turns that share one by a hash. A
    turn's first fault counts: blank (white space alone), duplicate (role and
    text seen earlier in the conversation), truncated (no ``.!?`` at the end).
    gaps counts absent numbers between the least and the greatest, illegal the
    neighbours whose role initials are not su, ua or au. Edits: Keep 0, Rerole
    to user or assistant 3, Delete 4 (blank and duplicate turns must go),
    Insert an empty user or assistant turn 3; a truncated turn that stays adds
    3. The edited roles' initials are ``(s?(ua)+)?``. The audit holds the
    edits' initials, ties ASCII-least; repaired_sha256 is that of the repaired
    ``role:text`` lines.

    ``copies_col`` tells how often a row stands there; a conversation all of
    whose rows stand nowhere has zeros, an empty audit and the digest of no
    bytes. Null roles and texts are one space; null conversations are one; an
    empty role and any initial but s, u and a can only be changed or deleted.
    Repeated turns are summed up before the shuffle. A conversation's texts
    pass through one task as a stream, as its digest demands; one byte a turn is
    held. Other columns are left out. An empty table gives no rows.
    """
    names = (conv_col, turn_col, role_col, text_col, copies_col)
    found = audits(turns, *names)
    kind = dict(found.dtypes)["conv"]
    columns = [(conv_col, kind), *((c, "long") for c in COUNTS), ("audit", "string"), ("repaired_sha256", "string")]
    schema = _schema(columns)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, head, rows in _conversations(batches):
            digest, between = hashlib.sha256(), b""
            for _, role, text in rewrite(head["audit"], rows):
                if role is not None:
                    digest.update(between + f"{role}:{text}".encode())
                    between = b"\n"
            yield (conv, *(head[c] for c in COUNTS), head["audit"], digest.hexdigest())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sent(told(batches), schema)

    return _with_audits(turns, found, *names).mapInArrow(step, ", ".join(f"`{n}` {k}" for n, k in columns))


def rebuilt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """The turns of every repaired conversation: conv_col, position (from 0), edit, role_col and text_col.

    Rules and edge cases are those of ``repaired``; a conversation that is
    empty after its repair has no rows.
    """
    names = (conv_col, turn_col, role_col, text_col, copies_col)
    found = audits(turns, *names)
    columns = [(conv_col, dict(found.dtypes)["conv"]), ("position", "long"), ("edit", "string"), (role_col, "string"), (text_col, "string")]
    schema = _schema(columns)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, head, rows in _conversations(batches):
            kept = (x for x in rewrite(head["audit"], rows) if x[1] is not None)
            yield from ((conv, at, *x) for at, x in enumerate(kept))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sent(told(batches), schema)

    return _with_audits(turns, found, *names).mapInArrow(step, ", ".join(f"`{n}` {k}" for n, k in columns))


def _sql() -> str:
    """The repair in SQL: least pairs of cost and audit of each grammar state, carried forward by recursion over the turns."""

    def put(state: int, cost: str, edit: str, line: str = "''") -> str:
        return f"{{'c': s{state}.c + {cost}, 'a': s{state}.a || '{edit}', 'x': s{state}.x || {line}}}"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def insertions(source: str, columns: str) -> str:
        user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
        first = f"SELECT * REPLACE ({least('s2', *[put(q, '3', 'I', user) for q in (START, SYSTEM, ASSISTANT)])} AS s2) FROM {source}"
        return f"SELECT {columns} REPLACE ({least('s3', put(USER, '3', 'I', assistant))} AS s3) FROM ({first})"

    never = "{'c': 1000000000::BIGINT, 'a': '', 'x': ''}"
    stays = lambda ways, test: f"CASE WHEN {test} THEN {least(*ways)} ELSE {never} END"
    keep = lambda q: put(q, "more", "K", "chr(10) || role || ':' || text")
    role = lambda q: put(q, "3 + more", "R", f"chr(10) || '{AWAITED[q]}:' || text")
    begin = (START, SYSTEM, ASSISTANT)
    steps = [
        put(START, "4", "D"),
        least(put(SYSTEM, "4", "D"), stays([keep(START)], "NOT doomed AND initial = 's'")),
        least(put(USER, "4", "D"), stays([keep(q) for q in begin], "NOT doomed AND initial = 'u'"), stays([role(q) for q in begin], "NOT doomed")),
        least(put(ASSISTANT, "4", "D"), stays([keep(USER)], "NOT doomed AND initial = 'a'"), stays([role(USER)], "NOT doomed")),
    ]
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc
  FROM (SELECT unnest(range(256)) AS n)),
f AS (
  SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(COALESCE(conv_id::VARCHAR, ' ') || ':' || COALESCE(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT)),
                         lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fate
  FROM conversations, bits),
d AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial, trim(text, {white}) AS bare FROM d),
t AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(bare, 1) IN ('.', '!', '?') THEN '' ELSE 'truncated' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS two
  FROM r),
u AS (SELECT *, fault IN ('blank', 'duplicate') AS doomed, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM t),
n AS (
  SELECT conv_id, MAX(i) AS n, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (fault = 'blank') AS blank,
         COUNT(*) FILTER (fault = 'duplicate') AS duplicate, COUNT(*) FILTER (fault = 'truncated') AS truncated,
         COUNT(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM u GROUP BY conv_id),
w AS (
  SELECT n.*, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'x': ''}} AS s0, {never} AS s1, {never} AS s2, {never} AS s3 FROM n
  UNION ALL
  SELECT {", ".join(f"w.{c}" for c in ("conv_id", "n", "gaps", "blank", "duplicate", "truncated", "illegal"))}, u.i, {", ".join(steps)}
  FROM ({insertions("w", "*")}) w JOIN u ON u.conv_id IS NOT DISTINCT FROM w.conv_id AND u.i = w.i + 1),
b AS (SELECT *, {least("s0", "s3")} AS best FROM ({insertions("w", "*")}) WHERE i = n)
SELECT c.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated,
       COALESCE(illegal, 0) AS illegal, COALESCE(best.c, 0) AS cost, COALESCE(best.a, '') AS audit, sha256(COALESCE(substr(best.x, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""


SQL = _sql()
