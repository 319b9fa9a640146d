"""Repair of conversations: the cheapest edits that make the roles an optional system turn, then user and assistant in turn.

Rows are repartitioned by conversation, sorted by turn and streamed through mapInPandas; what a task carries from one Arrow batch to the next is a small
dynamic program: for each of four places in the grammar the cost of the cheapest edits so far and their order as text. Costs count from
the least one, and places that can't be part of a cheapest repair any more are dropped, so few such states exist, and a row is a lookup once its
step has been made. Backpointers take four bytes a row. A conversation beyond SPILL_BYTES of texts, or SPILL_ROWS rows, goes to unnamed files of the task
in Spark's local folder, as a sort's spill does; a lost executor costs a rerun of its tasks, which write their own. So memory does not grow with a
conversation's length, except for its audit, one letter an edit.

Edits: Keep (0), Rerole to user or assistant (3), Delete (4; the only one for blank and duplicate rows), Insert a user or assistant turn without text (3); truncated
rows that stay cost 3 more. Of equally cheap repairs the one with the least audit in ASCII order counts.

Two orderings of the same edits end at different letters, so the audits of two places never begin one another, and their ranks tell the order of all
that follows.

Defined cases: null roles and texts, and null parts of the key that damage is drawn by, count as one space, so rows with null texts are blank; rows with equal turns are ordered by role, then text; a null turn comes
first; a null conv_id is a conversation of its own; repeated rows are duplicates of the first; roles go by their first letter, an empty one
is illegal; very long texts and conversations are read whole; other columns are left out of results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairforge.llm.tables import table

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
REROLE, DELETE, INSERT, LATE = 3, 4, 3, 3
SPILL_BYTES, SPILL_ROWS, OUT_ROWS = 32 << 20, 1 << 20, 1024

#: Places in the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn. (Place, first letter of a role) -> place.
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
TURN = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
#: The place after an inserted turn, and how many of them end a conversation.
NEXT = {p: GRAMMAR[p, TURN[p][0]] for p in TURN}
TO_END = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: A place that costs more than another one and the edits that make up for the difference is in no cheapest repair: (place, other): the edits' most cost.
DOMINATED = {
    (START, SYSTEM): 10, (START, USER): 7, (START, ASSISTANT): 4, (SYSTEM, START): 0, (SYSTEM, USER): 3, (SYSTEM, ASSISTANT): 0, (USER, ASSISTANT): 3, (ASSISTANT, USER): 3,
}
LETTERS = "DKR"

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Steps:
    """States of the dynamic program, numbered as they occur. A state: ((cost or None, rank of the audit) of each place)."""

    def __init__(self):
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.known: dict[tuple[int, str, int], tuple[int, int, int]] = {}
        self.first = self._number(((0, 0), None, None, None))

    def _number(self, state: tuple) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
        return self.numbers[state]

    def step(self, number: int, initial: str, fault: int) -> tuple[int, int, int]:
        """(next state, what the least cost grows by, backpointers: a byte a place of the place before, the inserts and the edit)."""
        key = (number, initial, fault)
        if key not in self.known:
            self.known[key] = self._made(*key)
        return self.known[key]

    def _made(self, number: int, initial: str, fault: int) -> tuple[int, int, int]:
        best: dict[int, tuple] = {}

        def offer(to: int | None, *what) -> None:
            if to is not None and (to not in best or what < best[to]):
                best[to] = what

        for p, known in enumerate(self.states[number]):
            q = p
            for inserts in range(3) if known else ():
                cost, rank = known[0] + INSERT * inserts, known[1]
                offer(q, cost + DELETE, rank, "I" * inserts + "D", p)
                if fault not in (BLANK, DUPLICATE):
                    late = LATE if fault == TRUNCATED else 0
                    offer(GRAMMAR.get((q, initial)), cost + late, rank, "I" * inserts + "K", p)
                    offer(NEXT[q], cost + REROLE + late, rank, "I" * inserts + "R", p)
                q = NEXT[q]
        costs = {to: w[0] for to, w in best.items()}
        stay = {to: w for to, w in best.items() if not any(costs[to] > costs[o] + DOMINATED.get((to, o), 1 << 30) for o in costs)}
        least = min(w[0] for w in stay.values())
        order = sorted(stay, key=lambda to: stay[to][1:3])
        back = sum((p | len(edits) - 1 << 2 | LETTERS.index(edits[-1]) << 4) << 8 * to for to, (_, _, edits, p) in stay.items())
        return self._number(tuple((stay[to][0] - least, order.index(to)) if to in stay else None for to in range(4))), least, back

    def end(self, number: int) -> tuple[int, int]:
        """(added cost, place) of the cheapest end."""
        cost, _, place = min((known[0] + INSERT * TO_END[p], known[1], p) for p, known in enumerate(self.states[number]) if known)
        return cost, place


def _task_file():
    """A file without a name in Spark's local folder; gone with the task."""
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)


class Conversation:
    """What a task knows of the conversation that it reads."""

    def __init__(self, conv_id, steps: Steps):
        self.conv_id, self.steps, self.state = conv_id, steps, steps.first
        self.cost = self.illegal = self.turns = self.bytes = self.n = 0
        self.faults = [0, 0, 0, 0]
        self.low = self.high = self.initial = None
        self.back, self.rows = array("I"), []
        self.back_file = self.rows_file = None

    def add(self, turn, role: str, text: str, fault: int, copies: int) -> None:
        if copies and turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        initial = role[:1]
        for k in range(copies):
            fault = DUPLICATE if k and fault != BLANK else fault
            self.faults[fault] += 1
            self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
            self.initial = initial
            self.state, more, back = self.steps.step(self.state, initial, fault)
            self.cost += more
            self.back.append(back)
            self.rows.append((turn, role, text))
            self.n += 1
            self.bytes += len(text) + 32
        if self.bytes > SPILL_BYTES or len(self.rows) > SPILL_ROWS:
            self.spill()

    def spill(self) -> None:
        if self.rows_file is None:
            self.rows_file, self.back_file = _task_file(), _task_file()
        pickle.dump(self.rows, self.rows_file, pickle.HIGHEST_PROTOCOL)
        self.back.tofile(self.back_file)
        self.rows, self.back, self.bytes = [], array("I"), 0

    def _edits(self) -> tuple[np.ndarray, int]:
        """A byte a row, (inserts before it) << 2 | edit, and the number of inserts at the end; and adds the end's cost. Walks the backpointers from the last."""
        more, place = self.steps.end(self.state)
        self.cost += more
        inserts = TO_END[place]
        if self.back_file is None:
            back, out = np.frombuffer(self.back, np.uint32) if self.n else np.empty(0, np.uint32), np.empty(self.n, np.uint8)
        else:
            self.spill()
            self.back_file.flush()
            back = np.memmap(self.back_file, np.uint32, "r", shape=(self.n,))
            out = np.memmap(_task_file(), np.uint8, "w+", shape=(self.n,))
        for end in range(self.n, 0, -SPILL_ROWS):
            begin = max(0, end - SPILL_ROWS)
            found = bytearray(end - begin)
            for i, b in zip(range(end - begin - 1, -1, -1), back[begin:end][::-1].tolist(), strict=True):
                b = b >> 8 * place & 255
                place, found[i] = b & 3, b >> 2
            out[begin:end] = np.frombuffer(found, np.uint8)
        return out, inserts

    def _read(self) -> Iterator[tuple]:
        if self.rows_file is not None:
            self.rows_file.seek(0)
            for _ in range(self.n):
                try:
                    yield from pickle.load(self.rows_file)
                except EOFError:
                    return
        else:
            yield from self.rows

    def repaired(self) -> Iterator[tuple[str, object, str | None, str]]:
        """(edit, turn, role, text) of every edit in order; role is null for deleted rows. Sets cost to the whole cost."""
        edits, inserts = self._edits()
        place = START
        for (turn, role, text), e in zip(self._read(), (int(x) for x in edits), strict=True):
            for _ in range(e & 3):
                yield "I", None, TURN[place], ""
                place = NEXT[place]
            edit = LETTERS[e >> 2]
            if edit == "D":
                yield "D", turn, None, text
                continue
            role = TURN[place] if edit == "R" else role
            yield edit, turn, role, text
            place = GRAMMAR[place, role[:1]]
        for _ in range(inserts):
            yield "I", None, TURN[place], ""
            place = NEXT[place]

    def report(self) -> tuple:
        audit, digest, some = [], hashlib.sha256(), False
        for edit, _, role, text in self.repaired():
            audit.append(edit)
            if role is not None:
                digest.update(f"{chr(10) if some else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                some = True
            if len(audit) > SPILL_ROWS:
                audit = ["".join(audit)]
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        return self.conv_id, gaps, *self.faults[BLANK:], self.illegal, self.cost, "".join(audit), digest.hexdigest()


def damage(conversations: DataFrame) -> DataFrame:
    """conversations with planted faults: (conv_id, turn, role, text, copies). crc32 of `conv_id:turn` modulo 20: 0 drops the row (no copies), 1 empties its
    text, 2 removes . ! and ?, 3 repeats it, 4 makes it the user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), F.pmod(F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")), F.lit(20)).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).alias("copies"))


def _streamed(rows: DataFrame) -> DataFrame:
    """rows with fault, in the order in which a task reads them: one shuffle, by conversation; the window for duplicates uses its partitions and only sorts."""
    blank = ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), F.lit(1))
    part = lambda c: F.coalesce(c, F.lit(" "))
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), part(F.col("role")).alias("role"), part(F.col("text")).alias("text"), copies.cast("int").alias("copies"))
    rows = rows.withColumn("text", F.when(F.col("copies") > 0, F.col("text")).otherwise(""))
    rows = rows.withColumn("same", F.when(F.col("copies") > 0, F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256))).repartition("conv_id")
    earlier = F.row_number().over(W.partitionBy("conv_id", "same").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(blank, BLANK).when(earlier, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    ordered = rows.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault")).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "fault")
    # Numbers with nulls would reach pandas as floats, so these two travel as text.
    return ordered.withColumns({"conv_id": F.col("conv_id").cast("string"), "turn": F.col("turn").cast("string")})


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[Conversation]:
    """Whole conversations, each read through as many batches as it takes."""
    steps, now = Steps(), None
    for pdf in batches:
        for conv_id, turn, role, text, copies, fault in zip(*(pdf[c].tolist() for c in ("conv_id", "turn", "role", "text", "copies", "fault")), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield now
                now = Conversation(conv_id, steps)
            now.add(None if turn is None else int(turn), role, text, fault, copies)
    if now is not None:
        yield now


def _in_frames(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) == OUT_ROWS:
            yield pd.DataFrame(out, columns=names, dtype=object)
            out = []
    if out:
        yield pd.DataFrame(out, columns=names, dtype=object)


def repair_report(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text), and optionally copies, how often a row is there (0: its conversation is reported without it)
    -> (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row a conversation."""
    names = ["conv_id", *[f.split()[0] for f in REPORT.split(", ")]]
    out = _streamed(rows).mapInPandas(lambda b: _in_frames((c.report() for c in _conversations(b)), names), f"conv_id string, {REPORT}")
    return out.withColumn("conv_id", F.col("conv_id").cast(dict(rows.dtypes)["conv_id"]))


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, position from 0, edit: K, R or I, turn: null for inserted ones, role, text)."""

    def kept(c: Conversation) -> Iterator[tuple]:
        for k, (edit, turn, role, text) in enumerate(r for r in c.repaired() if r[2] is not None):
            yield c.conv_id, k, edit, turn, role, text

    schema = "conv_id string, position long, edit string, turn long, role string, text string"
    names = ["conv_id", "position", "edit", "turn", "role", "text"]
    out = _streamed(rows).mapInPandas(lambda b: _in_frames((r for c in _conversations(b) for r in kept(c)), names), schema)
    return out.withColumn("conv_id", F.col("conv_id").cast(dict(rows.dtypes)["conv_id"]))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damage(table(spark, sf_dir, "conversations")))


def sql() -> str:
    """DuckDB SQL: a recursive query carries (cost, audit, repaired text) of each place of the grammar from row to row; the least one counts as it stands."""
    crc_step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)"
    never = "{'c': 1000000000000::BIGINT, 't': '', 'r': ''}"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    line = lambda p, who: f"{p}.r || CASE WHEN {p}.r = '' THEN '' ELSE chr(10) END || {who}"
    put = lambda p, role: f"{{'c': {p}.c + {INSERT}, 't': {p}.t || 'I', 'r': {line(p, repr(role + ':'))}}}"
    late = f"CASE fault WHEN {TRUNCATED} THEN {LATE} ELSE 0 END"

    def edit(p: str, letter: str) -> str:
        """Of a row that ends at a user or assistant turn (or, kept, at any)."""
        role = {"K": "role", "U": "'user'", "A": "'assistant'"}[letter]
        cost = late if letter == "K" else f"{REROLE} + {late}"
        made = f"{{'c': {p}.c + {cost}, 't': {p}.t || '{'K' if letter == 'K' else 'R'}', 'r': {line(p, role + " || ':' || text")}}}"
        return f"CASE WHEN fault IN (0, {TRUNCATED}) THEN {made} ELSE {never} END"

    keep = lambda p, x: f"CASE WHEN x = '{x}' THEN {edit(p, 'K')} ELSE {never} END"
    drop = lambda p: f"{{'c': {p}.c + {DELETE}, 't': {p}.t || 'D', 'r': {p}.r}}"
    before_user = ["p0", "p1", "p3"]
    return f"""
WITH RECURSIVE bits(i, c, n) AS (
  SELECT i::UBIGINT, i::UBIGINT, 0 FROM range(256) r(i) UNION ALL SELECT i, {crc_step}, n + 1 FROM bits WHERE n < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE n = 8),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations),
d AS (SELECT h.* EXCLUDE (h), CAST(xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, [CAST('0x' || substr(h, 2 * i + 1, 2) AS UBIGINT) FOR i IN range(length(h) // 2)]),
    lambda c, x: xor(c >> 8, t[CAST(xor(c & 255::UBIGINT, x) AS BIGINT) + 1]))) AS BIGINT) % 20 AS k FROM h, crc),
r AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS c FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, c) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, c) AS nth, substr(role, 1, 1) AS x FROM r),
f AS MATERIALIZED (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS x0,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN {BLANK} WHEN nth > 1 THEN {DUPLICATE} WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 0 ELSE {TRUNCATED} END AS fault FROM o),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = {BLANK}) AS blank, count(*) FILTER (fault = {DUPLICATE}) AS duplicate,
  count(*) FILTER (fault = {TRUNCATED}) AS truncated, count(*) FILTER (x0 IS NOT NULL AND x0 || x NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
st AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 't': '', 'r': ''}} AS p0, {never} AS p1, {never} AS p2, {never} AS p3 FROM conversations
  UNION ALL
  SELECT conv_id, i, {drop("p0")}, {least(drop("p1"), keep("p0", "s"))},
    {least(drop("p2"), *[keep(p, "u") for p in before_user], *[edit(p, "U") for p in before_user])}, {least(drop("p3"), keep("p2", "a"), edit("p2", "A"))}
  FROM (SELECT * EXCLUDE (p3), {least("p3", put("p2", "assistant"))} AS p3 FROM (
    SELECT f.*, p0, p1, p3, {least("p2", put("p0", "user"), put("p1", "user"), put("p3", "user"))} AS p2 FROM st JOIN f ON f.conv_id IS NOT DISTINCT FROM st.conv_id AND f.i = st.i + 1))),
e AS (SELECT conv_id, {least("p0", "p3", put("p2", "assistant"), put("q1", "assistant"))} AS best FROM (
  SELECT st.*, {put("p1", "user")} AS q1 FROM st LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM st.conv_id WHERE i = coalesce(n, 0)))
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c AS cost, best.t AS audit, sha256(best.r) AS repaired_sha256
FROM e LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
"""
