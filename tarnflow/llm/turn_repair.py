"""Operator 12: cheapest repair of the turn structure of conversations by secondary-sorted streaming.

The turns of a conversation go to one task, sorted backwards. They stream past in Arrow batches while a dynamic program over
the states of ``(s?(ua)+)?`` carries the cost from here to the end, four numbers, from batch to batch, and leaves one byte
with each turn: the best edit in each of the four states, two bits each. These compact backpointers spill where Spark's
sort spills: the same task sorts its rows forwards again, without a shuffle, and follows the bytes from the first turn, so
a conversation of any length holds four numbers and one sum of its text in memory, besides its audit, which is its result.

Going backwards, the smallest letter among the cheapest edits of a state starts the smallest of its cheapest audits, since a
letter leads to one next state only: the role that the pattern asks for next.

A turn that repeats an earlier one is found by its number among equal turns of the conversation, in a window over the same
partitions, so also without another shuffle or a set that grows.

Defined results: turns are ordered by number (nulls first), then role and text as they are to be repaired; a null role or text
is one space; a null turn or conversation id counts as one space in the damage's key; turns without a conversation id are
one conversation of their own, whose id stays null; a conversation whose turns are all dropped has a row of zeros; an empty
table gives an empty result; further columns are ignored; texts may have any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, table

#: States: nothing yet, after a system turn, after a user's, after an assistant's. The role that a reroled or new turn takes in
#: each, and the state after it; the state after a kept turn by its role's initial.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Edits in ASCII order; their places in it are the two bits of a backpointer.
DELETE, INSERT, KEEP, REROLE = range(4)
LETTERS = "DIKR"
COST = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
TRUNCATED_COST = 5
LEGAL = ("su", "ua", "au")
#: Costs to the end, and the byte, after the last turn: new turns finish what is open.
LAST = [0, 2 * COST[INSERT], COST[INSERT], 0]
BLANK, DUPLICATE, TRUNCATED, FINE, DROPPED = range(5)
_TURN = "key string, turn string, role string, text string, fault int, nth int"


def step(ahead: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int]:
    """Costs to the end from before a turn in each state, and its backpointers, from the costs after it."""
    more = TRUNCATED_COST if fault == TRUNCATED else 0
    edits = []
    for state in range(4):
        found = {DELETE: COST[DELETE] + ahead[state]}
        if fault not in (BLANK, DUPLICATE):
            found[REROLE] = COST[REROLE] + more + ahead[NEXT[state][1]]
            if (state, initial) in KEPT:
                found[KEEP] = COST[KEEP] + more + ahead[KEPT[state, initial]]
        edits.append(found)
    costs = [min(found.values()) for found in edits]
    for _ in range(2):  # no cheapest repair puts in more than two turns in a row
        for state in range(4):
            edits[state][INSERT] = COST[INSERT] + costs[NEXT[state][1]]
            costs[state] = min(costs[state], edits[state][INSERT])
    best = [min(e for e, cost in found.items() if cost == costs[state]) for state, found in enumerate(edits)]
    return tuple(costs), sum(e << (2 * state) for state, e in enumerate(best))


def _backwards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turns, each conversation's last first -> the same with their backpointers."""
    known: dict = {}  # costs are kept relative to the cheapest, so few come up
    key, ahead = None, tuple(LAST)
    for frame in frames:
        moves = []
        for own, role, fault in zip(frame["key"], frame["role"], frame["fault"], strict=True):
            if own != key:
                key, ahead = own, tuple(LAST)
            if fault == DROPPED:
                moves.append(0)
                continue
            at = (ahead, role[:1], fault)
            if at not in known:
                costs, byte = step(*at)
                known[at] = (tuple(c - min(costs) for c in costs), byte)
            ahead, byte = known[at]
            moves.append(byte)
        yield frame.assign(moves=moves)


class _Repair:
    """One conversation on its way from its first turn to its last."""

    def __init__(self, key: str) -> None:
        self.key, self.state, self.audit, self.cost = key, START, [], 0
        self.counts, self.illegal, self.last = [0] * 5, 0, None
        self.low = self.high = None
        self.turns = 0
        self.text, self.empty = hashlib.sha256(), True

    def put(self, role: str, text: str) -> None:
        self.text.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def insert(self) -> None:
        role, self.state = NEXT[self.state]
        self.audit.append(LETTERS[INSERT])
        self.cost += COST[INSERT]
        self.put(role, "")

    def turn(self, turn: str | None, role: str, text: str, fault: int, moves: int) -> None:
        self.counts[fault] += 1
        if fault == DROPPED:
            return
        if turn is not None and (number := int(turn)) != self.high:
            self.low, self.high, self.turns = number if self.low is None else self.low, number, self.turns + 1
        self.illegal += self.last is not None and self.last + role[:1] not in LEGAL
        self.last = role[:1]
        while (edit := moves >> (2 * self.state) & 3) == INSERT:
            self.insert()
        self.audit.append(LETTERS[edit])
        self.cost += COST[edit] + (TRUNCATED_COST if fault == TRUNCATED and edit != DELETE else 0)
        if edit == KEEP:
            self.state = KEPT[self.state, role[:1]]
            self.put(role, text)
        elif edit == REROLE:
            role, self.state = NEXT[self.state]
            self.put(role, text)

    def row(self) -> tuple:
        while self.state in (SYSTEM, USER):
            self.insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.key, gaps, *self.counts[:TRUNCATED + 1], self.illegal, self.cost, "".join(self.audit), self.text.hexdigest()


_REPAIRED = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [c.split()[0] for c in _REPAIRED.split(", ")]


def _forwards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turns with their backpointers, each conversation's first first -> a row for each conversation."""
    held: _Repair | None = None
    for frame in frames:
        done = []
        for key, turn, role, text, fault, moves in zip(*[frame[c] for c in ("key", "turn", "role", "text", "fault", "moves")], strict=True):
            if held is None or held.key != key:
                if held:
                    done.append(held.row())
                held = _Repair(key)
            held.turn(turn, role, text, fault, moves)
        yield pd.DataFrame(done, columns=_NAMES)
    if held:
        yield pd.DataFrame([held.row()], columns=_NAMES)


def damaged(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` with a fifth of them dropped, emptied, cut, repeated or given to the user, by a hash of
    their place. A dropped turn stays as a mark of its conversation, without text."""
    key, number = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(key), F.lit(":"), space(number))) % 20
    rows = turns.select(key.alias("conv_id"), number.alias("turn"), space(F.col("role")).alias("role"), space(F.col("text")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text, dropped)`` -> ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256)``: the faults of each conversation and its cheapest repair."""
    turns.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("nth")]
    reverse = [F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("nth")]
    inner = F.rtrim("text", F.lit(SPACES))
    same = W.partitionBy("key", "dropped", "print").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), "turn", "role", "text", "dropped", inner.alias("inner"), F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("print")
    )
    rows = rows.repartition("key").withColumn("nth", F.row_number().over(same))
    fault = F.when(F.col("dropped"), DROPPED).when(F.col("inner") == "", BLANK).when(F.col("nth") > 1, DUPLICATE).when(~F.right("inner", F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    judged = rows.select("key", "turn", "role", "text", fault.alias("fault"), "nth").sortWithinPartitions("key", *reverse)
    judged = judged.withColumn("turn", F.col("turn").cast("string"))
    pointed = judged.mapInPandas(_backwards, _TURN + ", moves int").withColumn("turn", F.col("turn").cast("long"))
    forth = pointed.sortWithinPartitions("key", *order).withColumn("turn", F.col("turn").cast("string"))
    found = forth.mapInPandas(_forwards, _REPAIRED)
    return found.select(F.expr("CAST(nullif(key, '') AS BIGINT)").alias("conv_id"), *_NAMES[1:])


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


_CRC = """CAST(xor(list_reduce(list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS UBIGINT)),
    lambda c, b: list_reduce(CAST([1, 2, 3, 4, 5, 6, 7, 8] AS UBIGINT[]), lambda s, i: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, xor(c, b)), CAST(4294967295 AS UBIGINT)), 4294967295) % 20 AS INT)"""
#: A state of the forward program is one string: cost in nine digits, audit, a separator, the repaired text; the least is best.
_add = lambda state, letter, cost, said: f"(lpad(CAST(CAST(left({state}, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10, instr({state}, chr(1)) - 10) || '{letter}' || substr({state}, instr({state}, chr(1))) || {said})"
_said = lambda role, text: f"chr(2) || {role} || ':' || {text}"
_U, _A, _NONE = "'user'", "'assistant'", "''"
_ORACLE = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), kinds AS (
  SELECT *, {_CRC} AS kind FROM keyed
), damage AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), '') AS key, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY key, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS inn FROM damage
), judged AS (
  SELECT key, i, turn, role, text, left(role, 1) AS r, CASE WHEN inn = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(inn, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'f' END AS fault FROM ranked
), steps AS (
  SELECT key, 0 AS i, '000000000' || chr(1) AS b0, '900000000' || chr(1) AS b1, '900000000' || chr(1) AS b2, '900000000' || chr(1) AS b3 FROM (SELECT DISTINCT key FROM judged)
  UNION ALL
  SELECT s.key, s.i + 1,
    {_add("s.e0", "D", 2, _NONE)},
    least({_add("s.e1", "D", 2, _NONE)}, CASE WHEN ok AND r = 's' THEN {_add("s.e0", "K", "t", _said("role", "text"))} END),
    least({_add("s.e2", "D", 2, _NONE)}, CASE WHEN ok THEN {_add("s.e0", "R", "1 + t", _said(_U, "text"))} END, CASE WHEN ok THEN {_add("s.e1", "R", "1 + t", _said(_U, "text"))} END, CASE WHEN ok THEN {_add("s.e3", "R", "1 + t", _said(_U, "text"))} END,
      CASE WHEN ok AND r = 'u' THEN {_add("s.e0", "K", "t", _said("role", "text"))} END, CASE WHEN ok AND r = 'u' THEN {_add("s.e1", "K", "t", _said("role", "text"))} END, CASE WHEN ok AND r = 'u' THEN {_add("s.e3", "K", "t", _said("role", "text"))} END),
    least({_add("s.e3", "D", 2, _NONE)}, CASE WHEN ok THEN {_add("s.e2", "R", "1 + t", _said(_A, "text"))} END, CASE WHEN ok AND r = 'a' THEN {_add("s.e2", "K", "t", _said("role", "text"))} END)
  FROM (SELECT key, i, b0 AS e0, b1 AS e1, least(c2, {_add("c3", "I", 5, _said(_U, _NONE))}) AS e2, least(c3, {_add("c2", "I", 5, _said(_A, _NONE))}) AS e3
        FROM (SELECT *, least(b2, {_add("b0", "I", 5, _said(_U, _NONE))}, {_add("b1", "I", 5, _said(_U, _NONE))}) AS c2, b3 AS c3 FROM steps)) s
  JOIN (SELECT *, fault IN ('t', 'f') AS ok, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS t FROM judged) j ON j.key = s.key AND j.i = s.i + 1
), ended AS (
  SELECT key, least(b0, b3, {_add("b2", "I", 5, _said(_A, _NONE))}, {_add(_add("b1", "I", 5, _said(_U, _NONE)), "I", 5, _said(_A, _NONE))}) AS best FROM (SELECT * FROM steps QUALIFY i = max(i) OVER (PARTITION BY key))
), counts AS (
  SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated, count_if(before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(r) OVER (PARTITION BY key ORDER BY i) AS before FROM judged) GROUP BY key
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(best, 9) AS BIGINT), 0) AS cost,
  coalesce(substr(best, 10, instr(best, chr(1)) - 10), '') AS audit, sha256(coalesce(replace(substr(best, instr(best, chr(1)) + 2), chr(2), chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ended e ON e.key = coalesce(CAST(c.conv_id AS VARCHAR), '') LEFT JOIN counts n ON n.key = e.key
"""

QUERIES = {"op12_turn_repair": op12_turn_repair}
ORACLES = {"op12_turn_repair": _ORACLE}
