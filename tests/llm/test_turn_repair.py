import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tarnflow.llm import turn_repair
from tests.oracle import assert_same

SCHEMA = "conv_id long, turn long, role string, text string"
INK = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        out[c] += []
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out[c] += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: [(t if known else None, role, text) for known, t, role, text in sorted(r)] for c, r in out.items()}


def judge(turns):
    seen, faults = set(), []
    for _, role, text in turns:
        ink = INK.findall(text)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "fine")
        seen.add((role, text))
    return faults


def cheapest(turns, faults):
    """All repairs by a plain search over (place, output) with the least (cost, audit)."""
    # Forward over states; a state is what the pattern still allows, a value the least (cost, audit, repaired).
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    full = {"u": "user", "a": "assistant"}
    held = {"": (0, "", ())}

    def better(to, state, value):
        if state not in to or value[:2] < to[state][:2]:
            to[state] = value

    def with_new(states):
        states = dict(states)
        for _ in range(4):
            for state, (cost, audit, said) in list(states.items()):
                for r in "ua":
                    if (state, r) in after:
                        better(states, after[state, r], (cost + 5, audit + "I", (*said, full[r] + ":")))
        return states

    for (_, role, text), fault in zip(turns, faults, strict=True):
        new = {}
        for state, (cost, audit, said) in with_new(held).items():
            better(new, state, (cost + 2, audit + "D", said))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            if (state, role[:1]) in after:
                better(new, after[state, role[:1]], (cost + more, audit + "K", (*said, f"{role}:{text}")))
            for r in "ua":
                if (state, r) in after:
                    better(new, after[state, r], (cost + 1 + more, audit + "R", (*said, f"{full[r]}:{text}")))
        held = new
    ended = [v for s, v in with_new(held).items() if s in ("", "a")]
    return min(ended, key=lambda v: v[:2])


def by_all_scripts(turns, faults):
    """The same from every edit script with at most two new turns at each place."""
    best = None
    for new in itertools.product(range(3), repeat=len(turns) + 1):
        for edits in itertools.product("DKR", repeat=len(turns)):
            cost, audit, said, want = 0, "", [], None
            state, ok = "", True

            def put(r, state):
                return {"": "u", "s": "u", "u": "a", "a": "u"}[state] == r or (state == "" and r == "s")

            for i in range(len(turns) + 1):
                for _ in range(new[i]):
                    state = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
                    cost, audit = cost + 5, audit + "I"
                    said.append({"u": "user:", "a": "assistant:"}[state])
                if i == len(turns):
                    break
                edit, (_, role, text) = edits[i], turns[i]
                audit += edit
                if edit == "D":
                    cost += 2
                    continue
                if faults[i] in ("blank", "duplicate"):
                    ok = False
                    break
                r = role[:1] if edit == "K" else {"": "u", "s": "u", "u": "a", "a": "u"}[state]
                if not r or not put(r, state):
                    ok = False
                    break
                cost += (edit == "R") + 5 * (faults[i] == "truncated")
                said.append(f"{role}:{text}" if edit == "K" else {"u": "user:", "a": "assistant:"}[r] + text)
                state = r
            if ok and state in ("", "a") and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, tuple(said))
    return best


def brute(rows):
    out = []
    for c, turns in damage(rows).items():
        faults = judge(turns)
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, said = cheapest(turns, faults)
        out.append((c if c is not None else -1, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((-1 if r.conv_id is None else r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect())


def run(spark, rows, parts=5):
    return turn_repair.repair_conversations(turn_repair.damaged(spark.createDataFrame(rows, SCHEMA).repartition(parts)))


@pytest.fixture(scope="module")
def hard_rows():
    rng = random.Random(5)
    texts = ["Yes.", "No", "why?", "so! ", "", None, "\t\x0b", "Yes.", "cut off", "a.\n\n", "…", "x" * 30]
    rows = []
    for c in range(600):
        n = rng.choice([1, 1, 2, 3, 4, 6, 12])
        rows += [(c, rng.choice([i, i, i, 3 * i, None, -2]), rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "User"]), rng.choice(texts)) for i in range(n)]
    rows += [(None, i, "user", f"lost {i}.") for i in range(7)]
    rows += [(7000, i, "system" if i == 0 else "user" if i % 2 else "assistant", f"turn {i % 900}{'.' if i % 7 else ''}") for i in range(25_000)]
    rows += [(7001, 0, "user", "long " * 200_000 + "."), (7001, 1, "assistant", "ok.")]
    rows += [(7002, 5, "user", "same.")] * 4
    return rows


def test_against_brute_force(spark, hard_rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")  # conversations reach over many batches
    try:
        assert found(run(spark, hard_rows)) == brute(hard_rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cheapest_against_all_edit_scripts():
    rng = random.Random(2)
    for _ in range(60):
        turns = [(i, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b", "", "c!"])) for i in range(rng.randint(0, 3))]
        faults = judge(turns)
        assert cheapest(turns, faults) == by_all_scripts(turns, faults)


def test_oracle(spark, sf_dir):
    assert assert_same(turn_repair.op12_turn_repair(spark, sf_dir), turn_repair.ORACLES["op12_turn_repair"], sf_dir)


def test_registered_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(turn_repair.op12_turn_repair(spark, sf_dir)) == brute(rows)


def test_one_shuffle(spark, sf_dir):
    plan = turn_repair.op12_turn_repair(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []).collect() == []
    rows = [(1, 0, "user", "hi."), (1, 1, "assistant", "ho."), (2, None, None, None)]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "fault": F.lit("x"), "moves": F.lit(2)})
    assert found(turn_repair.repair_conversations(turn_repair.damaged(table))) == brute(rows)
