"""Operator 5: preference examples from pairs of conversations. Native: DataFrame functions only.

The longest common turn prefix of the chosen and the rejected conversation (turns of equal role and text) is rendered
once as the prompt; what follows in each is rendered as its completion. The mask of a completion lists the character
spans of the whole text (prompt and completion) that are trained on: the assistant's turns after the prompt, with their
end mark.

Defined results: turns are ordered by number, then role and text; a null role or text is empty; turns without a
conversation id are left out; a pair whose sides are equal, or of which one has nothing after the prompt, teaches
nothing and gives no row; repeated turns count as turns; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

#: Conversations with the same opening are ordered within so many ids, then the ends of so many such blocks, and so on: no
#: common opening gathers in one task.
SIBLING_IDS = 1_000
ASKS, ANSWERS = "user", "assistant"
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def conversation_arrays(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> ``(conv_id, turns)``, the turns in order as ``struct<role, text>``."""
    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).filter("conv_id IS NOT NULL")
    rows = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE), turn["text"], F.lit(END))


def _trained(turns: Column, start: Column) -> Column:
    """Spans ``from:to`` of the assistant's turns when ``turns`` are rendered from character ``start`` on."""
    head = lambda t: F.length(t["role"]) + len(OPEN) + len(CLOSE)

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + head(t)
        end = state["at"] + F.length(rendered(t))
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == ANSWERS, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    first = F.struct(start.cast("int").alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, first, step, lambda s: F.array_join(s["spans"], ","))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``pairs(pair_id, chosen, rejected)`` with arrays of turns -> prompt, completions and masks of each pair."""
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(same, False)
    cut = pairs.withColumn("n_prompt_turns", F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int"))
    rest = lambda name: F.slice(name, F.col("n_prompt_turns") + 1, F.greatest(F.size(name) - F.col("n_prompt_turns"), F.lit(0)))
    text = lambda turns: F.array_join(F.transform(turns, rendered), "")
    cut = cut.filter((F.size("chosen") > F.col("n_prompt_turns")) & (F.size("rejected") > F.col("n_prompt_turns")))
    cut = cut.select("pair_id", "n_prompt_turns", text(F.slice("chosen", 1, F.col("n_prompt_turns"))).alias("prompt"), rest("chosen").alias("chosen"), rest("rejected").alias("rejected"))
    return cut.select(
        "pair_id", "n_prompt_turns", "prompt", text("chosen").alias("chosen_completion"), text("rejected").alias("rejected_completion"),
        _trained(F.col("chosen"), F.length("prompt")).alias("chosen_mask"), _trained(F.col("rejected"), F.length("prompt")).alias("rejected_mask"),
    )


def stale_answer_pairs(conversations: DataFrame) -> DataFrame:
    """Each conversation up to its last answer, against itself with that answer replaced by the answer before (or by nothing)."""
    roles = F.reverse(F.transform("turns", lambda t: t["role"]))
    ended = conversations.withColumn("last", F.size("turns") - F.array_position(roles, ANSWERS) + 1).filter(F.array_contains(roles, ANSWERS))
    ended = ended.select("conv_id", F.slice("turns", 1, F.col("last").cast("int")).alias("chosen"))
    before = F.filter(F.slice("chosen", 1, F.size("chosen") - 1), lambda t: t["role"] == ANSWERS)
    stale = F.coalesce(F.try_element_at(before, F.lit(-1))["text"], F.lit(""))
    answer = F.struct(F.lit(ANSWERS).alias("role"), stale.alias("text"))
    return ended.select(F.concat(F.lit("stale:"), F.col("conv_id").cast("string")).alias("pair_id"), "chosen", F.concat(F.slice("chosen", 1, F.size("chosen") - 1), F.array(answer)).alias("rejected"))


def _following(opening: DataFrame) -> DataFrame:
    """``opening(conv_id, opening)`` -> ``(conv_id, other)``: the next id of the same opening, wherever it lies.

    Each round links the neighbours inside blocks and leaves the first and last id of a block to the next, whose blocks
    hold ``SIBLING_IDS`` of these; a window sees at most so many rows (twice that in the last round), however often an opening
    occurs.
    """
    ends = opening.agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    rows = opening.select("opening", F.col("conv_id").alias("place"), F.col("conv_id").alias("first"), F.col("conv_id").alias("last"))
    found = None
    while True:
        low, high = low // SIBLING_IDS, high // SIBLING_IDS
        rows = rows.withColumn("place", F.expr(f"place div {SIBLING_IDS}L - CASE WHEN place % {SIBLING_IDS}L < 0 THEN 1 ELSE 0 END"))
        done = low >= -1 and high <= 0
        keys = ["opening"] if done else ["opening", "place"]
        linked = rows.withColumn("other", F.lead("first").over(W.partitionBy(*keys).orderBy("first")))
        if not done:
            linked = materialize(linked, "linked")
        pairs = linked.filter("other IS NOT NULL").select(F.col("last").alias("conv_id"), "other")
        found = pairs if found is None else found.unionByName(pairs)
        if done:
            return found
        rows = linked.groupBy(*keys).agg(F.min("first").alias("first"), F.max("last").alias("last"))


def sibling_pairs(conversations: DataFrame) -> DataFrame:
    """Each conversation against the next one, by id, that has the same turns up to its first question."""
    asked = F.array_position(F.transform("turns", lambda t: t["role"]), ASKS).cast("int")
    opening = conversations.filter(asked > 0).select("conv_id", F.xxhash64(F.slice("turns", F.lit(1), asked)).alias("opening"))
    pairs = _following(opening)
    chosen = pairs.join(conversations.select("conv_id", F.col("turns").alias("chosen"), asked.alias("asked")), "conv_id")
    both = chosen.join(conversations.select(F.col("conv_id").alias("other"), F.col("turns").alias("rejected")), "other")
    both = both.filter(F.slice("chosen", F.lit(1), F.col("asked")) == F.slice("rejected", F.lit(1), F.col("asked")))
    return both.select(F.concat_ws(":", F.lit("sibling"), F.col("conv_id").cast("string"), F.col("other").cast("string")).alias("pair_id"), "chosen", "rejected")


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference examples of all conversations: against a stale answer, and against the next that was asked the same."""
    conversations = materialize(conversation_arrays(table(spark, sf_dir, "conversations")), "conversations")
    return format_preferences(stale_answer_pairs(conversations).unionByName(sibling_pairs(conversations)))


_ORACLE = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), ends AS (
  SELECT conv_id, max(pos) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id
), stale AS (
  SELECT e.conv_id, e.last, coalesce((SELECT arg_max(t.text, t.pos) FROM t WHERE t.conv_id = e.conv_id AND t.role = 'assistant' AND t.pos < e.last), '') AS text
  FROM ends e
), asked AS (
  SELECT conv_id, min(pos) AS first FROM t WHERE role = 'user' GROUP BY conv_id
), opening AS (
  SELECT conv_id, string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY pos) AS said FROM t JOIN asked USING (conv_id) WHERE pos <= first GROUP BY conv_id
), follow AS (
  SELECT conv_id, lead(conv_id) OVER (PARTITION BY said ORDER BY conv_id) AS other FROM opening
), sides AS (
  SELECT 'stale:' || t.conv_id AS pair_id, 'c' AS side, pos, role, t.text AS text FROM t JOIN stale s ON t.conv_id = s.conv_id AND t.pos <= s.last
  UNION ALL
  SELECT 'stale:' || t.conv_id, 'r', pos, role, CASE WHEN pos = s.last THEN s.text ELSE t.text END FROM t JOIN stale s ON t.conv_id = s.conv_id AND t.pos <= s.last
  UNION ALL
  SELECT 'sibling:' || f.conv_id || ':' || f.other, 'c', pos, role, text FROM follow f JOIN t ON t.conv_id = f.conv_id WHERE f.other IS NOT NULL
  UNION ALL
  SELECT 'sibling:' || f.conv_id || ':' || f.other, 'r', pos, role, text FROM follow f JOIN t ON t.conv_id = f.other WHERE f.other IS NOT NULL
), cut AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, min(coalesce(c.pos, r.pos)) - 1 AS n
  FROM (SELECT * FROM sides WHERE side = 'c') c FULL JOIN (SELECT * FROM sides WHERE side = 'r') r ON c.pair_id = r.pair_id AND c.pos = r.pos
  WHERE c.pos IS NULL OR r.pos IS NULL OR c.role <> r.role OR c.text <> r.text GROUP BY ALL
), shown AS (
  SELECT s.*, n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM sides s JOIN cut USING (pair_id)
), placed AS (
  SELECT *, sum(length(shown)) OVER (PARTITION BY pair_id, side ORDER BY pos) AS upto FROM shown
)
SELECT pair_id, CAST(any_value(n) AS INTEGER) AS n_prompt_turns,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (side = 'c' AND pos <= n), '') AS prompt,
       string_agg(shown, '' ORDER BY pos) FILTER (side = 'c' AND pos > n) AS chosen_completion,
       string_agg(shown, '' ORDER BY pos) FILTER (side = 'r' AND pos > n) AS rejected_completion,
       coalesce(string_agg(CAST(upto - length(shown) + length(role) + 5 AS BIGINT) || ':' || CAST(upto AS BIGINT), ',' ORDER BY pos) FILTER (side = 'c' AND pos > n AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(CAST(upto - length(shown) + length(role) + 5 AS BIGINT) || ':' || CAST(upto AS BIGINT), ',' ORDER BY pos) FILTER (side = 'r' AND pos > n AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY pair_id HAVING count(*) FILTER (side = 'c' AND pos > n) > 0 AND count(*) FILTER (side = 'r' AND pos > n) > 0
"""

QUERIES = {"op5_preferences": op5_preferences}
ORACLES = {"op5_preferences": _ORACLE}
