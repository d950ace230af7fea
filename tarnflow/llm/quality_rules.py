"""Operator 8: quality rules whose votes a label model weighs (weak supervision). Native: DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0, between its two thresholds). The label model is a mixture of good and
bad documents in which rules vote independently; expectation-maximisation estimates from all documents' votes how often
good and bad ones get each vote of each rule, that is the rules' accuracies, starting from weak priors. A document's
posterior of being good then replaces the demand that all rules pass: a lone bad vote of a rule that others don't confirm
is outvoted, and doubtful votes of several good rules reject a text that no rule calls bad. The counts are those of vote
patterns, at most 3 ** 9, so the fit reads a table of proven size. Documents of fewer than ``MIN_WORDS`` words don't take
part in it. Two base rules stay absolute: fewer than 50 words, or more than half of the words in repeated three-word windows.

Defined results: a null text has no words; it, an empty and a white-space text fail the base rules; repeated rows give
repeated results; an empty table gives an empty result; a null doc_id is carried; further columns are ignored by
``score_documents`` and returned by ``keep_good``, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, drop_rows, materialize, table

MIN_WORDS, MAX_REPEAT_PERCENT, THRESHOLD = 50, 50, 0.5
RULES = ["long_enough", "few_symbols", "new_lines", "few_repeats", "lower_case", "varied_words", "calm", "word_length", "letters"]
#: Priors of the label model: for bad and for good documents the shares of bad votes, abstentions and good votes that each
#: rule is taken to have, and the shares of bad and good documents; all count as ``PRIOR_COUNT`` documents.
PRIOR_VOTES, PRIOR_CLASSES, PRIOR_COUNT = ((0.2, 0.1, 0.7), (0.01, 0.05, 0.94)), (0.1, 0.9), 50.0
#: Rounds of expectation-maximisation at most, and the change of any posterior that ends them.
ROUNDS, TOLERANCE = 500, 1e-10


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more.

    Windows are hashed to the upper bits of a number whose lower bits are their place; sorted, equal windows are
    neighbours. Each match is confirmed on the words. Where two different windows share those bits, which could part two
    equal ones, the text's windows are sorted by whole hash and words instead. The windows' places give the words they cover.
    """

    def of(w: Column) -> Column:
        low = F.when(F.size(w) < 1 << 20, F.lit((1 << 20) - 1)).otherwise(F.lit((1 << 31) - 1)).cast("long")
        places = F.sequence(F.lit(0), F.size(w) - 3)
        hashed = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

        def same(a: Column, b: Column) -> Column:
            return F.coalesce((F.get(w, a) == F.get(w, b)) & (F.get(w, a + 1) == F.get(w, b + 1)) & (F.get(w, a + 2) == F.get(w, b + 2)), F.lit(False))

        def repeated(rows: Column, alike, place) -> Column:
            """The places of ``rows``, which are sorted, that are ``alike`` to a neighbour."""
            return F.transform(F.filter(rows, lambda x, k: alike(x, F.get(rows, k + 1)) | F.when(k > 0, alike(x, F.get(rows, k - 1))).otherwise(F.lit(False))), place)

        def found(bits: Column) -> Column:
            code = lambda i: hashed(i).bitwiseAND(F.bitwise_not(bits)).bitwiseOR(i.cast("long"))
            place = lambda x: x.bitwiseAND(bits).cast("int")
            near = lambda x, y: F.coalesce(x.bitwiseXOR(y) <= bits, F.lit(False)) & (x.bitwiseXOR(y) >= 0)
            pair = lambda x, y: F.when(near(x, y), same(place(x), place(y))).otherwise(F.lit(False))
            clash = lambda codes: F.exists(F.zip_with(codes, F.slice(codes, 2, F.size(codes)), lambda x, y: near(x, y) & ~pair(x, y)), lambda c: c)
            exact = lambda rows: repeated(rows, lambda x, y: F.coalesce((x["h"] == y["h"]) & same(x["i"], y["i"]), F.lit(False)), lambda x: x["i"])
            sorted_rows = F.sort_array(F.transform(places, lambda i: F.struct(hashed(i).alias("h"), F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))))
            return bound(F.sort_array(F.transform(places, code)), lambda codes: F.when(clash(codes), bound(sorted_rows, exact)).otherwise(repeated(codes, pair, place)))

        def covered(places: Column) -> Column:
            step = lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3)))
            return F.aggregate(F.transform(places, step), F.lit(0), lambda a, x: a + x)

        return F.when(F.size(w) < 4, F.lit(0)).otherwise(bound(bound(low, found), lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(bound(F.sort_array(p), covered))))

    return bound(words, of).cast("long")


def signals(text: Column) -> dict[str, Column]:
    """Columns of one text; the words are taken apart once."""
    size = F.length(text).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counted(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
        )

    return {
        "__words": bound(words_of(text), counted),
        "__lines": bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": size - F.length(F.translate(text, "#*$%&|<>", "")),
        "n_calls": size - F.length(F.translate(text, "!?", "")),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
        "n_letters": F.regexp_count(text, F.lit(r"\p{L}")).cast("long"),
    }


def votes() -> list[Column]:
    """One vote for each of ``RULES``, from the columns of ``signals``."""
    words, chars, letters = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_letters"), F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(words == 0, F.lit(0)).when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))

    variety, length = F.col("n_distinct_words") / F.sqrt(words), F.col("word_chars") / words
    return [
        vote(words < 60, words >= 100),
        vote(F.col("n_symbols") > 0.03 * chars, F.col("n_symbols") < 0.01 * chars),
        vote(F.col("n_dup_lines") > 0.3 * F.col("n_lines"), F.col("n_dup_lines") < 0.1 * F.col("n_lines")),
        vote(F.col("n_repeat_words") > 0.3 * words, F.col("n_repeat_words") < 0.15 * words),
        vote(F.col("n_upper") > 0.3 * letters, F.col("n_upper") < 0.1 * letters),
        vote(variety < 3.5, variety >= 5),
        vote(F.col("n_calls") > 0.03 * chars, F.col("n_calls") < 0.01 * chars),
        vote((length < 4) | (length > 7), length.between(4.3, 6.5)),
        vote(F.col("n_letters") < 0.7 * chars, F.col("n_letters") >= 0.9 * chars),
    ]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Signals and votes of each row: a small row of numbers, with ``text_hash`` to tell rows of one id apart."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    found = source.select("doc_id", F.xxhash64("__text").alias("text_hash"), *[c.alias(k) for k, c in signals(text).items()])
    flat = found.select("doc_id", "text_hash", "__words.*", "__lines.*", "word_chars", "n_symbols", "n_calls", "n_upper", "n_letters")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return flat.select("*", F.array(*votes()).alias("votes"), failed.alias("base_failed"))


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[list[float]]]:
    """Vote patterns with counts -> the log-odds of good before any vote, and each rule's log-odds for a vote of -1, 0 and 1.

    Expectation-maximisation: the posteriors of the patterns weigh their counts, which give the shares of each vote among
    bad and good documents, which give the posteriors. It starts from the number of bad votes.
    """
    prior = np.array(PRIOR_VOTES)
    kinds = np.array([v for v, _ in patterns], int).reshape(len(patterns), len(RULES)) + 1
    counts = np.array([n for _, n in patterns], float)
    is_vote = kinds[:, :, None] == np.arange(3)
    good = 1 / (1 + np.exp(3.0 * (kinds == 0).sum(axis=1) - 2.0))
    for _ in range(ROUNDS):
        weight = np.stack([counts * (1 - good), counts * good])
        share = np.einsum("cp,prv->crv", weight, is_vote) + PRIOR_COUNT * prior[:, None, :]
        share /= share.sum(axis=2, keepdims=True)
        classes = weight.sum(axis=1) + PRIOR_COUNT * np.array(PRIOR_CLASSES)
        start, odds = np.log(classes[1] / classes[0]), np.log(share[1] / share[0])
        new = 1 / (1 + np.exp(-np.clip(start + (is_vote * odds).sum(axis=(1, 2)), -700, 700)))
        change, good = np.abs(new - good).max(initial=0.0), new
        if change < TOLERANCE:
            break
    return float(start), odds.tolist()


def score(measured: DataFrame) -> DataFrame:
    """Fits the label model to all of ``measured`` (materialised) and adds ``posterior`` and ``kept``."""
    counts = measured.filter(F.col("n_words") >= MIN_WORDS).groupBy("votes").count().collect()  # at most 3 ** 9 rows
    start, weights = fit(sorted((tuple(r["votes"]), r["count"]) for r in counts))
    odds = F.lit(start)
    for i, w in enumerate(weights):
        odds = odds + F.array(*map(F.lit, w))[F.col("votes")[i] + 1]
    scored = measured.withColumn("posterior", F.lit(1.0) / (1 + F.exp(-odds)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= THRESHOLD))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` -> signals, ``votes``, ``base_failed``, ``posterior`` and ``kept``, a row for each."""
    return score(materialize(measure(docs, id_col, text_col), "quality"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``score_documents`` keeps, with all their columns."""
    return drop_rows(docs, score_documents(docs).filter("NOT kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: base counts, base verdict and the label model's verdict."""
    scored = score_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLES: dict[str, str] = {}
