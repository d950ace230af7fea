"""Operator 2: quality by a document classifier and hierarchical empirical Bayes over hosts and paths.

A logistic model, trained on a bounded sample of labelled documents, gives each document's evidence. What is known of a
document's quality, its label if it has one and else the classifier's probability, which counts by its certainty, is summed by path
and host (grouped aggregation over all documents). Each level's share of good documents is shrunk toward the level above, a path toward its
host, a host toward the whole, with a strength estimated from how much the groups differ beyond what their size and the
scatter within them explain: a sparse site stays near the whole, a site of many documents speaks for itself. A document's
posterior odds are its own odds times those of its path (without the document itself) against the whole.

Defined results: a null text is empty; null hosts and paths are groups of their own; repeated rows each count and each
give a row; a repeated label counts once, good if any is; without labels of both kinds there is no evidence and every
document is kept; an empty table gives an empty result; further columns are ignored by ``score_documents`` and returned
by ``keep_good``, whatever their names. Hosts and paths are those of a column ``url`` where the documents have one
(host, and first part of the path), else ``source`` and ``lang``, else one group.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_rows, is_small, materialize, table
from .quality_rules import bound, signals, words_of

#: Labelled documents that the classifier is fitted to, at most (in the order of a hash of their ids).
MAX_LABELLED = 20_000
#: Labels that a broadcast may hold, under 32 MB; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: Groups that a broadcast may hold, under 32 MB. Beyond it only those are with more than one of so many rows, which can't be
#: more than this; the rest are joined by a shuffle, none of them large.
BROADCAST_GROUPS = 200_000
#: A level's prior counts as so many documents at least and at most.
LEAST_STRENGTH, MOST_STRENGTH, THRESHOLD = 1.0, 1e4, 0.5
FEATURES = ["size", "symbols", "calls", "upper", "letters", "variety", "same_lines", "word_length", "short_words"]


def site_of(docs: DataFrame) -> tuple[Column, Column]:
    """Host and path of each row."""
    if "url" in docs.columns:
        return F.lower(F.regexp_extract("url", r"^(?:[^:/?#]+:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.regexp_extract("url", r"^(?:[^:/?#]+:)?//[^/?#]*(/[^/?#]*)", 1)
    return tuple(F.col(c) if c in docs.columns else F.lit(None).cast("string") for c in ("source", "lang"))


def evidence_features(text: Column) -> list[Column]:
    """Steps to numbers about one text; two selects, so that the words are taken apart once."""
    own = {k: c for k, c in signals(text).items() if k != "__words"}
    words = bound(words_of(text), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), F.size(F.filter(w, lambda x: F.length(x) < 4)).alias("short")))
    return [words.alias("__w"), *[c.alias(k) for k, c in own.items()]]


def featured(docs: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, host, path, features...)``, a small row of numbers for each document."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).cast("string").alias("__text"))
    text = F.coalesce("__text", F.lit(""))
    raw = source.select("doc_id", "host", "path", F.xxhash64("__text").alias("text_hash"), *evidence_features(text))
    n, chars, letters = F.greatest(F.col("__w.n"), F.lit(1)), F.greatest("word_chars", F.lit(1)), F.greatest("n_letters", F.lit(1))
    return raw.select(
        "doc_id", "text_hash", "host", "path",
        F.log1p("__w.n").alias("size"), F.sqrt(F.col("n_symbols") / chars).alias("symbols"), F.sqrt(F.col("n_calls") / chars).alias("calls"), F.sqrt(F.col("n_upper") / letters).alias("upper"),
        (F.col("n_letters") / chars).alias("letters"), F.least(F.col("__w.distinct") / F.sqrt(n), F.lit(5.0)).alias("variety"), (F.col("__lines.n_dup_lines") / F.greatest("__lines.n_lines", F.lit(1))).alias("same_lines"),
        F.least(F.col("word_chars") / n, F.lit(20.0)).alias("word_length"), (F.col("__w.short") / n).alias("short_words"),
    )


def clean_labels(labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """``(doc_id, label)``: 1.0 good, 0.0 bad."""
    return labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label_col).cast("double").alias("label"))


def fit_evidence(rows: DataFrame, labels: DataFrame) -> Column | None:
    """Log-odds of good as a column, from ``clean_labels``; None unless both kinds occur."""
    sample = rows.join(labels, "doc_id").orderBy(F.xxhash64("doc_id"), "text_hash").limit(MAX_LABELLED).select("label", *FEATURES)
    sample = materialize(sample, "labelled")
    if sample.select("label").distinct().count() < 2:
        return None
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample)
    model = LogisticRegression(maxIter=60, regParam=1e-3, elasticNetParam=0.0).fit(data)
    odds = F.lit(float(model.intercept))
    for name, weight in zip(FEATURES, model.coefficients.toArray(), strict=True):
        odds = odds + F.lit(float(weight)) * F.col(name)
    return F.greatest(F.least(odds, F.lit(20.0)), F.lit(-20.0))


def known_quality(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """``scored`` with ``known``: the document's label if it has one, else its evidence ``p``, and the ``weight`` of that:
    1 for a label and for certain evidence, 0 for evidence of a half."""
    own = F.broadcast(labels) if is_small(labels, BROADCAST_LABELS) else labels
    known = scored.join(own, "doc_id", "left").withColumn("known", F.coalesce("label", "p"))
    return known.withColumn("weight", F.when(F.col("label").isNull(), (2 * F.col("p") - 1) ** 2).otherwise(1.0)).drop("label")


def _strength(groups: DataFrame, mean: Column) -> float:
    """Pseudo-counts of a level's prior by the method of moments.

    ``groups(n, good, squares)``: the spread of their shares around ``mean`` less what the scatter within them explains is
    the variance of the level; few pseudo-counts where groups differ, many where only by chance.
    """
    rate, n = F.col("good") / F.col("n"), F.col("n")
    chance = F.greatest(F.col("squares") - n * rate**2, F.lit(0.0)) / (n * (n - 1))
    row = groups.filter("n > 1").agg(F.sum(n * ((rate - mean) ** 2 - chance)).alias("extra"), F.sum(n * mean * (1 - mean)).alias("spread")).first()
    if not row["extra"] or row["extra"] <= 0 or not row["spread"]:
        return MOST_STRENGTH
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, row["spread"] / row["extra"] - 1))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _with_groups(scored: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Each row with the numbers of its group; a group's rows never gather in one task."""
    same = F.col("host").eqNullSafe(F.col("__host")) & F.col("path").eqNullSafe(F.col("__path"))
    if is_small(groups, BROADCAST_GROUPS):
        return scored.join(F.broadcast(groups), same)
    large = F.col("__rows") * BROADCAST_GROUPS > total
    by_size = scored.join(F.broadcast(groups.filter(large)), same, "left")
    rest = by_size.filter("__rows IS NULL").select(*scored.columns).join(groups.filter(~large), same)
    return by_size.filter("__rows IS NOT NULL").unionByName(rest)


def score_documents(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` -> ``(doc_id, text_hash, evidence, host_quality, path_quality, posterior, kept)``, a row for each."""
    own_host, own_path = site_of(docs)
    rows = materialize(featured(docs, own_host if host is None else host, own_path if path is None else path, id_col, text_col), "features")
    labels = materialize(clean_labels(labels), "labels")
    odds = fit_evidence(rows, labels)
    if odds is None:
        return rows.select("doc_id", "text_hash", *[F.lit(0.5).alias(c) for c in ("evidence", "host_quality", "path_quality", "posterior")], F.lit(True).alias("kept"))
    scored = rows.select("doc_id", "text_hash", "host", "path", odds.alias("odds")).withColumn("p", 1 / (1 + F.exp(-F.col("odds"))))
    scored = known_quality(scored, labels)
    known, weight = F.col("known"), F.col("weight")
    paths = materialize(scored.groupBy("host", "path").agg(F.count("*").alias("rows"), F.sum(weight).alias("n"), F.sum(weight * known).alias("good"), F.sum(weight * known**2).alias("squares")), "paths")
    sums = [F.sum(c).alias(c) for c in ("rows", "n", "good", "squares")]
    hosts = paths.groupBy("host").agg(*sums)
    total = hosts.agg(*sums).first()
    mean = min(1 - 1e-6, max(1e-6, (total["good"] or 0.0) / (total["n"] or 1.0)))
    host_strength = _strength(hosts, F.lit(mean))
    hosts = hosts.select(F.col("host").alias("__host"), ((F.col("good") + host_strength * mean) / (F.col("n") + host_strength)).alias("host_quality"))
    both = materialize(paths.join(hosts, F.col("host").eqNullSafe(F.col("__host"))).drop("__host"), "groups")
    path_strength = _strength(both, F.col("host_quality"))
    groups = both.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("rows").alias("__rows"), F.col("n").alias("__n"), F.col("good").alias("__good"), "host_quality")
    joined = _with_groups(scored, groups, total["rows"] or 0)
    others = (F.col("__good") - weight * known + path_strength * F.col("host_quality")) / (F.col("__n") - weight + path_strength)
    joined = joined.withColumn("path_quality", F.greatest(F.least(others, F.lit(0.999)), F.lit(0.001)))
    posterior = 1 / (1 + F.exp(-(F.col("odds") + logit(F.col("path_quality")) - F.lit(math.log(mean / (1 - mean))))))
    return joined.select("doc_id", "text_hash", F.col("p").alias("evidence"), "host_quality", "path_quality", posterior.alias("posterior")).withColumn("kept", F.col("posterior") >= THRESHOLD)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``score_documents`` keeps, with all their columns."""
    return drop_rows(docs, score_documents(docs, labels).filter("NOT kept"))


def op2_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, hosts by source and paths by language (they have no url), labelled by ``labels``."""
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    columns = ("evidence", "host_quality", "path_quality", "posterior")
    return scored.select("doc_id", *[F.round(c, 6).alias(c) for c in columns], "kept")


QUERIES = {"op2_site_quality": op2_site_quality}
ORACLES: dict[str, str] = {}
