"""Operator 1: secrets by a random forest over candidate strings. Native: DataFrame functions and ``pyspark.ml`` only.

Candidates are all strings of 12 or more characters of ``A-Z a-z 0-9 _ + / -`` with a digit and at most two ``=`` as end
padding, anywhere in a whole text; a ``NAME=`` before one is its context, not part of it.
The forest sees a candidate's length, its kinds of characters and the transitions between them (also as likelihood under
letter pairs of the words around candidates), the share of it that words of the corpus cover, its path, and the words next
to it. It is trained on labelled findings, given or those of ``labelled_findings``, and alone decides which candidates are
secrets: card and phone numbers, commits, checksums, ids, paths and names are false positives that it removes.

Defined results: null and empty texts have no candidates; a candidate that occurs twice is two findings; without labelled
findings of both kinds nothing is known (probability null, no secret); a null path is an empty one; repeated rows repeat
their findings; an empty table gives an empty result; further columns are ignored by ``find_secrets`` and returned by
``redact``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_scratch, fresh, is_small, materialize, table
from .labelled_findings import labelled_findings

_BODY, _PAD = r"[A-Za-z0-9_+/\-]", r"(?![A-Za-z0-9_+/=\-])"
CANDIDATE = rf"(?<!{_BODY})(?=[A-Za-z_+/\-]*+[0-9])(?={_BODY}{{12}}|{_BODY}{{11}}={_PAD}|{_BODY}{{10}}=={_PAD}){_BODY}++(?:={{1,2}}{_PAD})?"
#: Published forms of keys, which are secrets under any name and without one.
KNOWN = r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35}|npm_[A-Za-z0-9]{36})$"
NAMES = r"(?i)(token|secret|passw|passphrase|api[_-]?key|auth|credential|private|bearer|pwd|access[_-]?key)"
#: Words that name what is public though it looks random.
PUBLIC = r"(?i)\b(commit|sha|sha1|sha256|md5|digest|checksum|hash|etag|uuid|guid|id|isbn|issn|doi|order|invoice|card|account|phone|call|fax|version|release|build|revision|index|page|part|request|link|path)\b"
#: Labelled findings that the forest is fitted to, at most (in the order of a hash); words of context on each side.
MAX_LABELLED, LEFT, RIGHT = 20_000, 6, 3
#: Documents with secrets, and distinct runs of letters, that a broadcast may hold: under 64 MB.
BROADCAST_DOCS, BROADCAST_RUNS = 200_000, 500_000
#: A word of the corpus counts as dictionary from so many occurrences on.
DICTIONARY_COUNT = 5
MASK, THRESHOLD = "[SECRET]", 0.5
FEATURES = ["length", "digits", "upper", "hex", "distinct", "changes", "pairs", "coverage", "depth", "test_path", "name_near", "public_near", "assigned", "quoted", "word_before", "known_form"]


def _pieces(text: Column) -> Column:
    return F.split(text, CANDIDATE, -1)


def candidates(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, path, finding_no, value, before, after)``, a row for each candidate."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).cast("string").alias("__text"))
    held = source.filter(F.col("__text").rlike(CANDIDATE))
    parts = held.select("doc_id", F.xxhash64("__text").alias("text_hash"), "path", F.transform(F.regexp_extract_all("__text", F.lit(CANDIDATE), F.lit(0)), lambda v: v).alias("values"), _pieces(F.col("__text")).alias("pieces"))
    last = lambda words: F.array_join(F.slice(words, F.greatest(F.size(words) - LEFT + 1, F.lit(1)), F.lit(LEFT)), " ")
    around = F.transform(F.transform("pieces", lambda p: F.split(p, r"\s+")), lambda words: F.struct(last(words).alias("before"), F.array_join(F.slice(words, F.lit(1), F.lit(RIGHT)), " ").alias("after")))
    parts = parts.select("doc_id", "text_hash", "path", "values", around.alias("around"))
    rows = parts.select("doc_id", "text_hash", "path", F.posexplode(F.arrays_zip("values", F.slice("around", 1, F.size("values")).alias("left"), F.slice("around", 2, F.size("values")).alias("right"))).alias("finding_no", "c"))
    return rows.select("doc_id", "text_hash", "path", "finding_no", F.col("c.values").alias("value"), F.col("c.left.before").alias("before"), F.col("c.right.after").alias("after"))


def _pair_scores(found: DataFrame) -> list[float]:
    """Log-likelihood of each pair of letter kinds (a-z, other) in the words around candidates: 27 * 27 numbers."""
    near = found.select(F.explode(F.split(F.lower(F.concat_ws(" ", "before", "after")), r"[^\p{L}]+")).alias("w")).filter(F.length("w") > 1)
    pairs = near.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))).alias("p"))
    counts = [[1.0] * 27 for _ in range(27)]
    kind = lambda c: F.when(c.between("a", "z"), F.ascii(c) - 97).otherwise(F.lit(26))
    for r in pairs.groupBy(kind(F.substring("p", 1, 1)).alias("a"), kind(F.substring("p", 2, 1)).alias("b")).count().collect():  # at most 729 rows
        counts[r["a"]][r["b"]] += r["count"]
    return [math.log(x / sum(row)) for row in counts for x in row]


def _word_cover(found: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """``(value, coverage)``: the share of a candidate's characters in runs of letters that are words of the corpus."""
    values = found.select("value").distinct()
    runs = materialize(values.select("value", F.explode(F.filter(F.split(F.lower("value"), "[^a-z]+"), lambda x: F.length(x) >= 3)).alias("run")), "runs")
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col).cast("string")), r"[^a-z0-9_+/=\-]+")).alias("run"))
    kinds = runs.select("run").distinct()
    if is_small(kinds, BROADCAST_RUNS):
        counts = words.join(F.broadcast(kinds), "run", "left_semi").groupBy("run").count()
    else:  # counted before any join, so that a frequent word is one row
        counts = words.groupBy("run").count().join(kinds, "run", "left_semi")
    known = counts.filter(F.col("count") >= DICTIONARY_COUNT).select("run")
    return runs.join(known, "run", "left_semi").groupBy("value").agg((F.sum(F.length("run")) / F.first(F.length("value"))).alias("coverage"))


def featured(found: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``found`` (materialised) with the columns of ``FEATURES``."""
    scores = F.array(*[F.lit(x) for x in _pair_scores(found)])
    n = F.length("value")
    v, low = F.col("value"), F.lower("value")
    kinds = F.transform(F.split(low, ""), lambda c: F.when(c.between("a", "z"), F.ascii(c) - 97).otherwise(F.lit(26)))
    first = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last"))
    step = lambda a, k: F.struct((a["sum"] + F.when(a["last"] >= 0, F.get(scores, a["last"] * 27 + k)).otherwise(F.lit(0.0))).alias("sum"), k.alias("last"))
    total = F.aggregate(F.slice(kinds, F.lit(1), n), first, step, lambda a: a["sum"])
    changes = F.regexp_count(v, F.lit("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"))
    joined = found.join(_word_cover(found, docs, text_col), "value", "left")
    flag = lambda c: c.cast("double")
    return joined.select(
        *found.columns,
        n.cast("double").alias("length"), (F.regexp_count(v, F.lit("[0-9]")) / n).alias("digits"), (F.regexp_count(v, F.lit("[A-Z]")) / n).alias("upper"), flag(v.rlike("^[0-9A-Fa-f]+$")).alias("hex"),
        (F.size(F.array_distinct(F.split(v, ""))) / F.sqrt(n)).alias("distinct"), (changes / n).alias("changes"), (total / F.greatest(n - 1, F.lit(1))).alias("pairs"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        (F.size(F.split("path", "/")) - 1).cast("double").alias("depth"), flag(F.col("path").rlike("(?i)test|example|sample|fixture|mock|doc")).alias("test_path"),
        flag(F.col("before").rlike(NAMES)).alias("name_near"), flag(F.col("before").rlike(PUBLIC)).alias("public_near"), flag(F.col("before").rlike(r"[=:]\s*[\"']?$")).alias("assigned"), flag(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).alias("quoted"),
        flag(F.col("before").rlike(r"\p{L}\s*$")).alias("word_before"), flag(v.rlike(KNOWN)).alias("known_form"),
    )


def find_secrets(docs: DataFrame, path: Column | None = None, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` -> all findings with ``probability`` and ``is_secret``.

    ``labelled(value, before, after, path, is_secret)`` are labelled findings, else those of ``labelled_findings``.
    """
    found = materialize(candidates(docs, F.col("source") if path is None else path, id_col, text_col), "candidates")
    labelled = labelled_findings(docs.sparkSession) if labelled is None else labelled
    taught = labelled.filter(F.col("value").isNotNull() & F.col("is_secret").isNotNull()).select("value", *[F.coalesce(c, F.lit("")).alias(c) for c in ("before", "after", "path")], F.col("is_secret").cast("double").alias("label"))
    taught = taught.orderBy(F.xxhash64("value", "before", "after"), "value").limit(MAX_LABELLED)
    both = found.withColumn("label", F.lit(None).cast("double")).unionByName(taught, allowMissingColumns=True)
    rows = materialize(featured(both, docs, text_col), "findings")
    drop_scratch(found)
    known = rows.filter("label IS NOT NULL").select("label", *FEATURES)
    rows = rows.filter("label IS NULL")
    keep = ["doc_id", "text_hash", "finding_no", "value"]
    if known.select("label").distinct().count() < 2:
        return rows.select(*keep, F.lit(None).cast("double").alias("probability"), F.lit(False).alias("is_secret"))
    gather = VectorAssembler(inputCols=FEATURES, outputCol="features")
    known = known.coalesce(1).sortWithinPartitions("label", *FEATURES)  # a bounded sample, in one order: the same forest each time
    model = RandomForestClassifier(numTrees=40, maxDepth=8, seed=7, subsamplingRate=0.8, featureSubsetStrategy="onethird").setLabelCol("label").fit(gather.transform(known))
    scored = model.transform(gather.transform(rows))
    return scored.select(*keep, vector_to_array("probability")[1].alias("probability")).withColumn("is_secret", F.col("probability") >= THRESHOLD)


def redact(docs: DataFrame, path: Column | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with each found secret replaced by ``MASK`` and ``n_chars`` kept right; all columns, no row dropped."""
    own_id, own_hash, held = fresh(docs, "__id", "__hash", "__secrets")
    secrets = find_secrets(docs, path, labelled).filter("is_secret")
    by_doc = materialize(secrets.groupBy(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).agg(F.collect_set("value").alias(held)), "secrets")
    if is_small(by_doc, BROADCAST_DOCS):
        by_doc = F.broadcast(by_doc)
    text = F.col("text").cast("string")
    joined = docs.join(by_doc, F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_hash)), "left")
    values = F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda v: F.when(F.array_contains(held, v), F.lit(MASK)).otherwise(v))
    whole = F.array_join(F.flatten(F.transform(F.arrays_zip(_pieces(text).alias("p"), values.alias("v")), lambda x: F.array(x["p"], F.coalesce(x["v"], F.lit(""))))), "")
    out = joined.withColumn("text", F.when(F.col(held).isNull(), F.col("text")).otherwise(whole))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(held).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings in all documents, paths by source, judged by the forest of the labelled findings."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "finding_no", F.length("value").cast("long").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), F.round("probability", 4).alias("probability"), "is_secret")


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLES: dict[str, str] = {}
