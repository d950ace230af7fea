"""Audits of stored sources, chunks and catalog rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip, word_count


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 100 / whole)).otherwise(F.lit(0)).cast("long")


def orphans(child: DataFrame, parent: DataFrame, fk: str, key: str) -> DataFrame:
    """Rows whose foreign key isn't null and has no parent."""
    return child.filter(F.col(fk).isNotNull()).join(parent.select(F.col(key).alias(fk)), fk, "left_anti")


def parents_without_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children.select(key), key, "left_anti")


def chunk_source_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.round(F.avg("token_count"), 4).alias("avg_tokens"), F.count("embedding").alias("embedded"), F.count("heading").alias("with_heading"))


def chunk_quality_audit(chunks: DataFrame) -> DataFrame:
    """Counts of chunks that kept dotted lines, placeholders, copyright or dangling links; token range."""
    c, low = F.col("content"), F.lower("content")
    return chunks.agg(
        F.count("*").alias("chunks"), F.count_if(c.rlike(r"\.{3,}")).alias("dotted"), F.count_if(low.contains("[image")).alias("image_marks"), F.count_if(low.contains("copyright") | c.contains("©")).alias("copyright"),
        F.count_if(c.contains("[TABLE_PLACEHOLDER]")).alias("table_marks"), F.count_if(low.rlike(r"url:\s*($|\n)")).alias("dangling"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"), F.floor(F.avg("token_count")).alias("avg_tokens"),
    )


def content_type_histogram(chunks: DataFrame) -> DataFrame:
    """Chunks and tokens of each content type, and whether chunks of it are embedded (narrative ones are)."""
    return chunks.groupBy("content_type").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens")).withColumn("embeddable", F.col("content_type") == "narrative")


def content_length_stats(sources: DataFrame, source_type: str) -> DataFrame:
    n, size = F.count("*"), F.length("raw_content")
    return sources.filter(F.col("source_type") == source_type).agg(
        n.alias("total"), F.count_if(size > 100).alias("over_100"), F.count_if(size > 1000).alias("over_1000"), percent(F.count_if(size > 100), n).alias("percent_over_100"), percent(F.count_if(size > 1000), n).alias("percent_over_1000"),
        F.round(F.avg(size), 4).alias("avg_length"), F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.round(F.avg(word_count(F.col("raw_content"))), 4).alias("avg_words"),
    )


def field_completeness(sources: DataFrame) -> DataFrame:
    n = F.count("*")
    content = F.count_if(F.length("raw_content") > 10)
    verdict = F.when(content == n, "PASSED").when(content > 0.9 * n, "WARNING").otherwise("FAILED")
    return sources.agg(n.alias("total"), F.count_if(F.coalesce("title", F.lit("")) != "").alias("title"), content.alias("content"), F.count("model_id").alias("model"), F.count_if(word_count(F.col("raw_content")) > 0).alias("words"), percent(F.count("model_id"), n).alias("model_percent"), verdict.alias("verdict"))


def content_structure(sources: DataFrame) -> DataFrame:
    c = F.col("raw_content")
    return sources.agg(F.count("*").alias("total"), F.count_if(c.contains("##")).alias("with_sections"), F.count_if(c.contains("Note:") | c.contains("Warning:") | c.contains("Caution:")).alias("with_notes"), F.count_if(c.contains("# ") & (F.length(c) > 100)).alias("with_titles"))


def metadata_completeness(sources: DataFrame) -> DataFrame:
    """``metadata`` as JSON text: a scalar null counts as absent, a nested null as present."""
    v = F.try_parse_json("metadata")
    scalar = lambda p: F.count_if(F.try_variant_get(v, p, "string").isNotNull())
    nested = lambda p: F.count_if(F.try_variant_get(v, p, "variant").isNotNull())
    return sources.agg(F.count("*").alias("total"), scalar("$.guide_id").alias("guide_id"), scalar("$.url").alias("url"), nested("$.step_images").alias("step_images"), nested("$.tools").alias("tools"), nested("$.parts").alias("parts"))


def validation_issues(families: DataFrame, models: DataFrame, sources: DataFrame) -> DataFrame:
    """``(section, type, id, message)`` of every fault of the three tables."""

    def rows(df: DataFrame, section: str, key: str, rules: dict[str, Column]) -> DataFrame:
        found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
        out = df.select(F.lit(section).alias("section"), F.explode(found).alias("type"), F.col(key).cast("string").alias("id"))
        return out.withColumn("message", F.concat("type", F.lit(" in "), "section", F.lit(" "), "id"))

    blank = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) == ""
    always = lambda k: {k: F.lit(True)}
    content = F.coalesce("raw_content", F.lit(""))
    parts = [
        rows(families, "families", "family_id", {"missing_name": blank("family_name")}),
        rows(models, "models", "model_id", {"missing_model_name": blank("title")}),
        rows(orphans(models, families, "family_id", "family_id"), "models", "model_id", always("orphaned_model")),
        rows(sources, "sources", "source_id", {"missing_title": blank("title"), "missing_content": content == "", "short_content": (content != "") & (F.length(strip(content)) < 10), "missing_metadata": F.col("metadata").isNull(), "invalid_metadata": F.col("metadata").isNotNull() & F.try_parse_json("metadata").isNull()}),
        rows(orphans(sources, models, "model_id", "model_id"), "sources", "source_id", always("orphaned_source")),
        rows(parents_without_children(families, models, "family_id"), "families", "family_id", always("family_without_models")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validation_summary(issues: DataFrame) -> DataFrame:
    """Issues in all, by section and by type, in one pass."""
    return issues.groupingSets([[], ["section"], ["type"]], "section", "type").agg(F.count("*").alias("n"))


def validation_stats(families: DataFrame, models: DataFrame, sources: DataFrame) -> DataFrame:
    """``(section, field, n)``: the rows of each table, and how many have each of its fields (a blank text is none)."""

    def counts(df: DataFrame, section: str, fields: dict[str, Column]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(k).alias("field"), c.alias("n")) for k, c in {"total": F.count("*"), **{f"with_{k}": F.count_if(c) for k, c in fields.items()}}.items()])
        return df.agg(pairs.alias("p")).select(F.lit(section).alias("section"), F.inline("p"))

    some = lambda c: F.coalesce(strip(F.col(c)) != "", F.lit(False))
    held = [("family_name", "name"), ("description", "description")]
    family = counts(families, "families", {name: some(c) for c, name in held if c in families.columns})
    model = counts(models, "models", {"name": some("title"), "family": F.col("family_id").isNotNull()})
    source = counts(sources, "sources", {"title": some("title"), "content": F.coalesce(F.col("raw_content") != "", F.lit(False)), "model": F.col("model_id").isNotNull(), "metadata": F.col("metadata").isNotNull()})
    return family.unionByName(model).unionByName(source)


def keyword_inventory(sources: DataFrame, models: DataFrame, families: DataFrame, chunks: DataFrame, keyword: str) -> DataFrame:
    """Rows and matches by table, the sources of matching models, and the models of matching families."""
    has = lambda c: F.count_if(F.lower(F.col(c)).contains(keyword.lower()))
    total = F.count("*").alias("total")
    each = [
        sources.agg(F.lit("sources").alias("name"), total, has("raw_content").alias("matches")), models.agg(F.lit("models").alias("name"), total, has("title").alias("matches")), chunks.agg(F.lit("chunks").alias("name"), total, has("content").alias("matches")),
        families.agg(F.lit("families").alias("name"), total, has("name").alias("matches")),
    ]
    within = models.join(families.filter(F.lower("name").contains(keyword.lower())).select("family_id"), "family_id", "left_semi")
    each.append(within.agg(F.lit("models of families").alias("name"), total, has("title").alias("matches")))
    linked = sources.join(models.filter(F.lower("title").contains(keyword.lower())).select("model_id"), "model_id").agg(F.lit("sources of models").alias("name"), total, F.count_distinct("source_id").alias("matches"))
    typed = chunks.join(sources.select("source_id", "source_type"), "source_id").groupBy(F.concat(F.lit("chunks of "), "source_type").alias("name")).agg(total, has("content").alias("matches"))
    out = linked.unionByName(typed)
    for e in each:
        out = out.unionByName(e)
    return out


def reconcile_counts(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """``expected(key, expected)`` against the stored rows of each key."""
    stored = actual.groupBy(key).agg(F.count("*").alias("stored"))
    both = expected.join(stored, key, "full")
    return both.select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("stored", F.lit(0)).alias("stored")).withColumn("matches", F.col("expected") == F.col("stored"))


def top_documents(sources: DataFrame, models: DataFrame, n: int = 3, by: str = "length", title_like: str | None = None) -> DataFrame:
    """The longest sources (with a title like the pattern) with a preview, their link and model's title; the limit is the report's size."""
    size = F.length("raw_content") if by == "length" else word_count(F.col("raw_content"))
    rows = sources if title_like is None else sources.filter(F.col("title").ilike(title_like))
    top = rows.withColumn("size", size).orderBy(F.col("size").desc(), "source_id").limit(n)
    link = F.get_json_object("metadata", "$.url") if "metadata" in sources.columns else F.lit(None).cast("string")
    return top.join(models.select("model_id", F.col("title").alias("model_title")), "model_id", "left").select("source_id", "title", "size", F.left("raw_content", F.lit(40)).alias("preview"), "model_title", link.alias("url"))


def size_bucket_sample(sources: DataFrame, n: int = 2) -> DataFrame:
    """``n`` sources of each size class: the shortest small and medium ones, the longest large ones."""
    words = word_count(F.col("raw_content"))
    rows = sources.withColumn("words", words).withColumn("bucket", F.when(words < 500, "small").when(words < 2000, "medium").otherwise("large"))
    rank = F.row_number().over(W.partitionBy("bucket").orderBy(F.when(F.col("bucket") == "large", -F.col("words")).otherwise(F.col("words")), "source_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n).select("bucket", "rank", "source_id", "words")


def edge_case_sample(sources: DataFrame, n: int = 1) -> DataFrame:
    """``n`` sources of each odd kind: under 100 words (shortest first), a single step, many ``##`` marks in 500 to 1500
    words (most first), over 2000 words; ties by id."""
    words, text = word_count(F.col("raw_content")), F.col("raw_content")
    marks = ((F.length(text) - F.length(F.replace(text, F.lit("##"), F.lit("")))) / 2).cast("int")
    rows = sources.select("source_id", text, words.alias("words"), marks.alias("marks"))
    single = text.contains("## 1.") & ~text.contains("## 2.") & ~text.contains("## 3.")
    kinds = {"very_short": (F.col("words") < 100, F.col("words")), "single_step": (single, F.lit(0)), "many_steps": (F.col("words").between(500, 1500) & (F.col("marks") > 10), -F.col("marks")), "long": (F.col("words") > 2000, F.lit(0))}
    of = F.filter(F.array(*[F.when(F.coalesce(fits, F.lit(False)), F.struct(F.lit(k).alias("kind"), order.cast("int").alias("order"))) for k, (fits, order) in kinds.items()]), lambda k: k.isNotNull())
    each = rows.select("source_id", "words", F.inline(of))
    rank = F.row_number().over(W.partitionBy("kind").orderBy("order", "source_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= n).select("kind", "rank", "source_id", "words")


def filter_chunks_by_words(chunks: DataFrame, least: int = 10, most: int = 5000) -> DataFrame:
    return chunks.filter(word_count(F.col("content")).between(least, most))


def embedding_ingest_stats(results: DataFrame) -> DataFrame:
    return results.groupBy("batch_no").agg(F.count("*").alias("lines"), F.count("error").alias("failed"), F.count_if(F.col("error").isNull()).alias("updates"))
