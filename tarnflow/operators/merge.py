"""Keyed writes as functions from a target and updates to the new target: upserts, replacements, cascading deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dedupe_keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("__rank = 1").drop("__rank")


def _fold(updates: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Several updates of one key in order: the last value that isn't null of each column; maps are merged."""
    kinds = dict(updates.dtypes)
    rows = updates.groupBy(key)
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)

    def merged(c: str) -> Column:
        maps = F.transform(F.array_sort(F.collect_list(F.struct(order, F.map_entries(c).alias("e")))), lambda x: x["e"])
        return F.aggregate(maps, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda a, e: shallow_merge(a, F.map_from_entries(e))).alias(c)

    return rows.agg(*[merged(c) if kinds[c].startswith("map") else last(c) for c in columns])


def shallow_merge(old: Column, new: Column) -> Column:
    """Keys of both maps, the new ones' values first."""
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new))


def _upsert(target: DataFrame, updates: DataFrame, key: str, order: str, rules: dict[str, str]) -> DataFrame:
    """Full outer join by key. Rules for a column: ``new`` replaced, ``fill`` new unless null, ``text`` new unless empty, ``merge`` maps, ``keep`` old if the row exists."""
    columns = [c for c in target.columns if c != key]
    new = _fold(updates, key, order, [c for c in columns if c in updates.columns])
    new = new.select(key, F.lit(True).alias("__new"), *[F.col(c).alias(f"__n_{c}") for c in columns if c in updates.columns])
    both = target.withColumn("__old", F.lit(True)).join(new, key, "full")

    def value(c: str) -> Column:
        if f"__n_{c}" not in new.columns:
            return F.col(c)
        old, fresh, rule = F.col(c), F.col(f"__n_{c}"), rules.get(c, "fill")
        if rule == "merge":
            return shallow_merge(old, fresh)
        if rule == "new":
            return F.when(F.col("__new"), fresh).otherwise(old)
        if rule == "keep":
            return F.when(F.col("__old"), old).otherwise(fresh)
        return F.coalesce(F.nullif(fresh, F.lit("")) if rule == "text" else fresh, old)

    return both.select(key, *[value(c).alias(c) for c in columns])


def upsert_families(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Name replaced; description filled; metadata merged, new keys first."""
    return _upsert(target, updates, "family_id", "seq", {"name": "new", "metadata": "merge"})


def upsert_models(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Texts and images filled, metadata merged; a model keeps its family."""
    return _upsert(target, updates, "model_id", "seq", {"family_id": "keep", "metadata": "merge"})


def upsert_sources(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Empty texts keep the old ones; applicable devices are united by model (the later wins, the first place stays)."""
    plain = _upsert(target.drop("devices"), updates.drop("devices"), "source_id", "seq", {"title": "text", "raw_content": "text", "metadata": "merge"})
    old = target.select("source_id", F.lit(-1).cast("long").alias("seq"), F.posexplode("devices").alias("i", "d"))
    new = updates.select("source_id", F.col("seq").cast("long").alias("seq"), F.posexplode("devices").alias("i", "d"))
    rows = old.unionByName(new).select("source_id", F.struct("seq", "i").alias("at"), "d")
    each = rows.groupBy("source_id", F.col("d.model_id").alias("model_id")).agg(F.min("at").alias("first"), F.max_by("d", "at").alias("d"))
    devices = each.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "d"))), lambda x: x["d"]).alias("devices"))
    return plain.join(devices, "source_id", "left").select(*target.columns)


def insert_if_absent(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return target.unionByName(rows.dropDuplicates(key).join(target.select(*key), key, "left_anti"))


def replace_source_chunks(target: DataFrame, new_chunks: DataFrame, overwrite: bool = True) -> DataFrame:
    """``overwrite``: the chunks of the sources touched are replaced; else new chunks of sources that have some are refused."""
    if overwrite:
        return target.join(new_chunks.select("source_id").distinct(), "source_id", "left_anti").unionByName(new_chunks)
    return target.unionByName(new_chunks.join(target.select("source_id").distinct(), "source_id", "left_anti"))


def refused_sources(target: DataFrame, new_chunks: DataFrame) -> DataFrame:
    return new_chunks.select("source_id").distinct().join(target.select("source_id"), "source_id", "left_semi")


def apply_embeddings(chunks: DataFrame, results: DataFrame, dims: int = 1536, only_if_null: bool = True) -> DataFrame:
    """``results(chunk_id, new)`` set on chunks without an embedding; a vector of another size sets nothing."""
    good = results.filter(F.size("new") == dims).groupBy("chunk_id").agg(F.max_by("new", F.xxhash64("new")).alias("__new"))
    fits = F.col("embedding").isNull() if only_if_null else F.lit(True)
    return chunks.join(good, "chunk_id", "left").withColumn("embedding", F.when(fits & F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col("embedding"))).drop("__new")


def wrong_dimensions(results: DataFrame, dims: int = 1536) -> DataFrame:
    return results.filter(F.coalesce(F.size("new") != dims, F.lit(True))).select("chunk_id", F.concat(F.lit("expected "), F.lit(dims), F.lit(" dimensions, found "), F.greatest(F.size("new"), F.lit(0))).alias("error"))


def cascade_delete(tables: dict[str, DataFrame], user_ids: DataFrame) -> dict[str, DataFrame]:
    """Users gone, with their sessions, messages, attachments, image analyses, subscriptions, settings and uploads; their
    sources become shared."""
    out = dict(tables)
    gone = user_ids.select("user_id").distinct()
    for name in ("users", "sessions", "subscriptions", "settings", "uploads"):
        if name in out:
            out[name] = out[name].join(gone, "user_id", "left_anti")
    if "messages" in out:
        out["messages"] = out["messages"].join(tables["sessions"].join(gone, "user_id", "left_semi").select("session_id"), "session_id", "left_anti")
    if "attachments" in out:
        out["attachments"] = out["attachments"].join(out["messages"].select("message_id"), "message_id", "left_semi")
    if "analyses" in out:
        out["analyses"] = out["analyses"].join(out["attachments"].select("attachment_id"), "attachment_id", "left_semi")
    if "sources" in out:
        marked = out["sources"].join(gone.withColumn("__gone", F.lit(True)), "user_id", "left")
        out["sources"] = marked.withColumn("user_id", F.when(F.col("__gone").isNull(), F.col("user_id"))).select(*tables["sources"].columns)
    return out


def delete_documents(uploads: DataFrame, sources: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Uploads ``ids(upload_id)`` removed, each with the source that it is linked to (``source_id``) or, where it is linked to
    none, those of its user and file name, and their chunks."""
    gone = uploads.join(ids, "upload_id", "left_semi")
    linked = gone.filter("source_id IS NOT NULL").select("source_id") if "source_id" in uploads.columns else None
    named = (gone if linked is None else gone.filter("source_id IS NULL")).select("user_id", F.col("file_name").alias("title")).distinct()
    dead = sources.filter("source_type = 'pdf'").join(named, ["user_id", "title"], "left_semi").select("source_id")
    dead = dead if linked is None else dead.union(linked).distinct()
    return uploads.join(ids, "upload_id", "left_anti"), sources.join(dead, "source_id", "left_anti"), chunks.join(dead, "source_id", "left_anti")


def new_keys(candidate: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    return candidate.select(*key).distinct().join(existing.select(*key), key, "left_anti")
