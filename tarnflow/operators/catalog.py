"""Equipment catalog and guides: tree, selection, matching, rendering, estimates."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrow import map_batches
from ..functions.text import normalize_url, strip

#: Bytes of category names in one automaton (a node for each byte at most, some 100 MB), and tasks for each of these.
AUTOMATON_BYTES, AUTOMATON_TASKS = 2_000_000, 64
#: Guides and devices of one category that a task joins with each other.
GUIDES_PER_TASK, DEVICES_PER_TASK = 10_000, 10_000


def _lower(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def select_devices(devices: DataFrame, paths: list[str] | None = None, substring: str | None = None, categories: list[str] | None = None, max_per_category: int | None = None) -> DataFrame:
    """Devices by exact path, part of the path and top category; at most so many of each category, in tree order."""
    top = F.split("path", "/")[0]
    if paths is not None:
        devices = devices.filter(F.col("path").isin(paths))
    if substring is not None:
        devices = devices.filter(F.lower("path").contains(substring.lower()))
    if categories is not None:
        devices = devices.filter(top.isin(categories))
    if max_per_category is not None:
        rank = F.row_number().over(W.partitionBy(top).orderBy("position"))
        devices = devices.withColumn("__rank", rank).filter(F.col("__rank") <= max_per_category).drop("__rank")
    return devices


def validate_guides(guides: DataFrame) -> DataFrame:
    """Adds ``verdict``: rejected (empty), skipped (under 10 characters), untitled (kept with a warning) or good."""
    n = F.length(strip(F.coalesce("raw_content", F.lit(""))))
    verdict = F.when(n == 0, "rejected").when(n < 10, "skipped").when(strip(F.coalesce("title", F.lit(""))) == "", "untitled").otherwise("good")
    return guides.withColumn("verdict", verdict)


def _matched(guides: DataFrame, devices: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Guides with their category ``g``, the distinct categories, ``(g, path, m)`` for each that a device's names contain, and whether
    the categories are few enough for a broadcast. Starts a Spark job, for their size."""
    names = guides.select("guide_id", F.lower(F.trim("category")).alias("g")).filter("g <> ''")
    kinds = names.groupBy("g").agg(F.ceil(F.count("*") / GUIDES_PER_TASK).cast("int").alias("parts"))
    size = kinds.agg(F.sum(F.octet_length("g") + 8).alias("n")).first()["n"] or 0
    once = _categories_in_names(kinds.select("g"), devices, -(-size // AUTOMATON_BYTES) or 1).groupBy("g", "path").agg(F.min(F.struct("position", "model_id")).alias("m"))
    return names, kinds, once, size <= AUTOMATON_BYTES


def match_guides_to_devices(guides: DataFrame, devices: DataFrame) -> DataFrame:
    """``guides(guide_id, category)``, ``devices(model_id, family_name, path, title, position)``: a guide's devices are those
    whose family, path or title contains its category; the first in tree order is primary.

    An automaton over the distinct categories finds all that a device's names contain in one pass over them, however long or
    short a category is. Devices are dealt to tasks by hash; categories of more than ``AUTOMATON_BYTES`` make several automata,
    each of which sees all devices. The guides and the devices of one category meet in blocks of both, in many tasks. There are
    as many rows as pairs: ``guide_device_counts`` needs none of them.
    """
    names, kinds, once, few = _matched(guides, devices)
    first = once.groupBy("g").agg(F.min("m").alias("first"), F.ceil(F.count("*") / DEVICES_PER_TASK).cast("int").alias("device_parts"))
    places = kinds.join(first, "g")
    places = F.broadcast(places) if few else places
    found = once.join(places, "g").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("device_part", F.pmod(F.xxhash64("path"), F.col("device_parts")).cast("int"))
    dealt = names.join(places, "g").withColumn("part", F.pmod(F.xxhash64("guide_id"), F.col("parts")).cast("int")).withColumn("device_part", F.explode(F.sequence(F.lit(0), F.col("device_parts") - 1)))
    return dealt.select("guide_id", "g", "part", "device_part").join(found, ["g", "part", "device_part"]).select("guide_id", "path", "m.model_id", "m.position", (F.col("m") == F.col("first")).alias("is_primary"))


def guide_device_counts(guides: DataFrame, devices: DataFrame) -> DataFrame:
    """``(guide_id, devices, primary_model)`` of guides with devices: the matches of ``match_guides_to_devices``, counted for each
    category and not for each guide, so no pair of guide and device is made."""
    names, _, once, few = _matched(guides, devices)
    counts = once.groupBy("g").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    rows = names.join(F.broadcast(counts) if few else counts, "g")
    return rows.groupBy("guide_id").agg(F.sum("n").alias("devices"), F.min("first")["model_id"].alias("primary_model"))


def _categories_in_names(kinds: DataFrame, devices: DataFrame, shards: int) -> DataFrame:
    """``(g, model_id, path, position)`` for each category that a device's names contain."""
    rows = devices.select("model_id", "path", "position", _lower("family_name").alias("a"), _lower("path").alias("b"), _lower("title").alias("c"))
    model, path, position = (f"{c} {dict(rows.dtypes)[c]}" for c in ("model_id", "path", "position"))
    # A task's rows: the categories of its shard, in each of the shard's tasks, then its devices.
    asked = kinds.select(F.pmod(F.xxhash64("g"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(AUTOMATON_TASKS - 1))).alias("task"), F.lit(False).alias("is_device"), "g")
    dealt = rows.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("model_id", F.lit(1)), F.lit(AUTOMATON_TASKS)).cast("int").alias("task"), F.lit(True).alias("is_device"), *rows.columns)
    placed = asked.unionByName(dealt, allowMissingColumns=True).repartition("shard", "task").sortWithinPartitions("shard", "task", "is_device")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        place, automaton, ready = None, None, False
        for batch in batches:
            taken, found = [], []
            columns = [batch.column(c).to_pylist() for c in ("shard", "task", "is_device", "g", "a", "b", "c")]
            for i, (shard, task, is_device, g, *fields) in enumerate(zip(*columns, strict=True)):
                if (shard, task) != place:
                    place, automaton, ready = (shard, task), ahocorasick.Automaton(), False
                if not is_device:
                    automaton.add_word(g, g)
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                if len(automaton):
                    own = {g for field in fields for _, g in automaton.iter(field)}
                    taken += [i] * len(own)
                    found += own
            rows = batch.select(["model_id", "path", "position"]).take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *rows.columns], names=["g", "model_id", "path", "position"])

    return map_batches(placed, run, f"g string, {model}, {path}, {position}")


def family_sources(models: DataFrame, sources: DataFrame, family_id: str) -> DataFrame:
    return sources.join(models.filter(F.col("family_id") == family_id).select("model_id"), "model_id", "left_semi")


def unembedded_chunks(models: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks without an embedding, with the family that they belong to, for all families at once."""
    more = [c for c in ("created_at",) if c in chunks.columns]
    return chunks.filter("embedding IS NULL").join(sources.select("source_id", "model_id"), "source_id").join(models.select("model_id", "family_id"), "model_id").select("family_id", "source_id", "chunk_id", "chunk_index", *more)


def unembedded_chunks_for_family(models: DataFrame, sources: DataFrame, chunks: DataFrame, family_id: str, limit: int | None = None) -> DataFrame:
    """Those of one family, oldest first and in order, at most ``limit``."""
    rows = unembedded_chunks(models.filter(F.col("family_id") == family_id), sources, chunks).orderBy("created_at", "chunk_index", "chunk_id")
    return rows if limit is None else rows.limit(limit)


def sources_to_process(sources: DataFrame, chunks: DataFrame, overwrite: bool = False) -> DataFrame:
    return sources if overwrite else sources.join(chunks.select("source_id"), "source_id", "left_anti")


def pending_guides(guides: DataFrame, processed: DataFrame, failed: DataFrame, retry_failed: bool = False) -> DataFrame:
    rows = guides.filter("guide_id IS NOT NULL")
    return rows.join(failed.select("guide_id"), "guide_id", "left_semi") if retry_failed else rows.join(processed.select("guide_id"), "guide_id", "left_anti")


def flatten_category_tree(trees: DataFrame, json_col: str = "tree", with_categories: bool = False) -> DataFrame:
    """``trees(tree_id, tree)``: nested JSON objects with any keys, null a device -> ``(tree_id, path, title, depth, is_device)``.

    One pass over each tree, which is a row, however deep it is; nothing runs before the result is asked for. A null tree has
    no rows, one that isn't JSON is an error.
    """
    kind = dict(trees.dtypes)["tree_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                open_nodes = [("", 0, json.loads(text))] if text is not None else []
                while open_nodes:
                    prefix, depth, node = open_nodes.pop()
                    for key, value in node.items():
                        if value is None or with_categories:
                            rows.append((i, prefix + key, key, depth, value is None))
                        if isinstance(value, dict):
                            open_nodes.append((f"{prefix}{key}/", depth + 1, value))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.string(), pa.string(), pa.int32(), pa.bool_())
            ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, t) for x, t in zip(columns[1:], types, strict=True)]], names=["tree_id", "path", "title", "depth", "is_device"])

    return map_batches(trees.select("tree_id", json_col), run, f"tree_id {kind}, path string, title string, depth int, is_device boolean")


def category_device_counts(devices: DataFrame) -> DataFrame:
    """Every inner node of the tree with the devices below it."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = devices.filter(F.contains("path", F.lit("/"))).select(F.explode(prefixes).alias("category"))
    return rows.groupBy("category").agg(F.count("*").alias("devices"))


def top_categories(devices: DataFrame, samples: int = 5) -> DataFrame:
    """Top categories with their number of devices and their first few in tree order."""
    top = F.split("path", "/")[0]
    rank = F.row_number().over(W.partitionBy("category").orderBy("position"))
    rows = devices.withColumn("category", top).withColumn("rank", rank)
    kept = F.array_sort(F.collect_list(F.when(F.col("rank") <= samples, F.struct("rank", "title"))))
    return rows.groupBy("category").agg(F.count("*").alias("devices"), F.array_join(F.transform(kept, lambda x: x["title"]), "|").alias("first_devices"))


def guide_estimate(devices: DataFrame, guide_counts: DataFrame, sample: int = 20) -> DataFrame:
    """Guides by category from the average of the first ``sample`` devices (an estimate by definition)."""
    first = devices.orderBy("position").limit(sample).join(guide_counts, "model_id", "left")
    average = first.agg(F.coalesce(F.avg(F.coalesce("guides", F.lit(0))), F.lit(0.0)).alias("average"))
    top = devices.groupBy(F.split("path", "/")[0].alias("category")).agg(F.count("*").alias("devices"))
    return top.crossJoin(F.broadcast(average)).select("category", "devices", F.floor(F.col("devices") * F.col("average")).alias("guides"), F.round("average", 2).alias("average"))  # one row


def _first_text(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def render_guide(guides: DataFrame) -> DataFrame:
    """``guides(guide_id, title, summary, introduction_raw, introduction, steps, conclusion_raw)`` -> ``(guide_id, raw_content)``.

    ``steps: array<struct<title, lines: array<struct<text, bullet, level>>, images: array<struct<id, url>>>>``.
    """
    marks = {"note": "> **Note:** ", "warning": "> ⚠️ **Warning:** ", "caution": "> ⚠️ **Caution:** ", "tip": "> 💡 **Tip:** "}

    def line(x: Column) -> Column:
        indent = F.repeat(F.lit("  "), F.coalesce(x["level"], F.lit(0)))
        out = F.when(F.coalesce(x["bullet"], F.lit("")) == "", F.concat(indent, x["text"])).otherwise(F.concat(indent, F.lit("- "), x["text"]))
        for name, mark in marks.items():
            out = F.when(x["bullet"].isin(name, f"icon_{name}"), F.concat(F.lit(mark), x["text"])).otherwise(out)
        return out

    def step(s: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        title = _first_text(s["title"])
        head = F.when(title.isNull(), F.concat(F.lit("## "), number, F.lit(". Step "), number)).when(strip(title) == "", F.concat(F.lit("## Step "), number)).otherwise(F.concat(F.lit("## "), number, F.lit(". "), title))
        said = F.transform(F.filter(s["lines"], lambda x: F.coalesce(x["text"], F.lit("")) != ""), line)
        shown = F.transform(F.filter(s["images"], lambda x: F.coalesce(x["url"], F.lit("")) != ""), lambda x: F.concat(F.lit("![Step "), number, F.lit(" Image "), x["id"].cast("string"), F.lit("]("), x["url"], F.lit(")")))
        return F.concat(F.array(F.lit(""), head), said, shown)

    none = F.array().cast("array<string>")
    block = lambda c, before=(): F.when(c.isNull(), none).otherwise(F.concat(F.array(F.lit(""), *[F.lit(b) for b in before]), F.array(c)))
    intro = _first_text(F.col("introduction_raw"), F.col("introduction"), F.col("summary"))
    end = _first_text(F.col("conclusion_raw"))
    parts = F.concat(F.array(F.concat(F.lit("# "), F.coalesce(_first_text(F.col("title")), F.lit("Untitled Guide")))), block(intro), F.flatten(F.transform("steps", step)), block(end, ("## Conclusion", "")))
    return guides.select("guide_id", F.array_join(parts, "\n").alias("raw_content"))


def guide_metadata(summary: DataFrame, detail: DataFrame, base: str) -> DataFrame:
    """The summary's field, else the detail's, an empty text counting as none; links made absolute; empty lists null."""
    fields = ["url", "difficulty", "type", "subject", "locale"]
    d = detail.select("guide_id", *[F.col(f).alias(f"__{f}") for f in fields], "time_required_min", "tools")
    both = summary.join(d, "guide_id", "left")
    out = both.select("guide_id", *[_first_text(F.col(f), F.col(f"__{f}")).alias(f) for f in fields], "time_required_min", F.when(F.size("tools") > 0, F.col("tools")).alias("tools"))
    return out.withColumn("url", normalize_url(F.col("url"), base))
