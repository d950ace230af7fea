"""Operator 3: near-duplicate groups by MinHash with tensored banding.

A text's set is its distinct ``k``-word shingles. Two collections of ``m`` band values with ``t`` minhashes each are
computed (``2 * m * t`` minhashes), and the table keys are all ``m * m`` pairs of a value of the first with one of the
second: as many tables of ``2 * t`` minhashes would take ``m * m * 2 * t`` minhashes otherwise. Two texts of similarity
``s`` share no table with probability of at most ``2 * (1 - s**t)**m``: 2.5e-4 at 0.85 for ``t=2, m=7``.

Every candidate is confirmed on the full sets. Texts with equal sets form a class that one document stands for, so
copies are never paired. In a table's bucket every member is compared with one hub. Where that leaves members in
different components, those outside the largest one are compared with all: both are dealt to blocks of bounded size, and
two blocks meet inside one task, which gives out no more links than it takes to join what it found together. So no pair that shares a bucket is
lost, no bucket is expanded into its pairs, and no task holds more than two blocks.

Defined results: a null or wordless text has an empty set, ``n_shingles`` 0, is its own component and is kept; rows that
repeat a doc_id each give a row and count as one node; a null doc_id joins no group (component null, kept false); an
empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, fresh, is_small, map_arrow, materialize, table, text_bytes
from .components import connected_components
from .shingles import mix, shingle_sets

#: Ids that a broadcast may hold: 8 bytes each, 16 MB at most. More are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Pairs, or places of open groups' members, that a broadcast may hold: 40 bytes each, 20 MB at most.
BROADCAST_PLACES = 500_000
#: A class with more copies is joined by a broadcast of the few such classes, so that no task gets all its copies.
HOT_COPIES, BROADCAST_CLASSES = 1_000, 200_000
#: What tells classes of equal sets apart: their size and two independent 64-bit sums over their shingles.
PRINTS = ["n_shingles", "print_a", "print_b"]
#: Members and bytes of text of a block; a task holds two.
BLOCK_MEMBERS, BLOCK_TEXT = 256, 8_000_000
#: Members that meet one copy of their hub's text.
HUB_MEMBERS = 64


def band_keys(sets: list[np.ndarray], t: int, m: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``m * m`` table keys of each set that isn't empty, one after another, and the offsets of each set's keys;
    likewise its ``m`` band values of the first collection."""
    rng = np.random.Generator(np.random.PCG64(seed))
    scale = rng.integers(1, 2**63, (2 * m * t, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, (2 * m * t, 1), dtype=np.uint64)
    pair = mix(np.arange(1, m * m + 1, dtype=np.uint64)).reshape(m, m)
    mins = np.empty((len(sets), 2 * m * t), np.uint64)
    for i, s in enumerate(sets):
        low = None
        for at in range(0, len(s), 4096):
            part = (scale * s[None, at : at + 4096] + shift).min(axis=1)
            low = part if low is None else np.minimum(low, part)
        mins[i] = 0 if low is None else low
    band = mins.reshape(len(sets), 2, m, t)
    value = np.zeros((len(sets), 2, m), np.uint64)
    for i in range(t):
        value = mix(value * np.uint64(31) + band[..., i])
    keys = mix(value[:, 0, :, None] * np.uint64(3) + mix(value[:, 1, None, :] + np.uint64(9)) + pair[None])
    full = np.array([len(s) > 0 for s in sets], dtype=bool)
    first = mix(value[:, 0] + pair[0])

    def flat(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return x.reshape(len(sets), width)[full].ravel().view(np.int64), np.r_[0, np.cumsum(full * width)].astype(np.int32)

    return *flat(keys, m * m), *flat(first, m)


def _signatures(k: int, t: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            for texts in blocks(batch.column(1).to_pylist()):
                sets = shingle_sets(texts, k)
                keys, offsets, bands, band_offsets = band_keys(sets, t, m)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                        pa.array(np.array([np.bitwise_xor.reduce(mix(s + np.uint64(77))) if len(s) else 0 for s in sets], np.uint64).view(np.int64)),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys)),
                        pa.ListArray.from_arrays(pa.array(band_offsets), pa.array(bands)),
                    ],
                    names=["doc_id", "n_shingles", "print_a", "print_b", "n_bytes", "keys", "bands"],
                )
                at += len(texts)

    return run


def _confirmed(k: int, percent: int):
    """Rows ``(a, block, b, text)`` in that order, a hub's own with a null ``b`` first -> the pairs whose full sets have
    100 * intersection >= percent * union. A hub with several texts is compared with all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, hub_sets = None, []
        for batch in batches:
            hubs, own_blocks, members, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), 0
            for texts in blocks(batch.column(3).to_pylist()):
                linked = []
                for i, own in enumerate(shingle_sets(texts, k), at):
                    if (hubs[i], own_blocks[i]) != place:
                        place, hub_sets = (hubs[i], own_blocks[i]), []
                    if members[i] is None:
                        hub_sets.append(own)
                        continue
                    for hub in hub_sets:
                        both = len(np.intersect1d(own, hub, assume_unique=True))
                        if both and 100 * both >= percent * (len(own) + len(hub) - both):
                            linked.append(i)
                            break
                at += len(texts)
                if linked:
                    yield pa.RecordBatch.from_arrays([pa.array([hubs[i] for i in linked], pa.int64()), pa.array([members[i] for i in linked], pa.int64())], names=["a", "b"])

    return run


def confirm(pairs: DataFrame, n_pairs: int, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The ``n_pairs`` of ``pairs(a, b)`` whose whole ``texts(doc_id, text)`` are similar enough. ``pairs`` must be materialised.

    A hub's text goes once to each block of ``HUB_MEMBERS`` or so of its members, which then stream past it. Up to
    ``BROADCAST_PLACES`` pairs go to the texts, so that a text is shuffled once, to its hub; beyond it texts are shuffled to the pairs first.
    """
    small = (lambda df: F.broadcast(df)) if n_pairs <= BROADCAST_PLACES else (lambda df: df)
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_MEMBERS).cast("int").alias("parts"))
    block = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("block")
    members = texts.withColumnRenamed("doc_id", "b").join(small(pairs.join(hubs, "a").select("a", block, "b")), "b").select("a", "block", "b", "text")
    own = texts.withColumnRenamed("doc_id", "a").join(small(hubs), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), F.lit(None).cast("long").alias("b"), "text")
    placed = own.unionByName(members).repartition("a", "block").sortWithinPartitions("a", "block", F.asc_nulls_first("b"))
    return map_arrow(placed, _confirmed(k, percent), "a long, b long").distinct()


def _compare_blocks(k: int, percent: int):
    """Each ``open`` member of a block against all members of another -> links between different components, as few as join
    what is found."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*[group[c].to_pylist() for c in ("doc_id", "component", "open", "text")], strict=True), key=lambda r: (r[0], r[2]))
        sets = [s for texts in blocks(r[3] for r in rows) for s in shingle_sets(texts, k)]
        is_open, component = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
        sizes = np.array([len(s) for s in sets])
        shingles, place = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(place, kind="stable")
        owner = np.repeat(np.arange(len(sets)), sizes)[order]
        first = np.searchsorted(place[order], np.arange(len(shingles) + 1))
        parent = {c: c for c in component.tolist()}

        def root(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        a, b = [], []
        ends = np.r_[0, np.cumsum(sizes)]
        for i in np.flatnonzero(is_open).tolist():
            own = place[ends[i] : ends[i + 1]]
            starts, lengths = first[own], first[own + 1] - first[own]
            at = np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            near = (100 * both >= percent * (sizes[i] + sizes - both)) & (component != component[i]) & ~is_open
            for j in np.flatnonzero(near).tolist():
                x, y = root(rows[i][1]), root(rows[j][1])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    a.append(min(rows[i][0], rows[j][0]))
                    b.append(max(rows[i][0], rows[j][0]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _pairs(left, right):
    return F.least(left, right).alias("a"), F.greatest(left, right).alias("b")


def _open_links(banded: DataFrame, members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between different components among ``members(doc_id, component)``, which share a band value.

    A pair that shares a table key shares a band value of the first collection, so those groups, ``m`` for a document
    instead of ``m * m``, hold every pair. Two members of a group's largest component need no link: only the others, the
    open ones, are compared with all, a block of open ones with a block of all in each task.
    """
    own = banded.join(members, "doc_id").select(F.explode("bands").alias("band"), "doc_id", "component", F.col("n_bytes").alias("size"))
    own = materialize(own, "open")
    each = own.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    mixed = each.groupBy("band").agg(F.max_by(F.struct("component", "n", "size"), F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size")).filter("main.n < n")
    parts = lambda n, size: F.ceil(F.greatest(n / BLOCK_MEMBERS, size / BLOCK_TEXT, F.lit(1.0))).cast("int")
    mixed = mixed.select("band", F.col("main.component").alias("main"), parts(F.col("n"), F.col("size")).alias("parts"), parts(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("open_parts"))
    block = lambda n, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = own.drop("size").join(mixed, "band")
    as_all = dealt.select("band", "doc_id", "component", F.lit(False).alias("open"), every("open_parts").alias("row"), block("parts", 1).alias("column"))
    as_open = dealt.filter("component <> main").select("band", "doc_id", "component", F.lit(True).alias("open"), block("open_parts", 2).alias("row"), every("parts").alias("column"))
    placed = materialize(as_all.unionByName(as_open), "placed")
    whole = texts.join(F.broadcast(placed) if placed.count() <= BROADCAST_PLACES else placed, "doc_id")
    return whole.select(*placed.columns, "text").groupBy("band", "row", "column").applyInArrow(_compare_blocks(k, percent), "a long, b long")


def find_components(banded: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame | None:
    """``(node, component)`` of the class representatives with links; None if no two share a table key.

    ``banded(doc_id, n_bytes, keys, bands)`` has a row for each representative.
    """
    rows = banded.select(F.explode("keys").alias("key"), "doc_id")
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("hub")).filter("n > 1").select("key", "hub")
    bucket = materialize(rows.join(shared, "key").select("key", "hub", "doc_id"), "buckets")
    pairs = materialize(bucket.filter("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    n_pairs = pairs.count()
    if not n_pairs:
        return None
    found = connected_components(materialize(confirm(pairs, n_pairs, texts, k, percent), "links"))
    known = bucket.select("key", "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    members = materialize(known.join(mixed, "key", "left_semi").select("doc_id", "component").distinct(), "members")
    if not members.count():
        return found
    more = _open_links(banded.select("doc_id", "n_bytes", "bands"), members, texts, k, percent)
    of = lambda name: members.select(F.col("doc_id").alias(name), F.col("component").alias(f"component_{name}"))
    between = materialize(more.join(of("a"), "a").join(of("b"), "b").select(*_pairs("component_a", "component_b")).distinct(), "between")
    if not between.count():
        return found
    joined = connected_components(between).select(F.col("node").alias("component"), F.col("component").alias("root"))
    nodes = found.union(members.select(F.col("doc_id").alias("node"), "component")).distinct()
    return nodes.join(joined, "component", "left").select("node", F.coalesce("root", "component").alias("component"))


def _of_class(known: DataFrame, classes: DataFrame, column: str) -> DataFrame:
    """Each row of ``known(doc_id, *PRINTS)`` with ``column`` of its class; no task gets all copies of a large class."""
    hot = classes.filter(F.col("copies") > HOT_COPIES).select(*PRINTS, F.col(column).alias("hot"))
    if not is_small(hot, BROADCAST_CLASSES):
        return known.join(classes.select(*PRINTS, column), PRINTS)
    marked = known.join(F.broadcast(hot), PRINTS, "left")
    rest = marked.filter("hot IS NULL").drop("hot").join(classes.select(*PRINTS, column), PRINTS)
    return marked.filter("hot IS NOT NULL").withColumnRenamed("hot", column).unionByName(rest)


def near_duplicate_groups(docs: DataFrame, k: int = 5, percent: int = 80, t: int = 2, m: int = 7, id_col: str = "doc_id", text_col: str = "text", one_text: bool = False, sign=None, find=None) -> DataFrame:
    """``docs`` -> ``(doc_id, n_shingles, component_id, kept)`` with a row for each input row.

    ``one_text`` tells that no id stands on different texts. Another way to find links has its own ``sign``, which gives the
    columns of ``_signatures``, and its own ``find`` in place of ``find_components``.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    schema = "doc_id long, n_shingles long, print_a long, print_b long, n_bytes long, keys array<long>, bands array<long>"
    signed = materialize(map_arrow(source, sign or _signatures(k, t, m), schema), "signatures")
    known = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", *PRINTS)
    classes = materialize(known.groupBy(*PRINTS).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    banded = signed.join(classes.select(F.col("rep").alias("doc_id"), *PRINTS), ["doc_id", *PRINTS], "left_semi").dropDuplicates(["doc_id", *PRINTS]).select("doc_id", *PRINTS, "n_bytes", "keys", "bands")
    component = (find or find_components)(banded, source.filter("doc_id IS NOT NULL"), k, percent)
    # One id with several texts belongs to several classes: it links them.
    several = known.groupBy("doc_id").agg(F.min("print_a").alias("low"), F.max("print_a").alias("high")).filter("low < high").select("doc_id")
    if not one_text and not several.isEmpty():
        links = _of_class(known.join(several, "doc_id", "left_semi"), classes, "rep").filter("doc_id <> rep").select(*_pairs("doc_id", "rep"))
        links = links if component is None else links.union(component.filter("node <> component").select(*_pairs("node", "component")))
        component = connected_components(materialize(links.distinct(), "links"))
    if component is None:
        classes = classes.withColumn("component_id", F.col("rep"))
    else:
        classes = materialize(classes.join(component.withColumnRenamed("node", "rep"), "rep", "left").select(*PRINTS, "copies", F.coalesce("component", "rep").alias("component_id")), "components")
    grouped = _of_class(known, classes, "component_id").select("doc_id", "n_shingles", "component_id")
    # A row without words stands alone unless its id has words elsewhere; a null id stands for nothing.
    empty = signed.filter("n_shingles = 0 AND doc_id IS NOT NULL").select("doc_id", "n_shingles")
    elsewhere = grouped.join(empty.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    empty = empty.join(elsewhere, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = signed.filter("doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = grouped.unionByName(empty).unionByName(nameless)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, t: int = 2, m: int = 8) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, with all columns: that of the smallest doc_id.

    Every pair of id and text is a document here: an id that stands on different texts is several, and rows without an id
    are documents by their text. Rows of the same id and text are one, of which the first in the order of its other columns
    stays. Texts without words resemble nothing.
    """
    node, own, first = fresh(docs, "__node", "__own", "__first")
    text_hash = F.xxhash64(F.col("text").cast("string"))
    key = F.col("doc_id").cast("long")
    clashing = docs.filter("doc_id IS NOT NULL").groupBy(key.alias(own)).agg(F.min(text_hash).alias("low"), F.max(text_hash).alias("high")).filter("low < high").select(own)
    clashing = materialize(clashing, "clashing")
    n_clashing = clashing.count()
    made = F.xxhash64(key, text_hash).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)  # above all usual ids
    if not n_clashing:
        nodes = docs.withColumn(node, F.coalesce(key, made))
    else:
        ids = F.broadcast(clashing) if n_clashing <= BROADCAST_IDS else clashing
        nodes = docs.join(ids, key == F.col(own), "left").withColumn(node, F.when(F.col(own).isNull(), F.coalesce(key, made)).otherwise(made)).drop(own)
    groups = near_duplicate_groups(nodes.select(node, "text"), k, percent, t, m, id_col=node, one_text=True)
    groups = materialize(groups.groupBy(F.col("doc_id").alias(own)).agg(F.max("kept").alias("kept"), F.count("*").alias("rows")), "groups")
    n = groups.agg(F.count_if(~F.col("kept")).alias("dropped"), F.count_if(F.col("kept") & (F.col("rows") > 1)).alias("repeated")).first()
    dropped = groups.filter("NOT kept").select(own)
    kept = nodes.join(F.broadcast(dropped) if n["dropped"] <= BROADCAST_IDS else dropped, F.col(node) == F.col(own), "left_anti")
    if n["repeated"]:
        row = F.struct(*[F.col(c) for c in docs.columns])
        kept = kept.groupBy(node).agg(F.min_by(row, F.to_json(row)).alias(first)).select(f"{first}.*")
    return kept.select(*docs.columns)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, three-word shingles, similarity of 0.85 or more."""
    return near_duplicate_groups(table(spark, sf_dir, "documents"), k=3, percent=85, t=2, m=7)


#: The same groups from all pairs that share a shingle; for small tables.
_ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 2], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), near AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id WHERE 100 * x.n >= 85 * y.n AND 100 * y.n >= 85 * x.n
  GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT near.b, reach.other FROM reach JOIN near ON near.a = reach.doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) LEFT JOIN n USING (doc_id)
"""

QUERIES = {"op3_near_dedup": op3_near_dedup}
ORACLES = {"op3_near_dedup": _ORACLE}
