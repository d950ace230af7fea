"""Operator 13: exact similarity join of shingle sets by signature trees.

A leaf is a text's set as a token bitmap (a bit for each shingle, by its hash), a node the OR of its children's bitmaps with the
range of their set sizes. Two trees are traversed together from their roots: a pair of nodes can hold a link only if their
sizes are close enough and the shingles that their texts may share, at most the common bits and those of a text that fell on
bits already set, reach what the smallest texts need. Pairs of leaves that remain are compared on their full sets.

Which trees meet: in a fixed order of all shingles a text's first ``n - ceil(p * n) + 1`` are its prefix, and two texts of
similarity ``p`` or more share a shingle of both prefixes. The order is by hash, with the shingles that are frequent in
prefixes last: what many documents share (a license, a quoted passage) brings nobody together unless it is nearly all of a text.
So the texts that share a shingle of their prefixes are a bucket, and every link lies in a bucket.

Copies form classes first, as in operator 3. Then the buckets of each text's first few shingles are cut to blocks of bounded
size, each with the bucket's smallest text in it, and every block is one tree that is joined with itself. Near copies end
up in one component here. Lastly the buckets of all prefix shingles whose texts lie in different components are joined in
full, a small one as one tree with itself. A large one (many near copies of a text, or texts around one passage) is cut anew by how
its texts differ from a text of theirs, the pivot: linked texts differ in few shingles, so two that don't both resemble the pivot differ
from it in the same way in part, and share a shingle of the prefixes of these differences, in which what the pivot holds comes last. These
buckets are small unless very many texts differ alike; one that stays large is cut again, and where that doesn't help, texts outside its
largest component meet all its texts, within neighbouring size classes, a block of ones with a block of the others in each task. Here the trees are traversed twice: first
on the signatures alone, about a bit for each shingle, and then, with the whole texts, for those members of a block that
the signatures left a partner; blocks that share such members become one where it isn't too large. Buckets and blocks of the same texts are joined once. A task gives out no more members than its block
has, no more links than it takes to join what it found, and holds two blocks.

Defined results: a null or wordless text has an empty set, ``n_shingles`` 0 and is its own component; rows that repeat a doc_id
each give a row and count as one node; a null doc_id joins no group (component null); an empty table gives an empty result;
further columns are ignored; texts may have any length (a text above a block's bytes is a block of its own). Classes of equal
sets are told apart by 128-bit prints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blocks, is_small, map_arrow, materialize, table
from .components import connected_components
from .near_dedup import BROADCAST_IDS, BROADCAST_PLACES, HUB_MEMBERS, PRINTS, near_duplicate_groups
from .shingles import mix, shingle_sets

#: Texts and bytes of text of a block; a task holds two.
BLOCK_MEMBERS, BLOCK_TEXT = 256, 8_000_000
#: Children of a node.
FANOUT = 8
#: The first shingles of a text by which near copies are joined before all its prefix is.
FIRST = 3
#: A shingle in more prefixes than this is frequent; at most so many of the most frequent go last (8 bytes each). Any order is
#: right: beyond this bound, frequent shingles make larger buckets.
FREQUENT, MOST_FREQUENT = 32, 200_000
#: Fewer than so many shingles by which most texts differ from a pivot go last among those that it doesn't hold.
MOST_COMMON = 256


def prefix_length(n: int, percent: int) -> int:
    return n + percent * n // -100 + 1 if n else 0


def prefixes(sets: list[np.ndarray], percent: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of each set, one after another, and their offsets. ``frequent`` is sorted."""
    out, lengths = [], []
    for s in sets:
        length = prefix_length(len(s), percent)
        if len(frequent) and length:
            late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
            s = np.r_[s[~late], s[late]]
        out.append(s[:length])
        lengths.append(length)
    flat = np.concatenate(out) if out else np.empty(0, np.uint64)
    return flat.view(np.int64), np.r_[0, np.cumsum(lengths, dtype=np.int64)].astype(np.int32)


_NUMBERS = ["n_shingles", "print_a", "print_b"]


def _numbers(sets: list[np.ndarray]) -> list[pa.Array]:
    """Sizes of sets, and the two prints that tell unequal ones apart."""
    sums = [mix(s).sum(dtype=np.uint64) for s in sets]
    xors = [np.bitwise_xor.reduce(mix(s + np.uint64(77))) if len(s) else 0 for s in sets]
    return [pa.array([len(s) for s in sets], pa.int64()), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sums, xors)]]


def _signatures(k: int, percent: int, frequent=None):
    """Texts -> sizes and prints of their sets, their prefixes as ``keys`` and bitmaps as ``bands``. The order is that of hashes, with
    ``frequent`` shingles (a Spark broadcast) last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in blocks(batch.column(1).to_pylist()):
                sets = shingle_sets(texts, k)
                flat, offsets = prefixes(sets, percent, np.empty(0, np.uint64) if frequent is None else frequent.value)
                bitmaps = pa.array([signature(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
                columns = [batch.column(0).slice(at, len(texts)), *_numbers(sets), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), bitmaps]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *_NUMBERS, "n_bytes", "keys", "bands"])
                at += len(texts)

    return run


_SIGNED = "doc_id long, n_shingles long, print_a long, print_b long, n_bytes long, keys array<long>, bands array<long>"


def signature(s: np.ndarray) -> np.ndarray:
    """The bitmap of a set: a power of two of bits, at least 64 and at least one for each shingle."""
    bits = 1 << max(6, (len(s) - 1).bit_length())
    held = np.zeros(bits, bool)
    held[(mix(s) % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(held, bitorder="little").view(np.uint64)


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set in fewer bits, or rows of such."""
    return np.bitwise_or.reduce(bitmap.reshape(*bitmap.shape[:-1], -1, words), axis=-2)


class SignatureTree:
    """Bitmaps of one width as leaves, in the order of their sizes, then of their first words, and the levels up to one root."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray, components: np.ndarray) -> None:
        order = np.lexsort((bitmaps[:, 0], sizes // max(1, int(sizes.max()) // 8)))
        bitmap, size, own, self.of = bitmaps[order], sizes[order], components[order], order
        spare = size - np.bitwise_count(bitmap).sum(axis=1, dtype=np.int64)  # shingles on a bit that another has set
        #: From the leaves up: bitmaps, smallest and largest sets, most shingles to spare, a component and whether there are others.
        self.levels = [(bitmap, size, size, spare, own, np.zeros(len(sizes), bool))]
        while len(self.levels[-1][0]) > 1:
            bitmap, low, high, spare, own, several = self.levels[-1]
            at = np.arange(0, len(bitmap), FANOUT)
            some = np.logical_or.reduceat(several, at) | (np.maximum.reduceat(own, at) != np.minimum.reduceat(own, at))
            self.levels.append((np.bitwise_or.reduceat(bitmap, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at), own[at], some))


def _possible(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether a node ``i`` of the level ``a`` and ``j`` of ``b`` may hold a link between different components."""
    low, high = np.maximum(a[1][i], b[1][j]), np.minimum(a[2][i], b[2][j])
    keep = (100 * high >= percent * low) & (a[5][i] | b[5][j] | (a[4][i] != b[4][j]))
    at = np.flatnonzero(keep)
    for part in np.array_split(at, max(1, len(at) * a[0].shape[1] // 1_000_000)):
        x, y = i[part], j[part]
        most = np.bitwise_count(a[0][x] & b[0][y]).sum(axis=1, dtype=np.int64) + np.minimum(a[3][x], b[3][y])
        keep[part] = (100 + percent) * most >= percent * (a[1][x] + b[1][y])
    return keep


def dual_traversal(a: SignatureTree, b: SignatureTree, percent: int) -> Iterator[tuple[int, int]]:
    """Leaves of ``a`` and of ``b`` (of the same tree: each pair once) that no bound rules out, by their places in the input."""
    up_a, up_b = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        keep = _possible(a.levels[up_a], i, b.levels[up_b], j, percent)
        i, j = i[keep], j[keep]
        if not len(i) or not (up_a or up_b):
            break
        # The deeper tree goes down first; trees of one height go down together.
        down_a, down_b = up_a >= up_b, up_b >= up_a
        if down_a:
            up_a -= 1
            i = (i[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            j = np.repeat(j, FANOUT)
            real = i < len(a.levels[up_a][0])
            i, j = i[real], j[real]
        if down_b:
            up_b -= 1
            j = (j[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            i = np.repeat(i, FANOUT)
            real = j < len(b.levels[up_b][0])
            i, j = i[real], j[real]
        if a is b:
            once = i <= j
            i, j = i[once], j[once]
    if a is b:
        i, j = i[i != j], j[i != j]
    yield from zip(a.of[i].tolist(), b.of[j].tolist(), strict=True)


def candidates(sizes: list[int], bitmaps: list[np.ndarray], component: list[int], is_open: list[bool], percent: int) -> Iterator[tuple[int, int]]:
    """Places of members of a block that may be linked, in different components: open ones with one another where all are open,
    else open ones with the others. Members of one width of bitmap make a tree; wider ones are folded to meet it."""
    size, own, width = np.array(sizes, np.int64), np.array(component, np.int64), np.array([len(x) for x in bitmaps])
    full = size > 0  # an id may stand on an empty text too
    alone = all(is_open)
    left, right = full & np.array(is_open), full & (np.array(is_open) if alone else ~np.array(is_open))
    reach = 100 / percent

    def tree(members: np.ndarray, words: int) -> SignatureTree:
        return SignatureTree(size[members], np.stack([folded(bitmaps[x], words) for x in members]), own[members])

    widths = np.unique(width).tolist()
    for w in widths:
        for v in widths:
            if v > 2 * reach * w or w > 2 * reach * v or (alone and v < w):
                continue
            a, b = np.flatnonzero(left & (width == w)), np.flatnonzero(right & (width == v))
            if not len(a) or not len(b):
                continue
            one = tree(a, min(w, v))
            other = one if alone and v == w else tree(b, min(w, v))
            for i, j in dual_traversal(one, other, percent):
                yield int(a[i]), int(b[j])


def join_blocks(doc_id: list[int], component: list[int], is_open: list[bool], texts: list[bytes], k: int, percent: int) -> list[tuple[int, int]]:
    """Links of a block on full sets, as few as join what was found."""
    sets = [s for part in blocks(texts) for s in shingle_sets(part, k)]
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.setdefault(c, c) != c:
            parent[c] = c = parent[parent[c]]
        return c

    links = []
    for p, q in candidates([len(s) for s in sets], [signature(s) for s in sets], component, is_open, percent):
        x, y = root(component[p]), root(component[q])
        if x == y:
            continue
        both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
        if 100 * both >= percent * (len(sets[p]) + len(sets[q]) - both):
            parent[max(x, y)] = min(x, y)
            links.append((doc_id[p], doc_id[q]))
    return links


def _by_block(batches: Iterator[pa.RecordBatch], values: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows ordered by block, their key and then ``values`` columns -> each block's key and rows."""
    place, held = None, []
    for batch in batches:
        columns = [[x.values.to_numpy() for x in c] if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
        for own, row in zip(zip(*columns[:-values], strict=True), zip(*columns[-values:], strict=True), strict=True):
            if own != place:
                if held:
                    yield place, held
                place, held = own, []
            held.append(row)
    if held:
        yield place, held


def _linked(k: int, percent: int):
    """Rows ``(block..., doc_id, component, open, text)`` ordered by block -> the links of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_block(batches, 4):
            links = join_blocks(*[list(x) for x in zip(*rows, strict=True)], k, percent) if len(rows) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[side] for x in links], pa.int64()) for side in (0, 1)], names=["a", "b"])

    return run


_PLACE = {"key": pa.int64(), "cell": pa.int32(), "column": pa.int32(), "row": pa.int32(), "doc_id": pa.int64(), "component": pa.int64(), "open": pa.bool_()}
_PLACE_TYPES = "key long, cell int, column int, row int, doc_id long, component long, open boolean"


def _with_partners(percent: int):
    """Rows ``(block..., doc_id, component, open, n_shingles, bitmap)`` ordered by block -> the members that their signatures leave a
    partner in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def found_so_far() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), _PLACE.values(), strict=True)], names=list(_PLACE))

        for key, rows in _by_block(batches, 5):
            if len(rows) > 1:
                doc_id, component, is_open, sizes, words = zip(*rows, strict=True)
                bitmaps = [x.view(np.uint64) for x in words]
                found = sorted({x for pair in candidates(sizes, bitmaps, component, is_open, percent) for x in pair})
                held += [(*key, doc_id[x], component[x], is_open[x]) for x in found]
            if len(held) > 10_000:
                yield found_so_far()
                held = []
        if held:
            yield found_so_far()

    return run


def difference_prefixes(n: int, pivot: int, differ: int, percent: int) -> tuple[int, int]:
    """Two lengths of the prefix of ``differ`` shingles by which a set of ``n`` differs from a pivot's: against sets that aren't linked
    with the pivot (of a set that is linked, it is enough against these only), and of a set that isn't, against those that are.

    Linked sets ``A`` and ``B`` differ in at most ``r * (|A| + |B|)`` shingles, ``r = (1 - p) / (1 + p)``, in no more than
    ``(1 - p) / p * |A|``. If their differences ``a`` and ``b`` from the pivot ``C`` share ``t`` shingles, ``|a| + |b| - 2 * t`` is
    where they differ, and ``b`` is above ``r * (|B| + |C|)`` if ``B`` isn't linked with ``C``.
    """
    most = n * (100 - percent) // percent
    shared = -(-(differ + 1 + (pivot - n) * (100 - percent) // (100 + percent)) // 2)
    long = differ - max(1, differ - most) + 1 if differ else 0
    return min(long, differ - max(1, shared) + 1), long


_AROUND = {"pivot": pa.int64(), "home": pa.int64(), "doc_id": pa.int64(), "component": pa.int64(), "n_shingles": pa.int64(), "n_bytes": pa.int64(), "linked": pa.bool_(), "half": pa.int32(), "long": pa.int32(), "added": pa.list_(pa.int64()), "lacked": pa.list_(pa.int64())}
_AROUND_TYPES = "pivot long, home long, doc_id long, component long, n_shingles long, n_bytes long, linked boolean, half int, long int, added array<long>, lacked array<long>"


def _differences(k: int, percent: int):
    """Rows ``(pivot, home, block, doc_id, component, text)`` in that order, a pivot's own with a null ``doc_id`` first -> whether each text is
    linked with its pivot, and the first of the shingles that only it or only the pivot holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, hub = None, np.empty(0, np.uint64)
        for batch in batches:
            rows = list(zip(*[c.to_pylist() for c in batch.columns[:5]], strict=True))
            at = 0
            for texts in blocks(batch.column(5).to_pylist()):
                out = []
                for (pivot, home, block, doc_id, component), text, own in zip(rows[at : at + len(texts)], texts, shingle_sets(texts, k), strict=True):
                    if (pivot, block) != place:
                        place, hub = (pivot, block), np.empty(0, np.uint64)
                    if doc_id is None:
                        # Of an id's several texts the same one in all blocks.
                        hub = max(hub, own, key=lambda s: (len(s), s.tobytes()))
                    elif len(own):
                        added, lacked = np.setdiff1d(own, hub, assume_unique=True), np.setdiff1d(hub, own, assume_unique=True)
                        both = len(own) - len(added)
                        half, long = difference_prefixes(len(own), len(hub), len(added) + len(lacked), percent)
                        linked = 100 * both >= percent * (len(own) + len(hub) - both)
                        out.append((pivot, home, doc_id, component, len(own), len(text), linked, half, long, added[: long + MOST_COMMON].view(np.int64), lacked[:long].view(np.int64)))
                at += len(texts)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _AROUND.values(), strict=True)], names=list(_AROUND))

    return run


def _around_pivots(large: DataFrame, texts: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Large buckets ``(key, doc_id, component, ...)`` -> buckets of the same columns as ``_dealt`` takes, with ``side``, which hold all
    their links between different components but those with pivots, and these links. Buckets of one pivot count as one, each of its
    members once. A pivot may be any text; the one that most of the buckets hold is near the middle."""
    often = large.groupBy("doc_id").agg(F.count("*").alias("often"))
    pivots = large.join(often, "doc_id").groupBy("key").agg(F.max_by(F.struct("doc_id", "component"), F.struct("often", -F.col("doc_id"))).alias("p"))
    pivots = materialize(pivots.select("key", F.col("p.doc_id").alias("pivot"), F.col("p.component").alias("home")), "pivots")
    # A text's component may differ between buckets that were cut anew; then links found there make one of them.
    members = large.select("key", "doc_id", "component").join(F.broadcast(pivots) if is_small(pivots, BROADCAST_PLACES) else pivots, "key")
    members = members.groupBy("pivot", "doc_id").agg(F.min("home").alias("home"), F.min("component").alias("component"))
    members = materialize(members, "members")
    sizes = members.groupBy("pivot").agg(F.min("home").alias("home"), F.ceil(F.count("*") / HUB_MEMBERS).cast("int").alias("parts"))
    sizes = materialize(sizes, "sizes")
    block = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("block")
    others = members.drop("home").join(F.broadcast(sizes) if is_small(sizes, BROADCAST_PLACES) else sizes, "pivot")
    own = sizes.select("pivot", "home", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), F.lit(None).cast("long").alias("member"), F.col("home").alias("component"), F.col("pivot").alias("doc_id"))
    placed = materialize(others.select("pivot", "home", block, F.col("doc_id").alias("member"), "component", "doc_id").unionByName(own), "placed")
    whole = texts.join(F.broadcast(placed) if placed.count() <= BROADCAST_PLACES else placed, "doc_id").select("pivot", "home", "block", "member", "component", "text")
    ordered = whole.repartition("pivot", "block").sortWithinPartitions("pivot", "block", F.asc_nulls_first("member"))
    around = materialize(map_arrow(ordered, _differences(k, percent), _AROUND_TYPES), "around")
    links = around.filter("linked AND component <> home").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b"))
    total = around.groupBy("pivot").agg(F.sum(F.least("long", F.size("added"))).alias("total"))
    common = around.select("pivot", F.explode(F.slice("added", F.lit(1), F.col("long"))).alias("shingle")).groupBy("pivot", "shingle").count().filter(F.col("count") > FREQUENT)
    common = common.join(total, "pivot").filter(F.col("count") * MOST_COMMON > F.col("total"))
    common = materialize(common.groupBy("pivot").agg(F.collect_list("shingle").alias("common")), "common")
    none = F.array().cast("array<long>")
    around = around.join(F.broadcast(common) if is_small(common, BROADCAST_PLACES // MOST_COMMON) else common, "pivot", "left").withColumn("common", F.coalesce("common", none))
    prefix = F.concat(F.array_except("added", "common"), F.array_intersect("added", "common"), "lacked")
    around = around.withColumn("component", F.when(F.col("linked"), F.col("home")).otherwise(F.col("component")))
    # Linked ones are one component with the pivot: the others meet one another, and those of other components meet the linked.
    side = F.when(F.lit(False), F.lit(True))
    apart = around.filter("NOT linked").select(F.lit(1).alias("kind"), side.alias("side"), "pivot", F.slice(prefix, F.lit(1), F.col("half")).alias("prefix"), *_OPEN[1:])
    length = F.when(F.col("linked"), F.col("half")).otherwise(F.col("long"))
    beside = around.filter("linked OR component <> home").select(F.lit(2).alias("kind"), F.col("linked").alias("side"), "pivot", F.slice(prefix, F.lit(1), length).alias("prefix"), *_OPEN[1:])
    finer = apart.unionByName(beside).withColumn("shingle", F.explode("prefix")).withColumn("key", F.xxhash64("kind", "pivot", "shingle"))
    return materialize(finer.select(*_OPEN, "side"), "finer"), links


def _in_order(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, "doc_id", "open")


def _join(placed: DataFrame, texts: DataFrame, keys: list[str], k: int, percent: int) -> DataFrame:
    """``placed(*keys, doc_id, component, open)``, written, with their texts, a block to a place -> links ``(a, b)``."""
    whole = texts.join(F.broadcast(placed) if placed.count() <= BROADCAST_PLACES else placed, "doc_id").select(*keys, "doc_id", "component", "open", "text")
    return materialize(map_arrow(_in_order(whole, keys), _linked(k, percent), "a long, b long").distinct(), "links")


def _parts(n, size):
    return F.ceil(F.greatest(n / BLOCK_MEMBERS, size / BLOCK_TEXT, F.lit(1.0))).cast("int")


def _same_texts_once(buckets: DataFrame, *order: str) -> DataFrame:
    """One of the buckets ``(key, n, sum, xor, ...)`` that hold the same texts: equal sums of two hashes and equal numbers."""
    first = F.min_by(F.struct(*buckets.columns), F.struct(*order))
    return buckets.groupBy("n", "sum", "xor").agg(first.alias("b")).select("b.*")


def _print(*columns: str) -> list:
    own = lambda seed: F.xxhash64(*columns, F.lit(seed))
    return [F.sum(own(1) % (1 << 30)).alias("sum"), F.bit_xor(own(2)).alias("xor")]


def _blocks_once(placed: DataFrame, keys: list[str]) -> DataFrame:
    """The members of one of the blocks that hold the same texts in the same parts; blocks of a single member go."""
    groups = placed.groupBy(*keys).agg(F.count("*").alias("n"), *_print("doc_id", "open")).filter("n > 1")
    one = materialize(_same_texts_once(groups, *keys).select(*keys), "blocks")
    return placed.join(F.broadcast(one) if is_small(one, BROADCAST_PLACES) else one, keys, "left_semi")


def _first_links(docs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links inside blocks of the buckets of each text's first shingles; a bucket's smallest id is in all its blocks."""
    rows = docs.select(F.explode(F.slice("keys", 1, FIRST)).alias("key"), "doc_id", "n_bytes")
    buckets = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("hub"), F.sum("n_bytes").alias("size"), *_print("doc_id")).filter("n > 1")
    buckets = materialize(_same_texts_once(buckets, "key").select("key", "hub", _parts(F.col("n"), F.col("size")).alias("parts")), "buckets")
    members = rows.join(F.broadcast(buckets) if is_small(buckets, BROADCAST_PLACES) else buckets, "key").select("key", "parts", "hub", "doc_id")
    alone = members.filter("doc_id <> hub").select("key", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("block"), "doc_id")
    hubs = buckets.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), F.col("hub").alias("doc_id"))
    placed = alone.unionByName(hubs).withColumn("component", F.col("doc_id")).withColumn("open", F.lit(True))
    return _join(materialize(placed, "placed"), texts, ["key", "block"], k, percent)


_OPEN = ["key", "doc_id", "component", "n_shingles", "n_bytes"]


def _dealt(own: DataFrame) -> DataFrame:
    """``own``, written, with the largest component of each bucket, whether it is ``small`` and whether it must be cut ``again``; without buckets of one
    component and those that hold the texts of another. Where rows have a ``side``, only those of different sides are to meet: a large bucket
    takes rows in proportion unless both of its sides are large."""
    each = own.groupBy("key", "component", "side").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("size"), *_print("doc_id", "side"))
    both = [F.sum(F.when(F.col("side") == side, F.col(c))).alias(f"{c}_{name}") for side, name in ((True, "a"), (False, "b")) for c in ("n", "size")]
    total = [F.sum("n").alias("n"), F.sum("size").alias("size"), F.sum("sum").alias("sum"), F.bit_xor("xor").alias("xor"), *both]
    buckets = each.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.min("component").alias("low"), F.max("component").alias("high"), F.count("side").alias("sided"), *total)
    buckets = buckets.filter("low < high AND (sided = 0 OR n_a > 0 AND n_b > 0)")
    small, cheap = _parts(F.col("n"), F.col("size")) == 1, (F.col("sided") > 0) & (F.least(_parts(F.col("n_a"), F.col("size_a")), _parts(F.col("n_b"), F.col("size_b"))) == 1)
    buckets = _same_texts_once(buckets, "key").select("key", "main", small.alias("small"), (~small & ~cheap).alias("again"))
    return materialize(own.join(buckets, "key").select(*_OPEN, "side", "main", "small", "again"), "dealt")


def _open_links(docs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between different components of ``docs(doc_id, n_shingles, n_bytes, keys, bands, component)`` in the buckets of
    all their prefixes: complete."""
    rows = docs.select(F.explode("keys").alias("key"), "doc_id", "component")
    mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    mixed = materialize(mixed, "mixed")
    own = docs.select(F.explode("keys").alias("key"), "doc_id", "component", "n_shingles", "n_bytes").join(F.broadcast(mixed) if is_small(mixed, BROADCAST_IDS) else mixed, "key")
    own = materialize(own, "open")
    dealt, links = _dealt(own.withColumn("side", F.lit(None).cast("boolean"))), []
    n_again = dealt.filter("again").count()
    while n_again:
        finer, found = _around_pivots(dealt.filter("again"), texts, k, percent)
        links.append(found)
        finer = _dealt(finer)
        dealt, before, n_again = dealt.filter("NOT again").unionByName(finer), n_again, finer.filter("again").count()
        if 2 * n_again > before:
            break
    small, large = dealt.filter("small"), dealt.filter("NOT small")
    # Linked sets lie in the same or neighbouring classes of sizes; a little more than the ratio keeps rounding out.
    size_class = F.floor(F.log("n_shingles") / (1.0001 * math.log(100 / percent))).cast("int")
    keys = ["key", "cell", "column", "row"]
    zero = F.lit(0)
    whole = small.select("key", F.lit(-1).alias("cell"), zero.alias("column"), zero.alias("row"), "doc_id", "component", "n_shingles", F.coalesce("side", F.lit(True)).alias("open"))
    large = large.withColumn("cell", size_class)
    opened = large.filter("coalesce(side, component <> main)").withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    large = large.filter("side IS NULL OR NOT side")
    count = lambda df, name: df.groupBy("key", "cell").agg(_parts(F.count("*"), F.sum("n_bytes")).alias(name))
    cells = materialize(count(large, "parts").join(count(opened, "open_parts"), ["key", "cell"]), "cells")
    block = lambda n, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    as_all = large.join(cells, ["key", "cell"]).select("key", "cell", block("parts", 3).alias("column"), every("open_parts").alias("row"), "doc_id", "component", "n_shingles", F.lit(False).alias("open"))
    as_open = opened.join(cells, ["key", "cell"]).select("key", "cell", every("parts").alias("column"), block("open_parts", 4).alias("row"), "doc_id", "component", "n_shingles", F.lit(True).alias("open"))
    # Before signatures move: a member whose neighbours by size in its block are too far from it has no partner there.
    by_size = W.partitionBy(*keys).orderBy("n_shingles")
    near = (100 * F.lag("n_shingles").over(by_size) >= percent * F.col("n_shingles")) | (100 * F.col("n_shingles") >= percent * F.lead("n_shingles").over(by_size))
    placed = whole.unionByName(as_all).unionByName(as_open).withColumn("near", F.coalesce(near, F.lit(False))).filter("near")
    placed = _blocks_once(materialize(placed.select(*_PLACE), "near"), keys)
    placed = materialize(placed.select(*_PLACE), "placed")
    signed = docs.select("doc_id", "n_shingles", "bands").join(F.broadcast(placed) if placed.count() <= BROADCAST_PLACES else placed, "doc_id")
    ordered = _in_order(signed.select(*_PLACE, "n_shingles", "bands"), keys)
    left = materialize(map_arrow(ordered, _with_partners(percent), _PLACE_TYPES), "partners")
    out = _join(_clustered(left, docs, keys), texts, keys, k, percent)
    for found in links:
        out = out.unionByName(found)
    return materialize(out, "links") if links else out


def _clustered(left: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """The same members with as few texts as hold all their pairs: texts that blocks hold together, one way or another, become one
    block of their own where that isn't too large, so that near texts that share many shingles move once. Other blocks stay."""
    star = left.select(F.min("doc_id").over(W.partitionBy(*keys)).alias("a"), F.col("doc_id").alias("b")).filter("a < b").distinct()
    clusters = connected_components(materialize(star, "star")).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    clusters = materialize(clusters, "clusters")
    known = docs.select("doc_id", "component", "n_bytes").join(F.broadcast(clusters) if is_small(clusters, BROADCAST_PLACES) else clusters, "doc_id")
    sizes = known.groupBy("cluster").agg((_parts(F.count("*"), F.sum("n_bytes")) == 1).alias("small"))
    known = materialize(known.join(sizes, "cluster").select("doc_id", "component", "cluster", "small"), "known")
    zero = F.lit(0)
    whole = known.filter("small").select(F.col("cluster").alias("key"), F.lit(-2).alias("cell"), zero.alias("column"), zero.alias("row"), "doc_id", "component", F.lit(True).alias("open"))
    large = known.filter("NOT small").select("doc_id").distinct()
    rest = _blocks_once(left.join(F.broadcast(large) if is_small(large, BROADCAST_PLACES) else large, "doc_id", "left_semi").select(*_PLACE), keys)
    return materialize(whole.unionByName(rest.select(*_PLACE)), "placed")


def find_components(banded: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame | None:
    """``(node, component)`` of the class representatives with links; None if there are none.

    ``banded(doc_id, *PRINTS, n_bytes, keys, bands)`` has a row for each representative.
    """
    docs = materialize(banded.select("doc_id", *PRINTS, "n_bytes", "keys", "bands"), "banded")
    counts = docs.select(F.explode("keys").alias("key")).groupBy("key").count().filter(F.col("count") > FREQUENT)
    top = materialize(counts.orderBy(F.desc("count"), "key").limit(MOST_FREQUENT).select("key"), "frequent")
    frequent = np.sort(np.array([r.key for r in top.collect()], np.int64).view(np.uint64))  # at most MOST_FREQUENT numbers
    if len(frequent):
        late = banded.sparkSession.sparkContext.broadcast(frequent)
        touched = materialize(docs.select(F.explode("keys").alias("key"), "doc_id").join(F.broadcast(top), "key").select("doc_id").distinct(), "touched")
        ids = F.broadcast(touched) if is_small(touched, BROADCAST_IDS) else touched
        again = map_arrow(texts.join(ids, "doc_id", "left_semi").select("doc_id", "text"), _signatures(k, percent, late), _SIGNED)
        docs = docs.join(ids, "doc_id", "left_anti").unionByName(again.filter("n_shingles > 0").dropDuplicates(["doc_id", *PRINTS]))
    docs = materialize(docs.select("doc_id", "n_shingles", "n_bytes", "keys", "bands"), "prefixes")
    links = _first_links(docs, texts, k, percent)
    found = connected_components(links) if links.count() else None
    if found is None:
        known = docs.withColumn("component", F.col("doc_id"))
    else:
        known = docs.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    more = _open_links(known, texts, k, percent)
    if not more.count():
        return found
    return connected_components(more if found is None else materialize(more.union(found.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))), "links"))


def similar_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` -> ``(doc_id, n_shingles, component_id)`` with a row for each input row: every pair of sets with
    ``100 * intersection >= percent * union`` is linked, none is missed."""
    out = near_duplicate_groups(docs, k, percent, id_col=id_col, text_col=text_col, sign=_signatures(k, percent), find=find_components)
    return out.select("doc_id", "n_shingles", "component_id")


def op13_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, three-word shingles, similarity of 0.9 or more."""
    return similar_groups(table(spark, sf_dir, "documents"), k=3, percent=90)


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
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id WHERE 100 * x.n >= 90 * y.n AND 100 * y.n >= 90 * x.n
  GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT near.b, reach.other FROM reach JOIN near ON near.a = reach.doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) LEFT JOIN n USING (doc_id)
"""

QUERIES = {"op13_signature_tree": op13_signature_tree}
ORACLES = {"op13_signature_tree": _ORACLE}
