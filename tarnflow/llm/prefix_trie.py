"""Operator 11: the trie of conversation prefixes as flat tables with minimal perfect hashing.

A prefix is named by a 128-bit digest: that of its last turn chained to the digest of the prefix before it. Turns become
digests and word counts before anything is shuffled, so texts never move. Conversations stream past in order; about
``SHARD_TURNS`` of their prefixes, always whole conversations, form a shard. A shard's distinct digests get the slots of a
minimal perfect hash, each slot checked against the digest that it stands for; counts are scattered into flat arrays by
slot. Shards agree on a node by one sum over digests. Each node then returns to the shards that hold it, whose arrays
add up children, leaves and saved tokens through the parents' slots, deepest nodes first; every node counts in one shard
only, that of its smallest conversation, which holds its whole path. What the shards found of a node in several of them is
added up.

So a first turn or conversation of a third of all rows is one row for each shard after the first step, and no task holds
more than a shard: 130 bytes for each distinct prefix in it. A conversation is never cut, so its shard is as large
as it is (ten million turns take about 2 GB).

Defined results: turns are ordered by number, nulls first, then by the digest of their role and text; a null role or text
is empty; repeated turns count as turns; turns without a conversation id are left out; an empty table has no node, not even
the root; further columns are ignored; texts may have any length. Ids below zero take the conversation before the remainder,
so ``-7`` starts like ``0``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import is_small, map_arrow, materialize, table

#: Prefixes of a shard; it ends with the conversation that reaches it.
SHARD_TURNS = 100_000
#: Conversations of a block that share a base, and the most turns that they may take from it.
BLOCK_IDS, MOST_TAKEN = 20, 4
#: Nodes held by several shards that a broadcast may hold: 60 bytes each, 12 MB at most.
BROADCAST_NODES = 200_000
ROOT = hashlib.blake2b(b"root", digest_size=16).digest()
_EMPTY = np.iinfo(np.int64).max


class SlotTable:
    """A minimal perfect hash of distinct 128-bit digests: every digest has a slot of its own below ``len(digests)``.

    Each level throws the digests that are left at twice as many places; those that are alone at theirs stay there, and a
    slot is the rank of a taken place over all levels. A slot's digest is kept, so a digest from elsewhere has none.
    """

    def __init__(self, digests: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # places taken, and the slots before each
        self.digests = np.empty_like(digests)
        left, taken = digests, 0
        while len(left):
            place = self._place(left, len(self.levels), 2 * len(left))
            alone = np.bincount(place, minlength=2 * len(left)) == 1
            self.levels.append((alone, taken + np.cumsum(alone) - alone))
            stays = alone[place]
            self.digests[self.levels[-1][1][place[stays]]] = left[stays]
            taken += int(alone.sum())
            left = left[~stays]
            if len(self.levels) > 200:
                raise ValueError("digests aren't distinct")
        if (self.slots(digests) < 0).any():
            raise ValueError("a digest has no slot of its own")

    @staticmethod
    def _place(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        x = digests[:, level & 1] ^ (digests[:, 1 - (level & 1)] * np.uint64(2 * level + 1))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 where the table doesn't hold it."""
        out = np.full(len(digests), -1, np.int64)
        left = np.arange(len(digests))
        for level, (alone, before) in enumerate(self.levels):
            if not len(left):
                break
            place = self._place(digests[left], level, len(alone))
            here = alone[place]
            at, slot = left[here], before[place[here]]
            same = (self.digests[slot] == digests[at]).all(axis=1)
            out[at[same]] = slot[same]
            left = left[~here]
        return out


def _pairs(data: bytes | bytearray) -> np.ndarray:
    return np.frombuffer(bytes(data), "<u8").reshape(-1, 2)


def _binary(digests: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(digests), [None, pa.py_buffer(digests.tobytes())]).cast(pa.binary())


def _distinct(digests: np.ndarray) -> np.ndarray:
    """The place of one row of each digest."""
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    new = np.r_[True, (digests[order][1:] != digests[order][:-1]).any(axis=1)] if len(order) else np.empty(0, bool)
    return order[new]


class _Shard:
    """Rows of prefixes, 60 bytes each, that become one row for each distinct prefix."""

    def __init__(self) -> None:
        self.digest, self.parent, self.depth, self.words, self.conversation = bytearray(), bytearray(), [], [], []

    def add(self, digest: bytes, parent: bytes, depth: int, words: int, conversation: int) -> None:
        self.digest += digest
        self.parent += parent
        self.depth.append(depth)
        self.words.append(words)
        self.conversation.append(conversation)

    def rows(self, name: int) -> pa.RecordBatch:
        digests, members = _pairs(self.digest), np.array(self.conversation, np.int64)
        one = _distinct(digests)
        slots = SlotTable(digests[one])
        at, of = slots.slots(digests), slots.slots(digests[one])
        n, least = np.zeros(len(one), np.int64), np.full(len(one), _EMPTY)
        np.add.at(n, at, 1)
        np.minimum.at(least, at, members)
        columns = [
            pa.array(np.full(len(one), name)), _binary(digests[one]), _binary(_pairs(self.parent)[one]), pa.array(np.array(self.depth, np.int64)[one]),
            pa.array(np.array(self.words, np.int64)[one]), pa.array(n[of]), pa.array(least[of]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=_WALKED)


_WALKED = ["shard", "digest", "parent", "depth", "words", "n", "conv_id"]
_WALKED_TYPES = "shard long, digest binary, parent binary, depth long, words long, n long, conv_id long"


def _walk(shard_turns: int):
    """Turns ``(block, conv_id, taken, turn, words)`` in order, a block's base first -> the distinct prefixes of each shard, and a
    row without a shard for the end of each conversation. ``turn`` is a digest; a shard is named by its first conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ends, name = _Shard(), _Shard(), None
        block = conversation = None
        base: list[tuple[bytes, int]] = []
        path, depth, position = ROOT, 0, 0

        def follow(turn: bytes, words: int) -> None:
            nonlocal path, depth
            parent, path, depth = path, hashlib.blake2b(path + turn, digest_size=16).digest(), depth + 1
            shard.add(path, parent, depth, words, conversation)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal shard, ends, name
            if conversation is not None:
                ends.add(path, path, depth, 0, conversation)
            if len(shard.depth) >= shard_turns:
                yield from emptied()

        def emptied() -> Iterator[pa.RecordBatch]:
            nonlocal shard, ends, name
            if shard.depth:
                rows = shard.rows(name)
                done = pa.RecordBatch.from_arrays(
                    [pa.nulls(len(ends.depth), pa.int64()), _binary(_pairs(ends.digest)), pa.nulls(len(ends.depth), pa.binary()), pa.array(ends.depth, pa.int64()), pa.nulls(len(ends.depth), pa.int64()), pa.array([0] * len(ends.depth), pa.int64()), pa.array(ends.conversation, pa.int64())],
                    names=_WALKED,
                )
                shard, ends, name = _Shard(), _Shard(), None
                yield rows
                yield done

        for batch in batches:
            for row_block, row_conversation, taken, turn, words in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if row_conversation != conversation:
                    yield from close()
                    if row_block != block:
                        block, base = row_block, []
                    conversation, position, path, depth = row_conversation, 0, ROOT, 0
                    name = conversation if name is None else name
                    shard.add(ROOT, ROOT, 0, 0, conversation)
                    if conversation != block:
                        for held in base[:taken]:
                            follow(*held)
                if conversation == block:
                    if len(base) < MOST_TAKEN:
                        base.append((turn, words))
                    follow(turn, words)
                elif position >= taken:
                    follow(turn, words)
                position += 1
        yield from close()
        yield from emptied()

    return run


def _ends(ends: DataFrame) -> DataFrame:
    """``ends(digest, conv_id)`` -> ``(digest, n_ends, ends_sha256)`` over the ids in order.

    Ids are joined by ranges of 65,536 first; a node's ranges then stream through one digest, as SHA-256 can't be split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, n, held = None, 0, hashlib.sha256()
        for batch in batches:
            done: tuple[list, list, list] = ([], [], [])
            for digest, size, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if digest != node:
                    if node is not None:
                        for column, value in zip(done, (node, n, held.hexdigest()), strict=True):
                            column.append(value)
                    node, n, held = digest, 0, hashlib.sha256()
                held.update(("," if n else "").encode() + ids.encode())
                n += size
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(done, (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["digest", "n_ends", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([n], pa.int64()), pa.array([held.hexdigest()])], names=["digest", "n_ends", "ends_sha256"])

    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    ranges = ends.groupBy("digest", F.shiftright("conv_id", 16).alias("range")).agg(F.count("*").alias("n"), ids.alias("ids"))
    return map_arrow(ranges.repartition("digest").sortWithinPartitions("digest", "range"), run, "digest binary, n_ends long, ends_sha256 string")


_NODE = ["digest", "parent", "depth", "words", "n_convs", "conv_id", "n_ends", "ends_sha256", "owner", "shards"]
_SUMS_TYPES = "digest binary, depth long, parent_conv_id long, n_convs long, conv_id long, ends_sha256 string, shards long, n_children long, n_leaves long, saved_tokens long"


def _accumulate(rows: pa.Table) -> pa.RecordBatch:
    """A shard's nodes with what all shards know of them -> what this shard adds to each. A node's own row fills in its columns
    only where the shard owns it."""
    flat = lambda name: _pairs(b"".join(rows[name].to_pylist()))
    number = lambda name: rows[name].to_numpy().astype(np.int64)
    digests = flat("digest")
    table = SlotTable(digests)
    at = table.slots(digests)
    n = len(digests)
    depth, parent, words, n_convs, conv_id, owned = (np.zeros(n, np.int64) for _ in range(6))
    depth[at], words[at], n_convs[at], conv_id[at], parent[at] = number("depth"), number("words"), number("n_convs"), number("conv_id"), table.slots(flat("parent"))
    owned[at] = number("owner") == number("shard")
    if ((parent < 0) | (depth[parent] != np.maximum(depth - 1, 0))).any():
        raise ValueError("a shard lacks the parent of one of its prefixes")
    children, leaves = np.zeros(n, np.int64), np.zeros(n, np.int64)
    below = (depth > 0) & (owned > 0)
    np.add.at(children, parent[below], 1)
    # A node without children ends in all its conversations; the shard that owns it knows whether any goes on.
    ended = np.zeros(n, np.int64)
    ended[at] = number("n_ends")
    leaves[(owned > 0) & (ended == n_convs)] = 1
    saved = np.where(owned > 0, (n_convs - 1) * words, 0)
    order = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[order], np.arange(int(depth.max()) + 2))
    for d in range(len(bounds) - 2, 0, -1):
        level = order[bounds[d] : bounds[d + 1]]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    above = pa.array(conv_id[parent][at], mask=(depth[at] == 0) | (owned[at] == 0))
    own = lambda values: pa.array(values, mask=owned[at] == 0)
    columns = [
        rows["digest"].combine_chunks(), own(depth[at]), above, own(n_convs[at]), own(conv_id[at]), pa.array(rows["ends_sha256"].to_pylist(), pa.string()),
        pa.array(number("shards")), pa.array(children[at]), pa.array(leaves[at]), pa.array(saved[at]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SUMS_TYPES.split(", ")])


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by shard -> ``_accumulate`` of each."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(shards)) + 1, len(shards)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            if held and shards[a] != name:
                yield _accumulate(pa.Table.from_batches(held))
                held = []
            name = shards[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield _accumulate(pa.Table.from_batches(held))


def conversation_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> a row for each node of the trie of the rebuilt conversations:
    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``."""
    key, role, text = F.col("conv_id").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(32)))
    rows = turns.filter(key.isNotNull()).select(
        (key - key % BLOCK_IDS).alias("block"), key.alias("conv_id"), (F.crc32(key.cast("string")) % 4).alias("taken"), digest.alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.col("turn").cast("long").alias("turn"),
    )
    ordered = rows.repartition("block").sortWithinPartitions("block", F.col("conv_id") != F.col("block"), "conv_id", F.asc_nulls_first("turn"), "digest")
    walked = materialize(map_arrow(ordered.select("block", "conv_id", "taken", "digest", "words"), _walk(shard_turns), _WALKED_TYPES), "walked")
    local = walked.filter("shard IS NOT NULL")
    known = local.select("digest", "parent", "depth", "words", "n", "conv_id", "shard", F.lit(0).cast("long").alias("n_ends"), F.lit(None).cast("string").alias("ends_sha256"))
    ended = _ends(walked.filter("shard IS NULL").select("digest", "conv_id")).select(
        "digest", *[F.lit(None).cast(kind).alias(name) for name, kind in (("parent", "binary"), ("depth", "long"), ("words", "long"), ("n", "long"), ("conv_id", "long"), ("shard", "long"))], "n_ends", "ends_sha256"
    )
    nodes = known.unionByName(ended).groupBy("digest").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("words").alias("words"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("n_ends").alias("n_ends"),
        F.coalesce(F.max("ends_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), F.min_by("shard", "conv_id").alias("owner"), F.count("shard").alias("shards"),
    )
    nodes = materialize(nodes, "nodes")
    shared = nodes.filter("shards > 1")
    small = is_small(shared, BROADCAST_NODES)
    spread = local.select("shard", "digest").join(F.broadcast(shared) if small else shared, "digest").select("shard", *_NODE)
    alone = nodes.filter("shards = 1").select(F.col("owner").alias("shard"), *_NODE)
    dealt = alone.unionByName(spread).repartition("shard").sortWithinPartitions("shard")
    sums = map_arrow(dealt, _by_shard, _SUMS_TYPES)
    whole = sums.filter("shards = 1")
    merged = sums.filter("shards > 1").groupBy("digest").agg(
        *[F.max(c).alias(c) for c in ("depth", "parent_conv_id", "n_convs", "conv_id", "ends_sha256", "shards")], *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    )
    return whole.unionByName(merged).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of its block's."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


_ORACLE = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS i, d, words FROM (
    SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)
), own AS (
  SELECT conv_id, list({'d': d, 'words': words} ORDER BY i) AS l FROM turns GROUP BY 1
), heads AS (
  SELECT *, conv_id - conv_id % 20 AS block, CAST(xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT)),
    lambda c, b: list_reduce(CAST([1, 2, 3, 4, 5, 6, 7, 8] AS UBIGINT[]), lambda s, i: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, xor(c, b)), CAST(4294967295 AS UBIGINT)), 4294967295) % 4 AS INT) AS h FROM own
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.l, [])[1 : a.h], a.l[a.h + 1 :]) AS l FROM heads a LEFT JOIN own b ON b.conv_id = a.block
), paths AS (
  SELECT conv_id, d, array_to_string([x.d for x in l[1 : d]], ',') AS node, CASE WHEN d > 0 THEN array_to_string([x.d for x in l[1 : d - 1]], ',') END AS parent, CASE WHEN d > 0 THEN l[d].words ELSE 0 END AS words, d = len(l) AS ends
  FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT node, d, any_value(parent) AS parent, any_value(words) AS words, count(*) AS n, min(conv_id) AS conv_id, sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM paths GROUP BY node, d
), kids AS (
  SELECT parent, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), whole AS (
  SELECT n.*, coalesce(k.n, 0) AS kids FROM nodes n LEFT JOIN kids k ON k.parent = n.node AND k.d = n.d
), sums AS (
  SELECT a.node, a.d, count_if(w.kids = 0) AS leaves, sum((w.n - 1) * w.words) AS saved FROM whole w JOIN paths p ON p.conv_id = w.conv_id AND p.d <= w.d JOIN whole a ON a.node = p.node AND a.d = p.d GROUP BY ALL
)
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n AS n_convs, w.kids AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, w.ends_sha256
FROM whole w JOIN sums s ON s.node = w.node AND s.d = w.d LEFT JOIN nodes u ON u.node = w.parent AND u.d = w.d - 1
"""

QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLES = {"op11_prefix_trie": _ORACLE}
