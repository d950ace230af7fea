"""Vector retrieval for many requests at once: visibility, exact and approximate top-k, neighbours and prompt text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrow import map_batches, runs_of
from ..functions.scratch import new_folder, written

#: Vectors of a block, and blocks of queries that a broadcast may hold: at 1,536 single-precision components 61 MB.
BLOCK_VECTORS, BROADCAST_BLOCKS = 1_000, 10
#: More blocks of queries than that meet the chunks' in a grid: so many blocks of each side in a task, 98 MB at most.
GRID_BLOCKS = 8


def visible_chunks(chunks: DataFrame, sources: DataFrame, user_id: int, mode: str = "gateway") -> DataFrame:
    """Embedded chunks that a user may see: own and shared sources (``gateway``), or own ones only (``voice``)."""
    own = F.col("user_id") == user_id
    allowed = sources.filter(own | F.col("user_id").isNull() if mode == "gateway" else own).select("source_id", "user_id")
    return chunks.filter("embedding IS NOT NULL").join(allowed, "source_id")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column) -> Column:
    return _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b))


_BLOCK = "cell int, ids array<long>, owners array<long>, vectors binary"


def _blocks(df: DataFrame, id_col: str) -> DataFrame:
    """``df(cell, id, user_id, embedding)``, neighbours of one cell together -> a row for each block of vectors of a cell: ids, owners
    and the components, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                for at in range(low, high, BLOCK_VECTORS):
                    part = batch.slice(at, min(BLOCK_VECTORS, high - at))
                    vectors = np.asarray(part.column(3).flatten(), dtype=np.float32)
                    columns = [pa.array([cells[at]], pa.int32()), *[pa.array([x], t) for x, t in ((part.column(1).to_pylist(), pa.list_(pa.int64())), (part.column(2).to_pylist(), pa.list_(pa.int64())), (vectors.tobytes(), pa.binary()))]]
                    yield pa.RecordBatch.from_arrays(columns, names=["cell", "ids", "owners", "vectors"])

    rows = df if "cell" in df.columns else df.withColumn("cell", F.lit(0))
    rows = rows.filter("embedding IS NOT NULL").select(F.col("cell").cast("int"), F.col(id_col).cast("long"), F.col("user_id").cast("long"), F.col("embedding").cast("array<float>"))
    return map_batches(rows, run, _BLOCK)


def _matrix(ids: list, data: bytes) -> np.ndarray:
    """Unit vectors as rows; a null vector has no direction."""
    vectors = np.frombuffer(data, np.float32).astype(np.float64).reshape(len(ids), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


_Best = tuple[np.ndarray, np.ndarray, np.ndarray]


def _best(queries: dict, chunks: dict, k: int, least: float | None, shared: bool) -> _Best:
    """A block of queries against a block of chunks -> places of queries, ids of chunks and scores: the best ``k`` of each
    query, ties by chunk id."""
    names = np.array(chunks["ids"])
    owner = np.array([-1 if u is None else u for u in chunks["owners"]])
    user = np.array([-2 if u is None else u for u in queries["owners"]])
    scores = _matrix(queries["ids"], queries["vectors"]) @ _matrix(chunks["ids"], chunks["vectors"]).T
    seen = ((owner[None, :] == user[:, None]) | (shared & (owner[None, :] == -1))) & ~np.isnan(scores)
    if least is not None:
        seen &= scores > least
    found: list[_Best] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for i in range(len(queries["ids"])):
        at = np.flatnonzero(seen[i])
        if len(at) > k:  # all that tie with the k-th stay until the ids decide
            at = at[scores[i, at] >= np.partition(scores[i, at], len(at) - k)[len(at) - k]]
        at = at[np.lexsort((names[at], -scores[i, at]))][:k]
        found.append((np.full(len(at), i), names[at], scores[i, at]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _merged(parts: list[_Best], k: int) -> _Best:
    """The best ``k`` of each query among the bests of several blocks."""
    query, chunk, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((chunk, -score, query))
    query, chunk, score = query[order], chunk[order], score[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return query[keep], chunk[keep], score[keep]


_SCORED = "query_id long, chunk_id long, similarity double"


def _scored_rows(ids: list, best: _Best) -> pa.RecordBatch:
    query, chunk, score = best
    return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[query]), pa.array(chunk, pa.int64()), pa.array(score)], names=["query_id", "chunk_id", "similarity"])


def _side_by_side(k: int, least: float | None, shared: bool):
    """Rows of a block of chunks with a block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                asked = {x: row[f"q_{x}"] for x in ("ids", "owners", "vectors")}
                yield _scored_rows(asked["ids"], _best(asked, row, k, least, shared))

    return run


def _in_grid(k: int, least: float | None, shared: bool):
    """Places of the grid, each with its blocks of queries and then of chunks -> the best of each query there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs_of(batches, 3):
            side = rows["is_chunk"].to_pylist().index(True) if True in rows["is_chunk"].to_pylist() else rows.num_rows
            for asked in rows.slice(0, side).to_pylist():
                parts = [_best(asked, held, k, least, shared) for held in (rows.slice(i, 1).to_pylist()[0] for i in range(side, rows.num_rows))]
                if parts:
                    yield _scored_rows(asked["ids"], _merged(parts, k))

    return run


def _grid(asked: DataFrame, held: DataFrame, k: int, least: float | None, shared: bool) -> DataFrame:
    """All blocks of queries with all blocks of chunks of their cell, as in the product of two matrices: each side is dealt to groups
    of ``GRID_BLOCKS``, and each pair of groups is a task's work that gives out the best of each query. Both tables are written."""
    groups = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / GRID_BLOCKS).cast("int").alias(name))
    sizes = F.broadcast(groups(asked, "rows").join(groups(held, "columns"), "cell"))  # a row for each cell
    dealt = lambda n: F.pmod(F.xxhash64("ids"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    payload = ["ids", "owners", "vectors"]
    left = asked.join(sizes, "cell").select("cell", dealt("rows").alias("row"), every("columns").alias("column"), F.lit(False).alias("is_chunk"), *payload)
    right = held.join(sizes, "cell").select("cell", every("rows").alias("row"), dealt("columns").alias("column"), F.lit(True).alias("is_chunk"), *payload)
    placed = left.unionByName(right).repartition("cell", "row", "column").sortWithinPartitions("cell", "row", "column", "is_chunk")
    return map_batches(placed, _in_grid(k, least, shared), _SCORED)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "chunk_id"))
    return scored.withColumn("rank", best).filter(F.col("rank") <= k)


def _scored(queries: DataFrame, rows: DataFrame, k: int, least: float | None, shared: bool) -> DataFrame:
    """``rows(chunk_id, user_id, embedding)`` scored by each query, blocks of chunks against blocks of queries. Each block is made once;
    the queries' are counted here, so a Spark job runs when this is called."""
    asked = written(_blocks(queries, "query_id"))
    if asked.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS:
        few = F.broadcast(asked.select(F.col("ids").alias("q_ids"), F.col("owners").alias("q_owners"), F.col("vectors").alias("q_vectors")))
        # Blocks of a stated query set against all rows, without a shuffle.
        return _ranked(map_batches(_blocks(rows, "chunk_id").crossJoin(few), _side_by_side(k, least, shared), _SCORED), k)
    return _ranked(_grid(asked, written(_blocks(rows, "chunk_id")), k, least, shared), k)


def _readable(chunks: DataFrame, sources: DataFrame, source_id: int | None = None) -> DataFrame:
    rows = chunks.filter("embedding IS NOT NULL")
    if source_id is not None:
        rows = rows.filter(F.col("source_id") == source_id)
    return rows.join(sources.select("source_id", "user_id"), "source_id")


def cosine_top_k(queries: DataFrame, chunks: DataFrame, sources: DataFrame, k: int = 10, threshold: float = 0.4) -> DataFrame:
    """For each query the nearest visible chunks with a distance strictly under ``threshold``; ties by chunk id."""
    return _scored(queries, _readable(chunks, sources), max(1, min(50, k)), 1 - threshold, True)


def cosine_top_k_scoped(queries: DataFrame, chunks: DataFrame, sources: DataFrame, source_id: int, k: int = 10) -> DataFrame:
    """The nearest visible chunks of one source, at any distance."""
    return _scored(queries, _readable(chunks, sources, source_id), max(1, min(50, k)), None, True)


def cosine_top_k_soft(queries: DataFrame, chunks: DataFrame, sources: DataFrame, k: int = 10, threshold: float = 0.4, floor: int = 3) -> DataFrame:
    """The top ``k`` of a user's own chunks, then those similar enough; the best ``floor`` where fewer remain, all where none do."""
    top = _scored(queries, _readable(chunks, sources), k, None, False)
    each = W.partitionBy("query_id")
    top = top.withColumn("__good", F.count_if(F.col("similarity") >= threshold).over(each)).withColumn("__n", F.count("*").over(each))
    soft = F.when(F.col("__good") >= floor, F.col("similarity") >= threshold).when(F.col("__n") >= floor, F.col("rank") <= floor).when(F.col("__good") > 0, F.col("similarity") >= threshold).otherwise(F.lit(True))
    return top.filter(soft).drop("__good", "__n")


def build_index(chunks: DataFrame, sources: DataFrame, path: str, cells: int = 50, sample: int = 50_000, parts: int = 16) -> None:
    """Writes the inverted file of all embedded chunks: ``path/centres``, k-means centres of at most ``sample`` unit vectors, and
    ``path/cells``, blocks of every chunk's vector in a folder for each cell. A cell's chunks are dealt to ``parts`` tasks, so a
    large cell isn't one. Null vectors (no direction) are in no cell."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = _readable(chunks, sources).withColumn("__norm", F.sqrt(_dot(F.col("embedding"), F.col("embedding")))).filter("__norm > 0")
    units = rows.orderBy(F.xxhash64("chunk_id")).limit(sample).select(array_to_vector(F.transform("embedding", lambda x: x.cast("double") / F.col("__norm"))).alias("features"))
    spark = chunks.sparkSession
    some = units.limit(1).count() > 0
    centres = [c.tolist() for c in KMeans(k=cells, seed=5, maxIter=10).fit(units).clusterCenters()] if some else []
    spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    near = _nearest(np.array(centres), 1, "chunk_id")
    placed = map_batches(rows.select(F.col("chunk_id").cast("long"), F.col("user_id").cast("long"), F.col("embedding").cast("array<float>")), near, "chunk_id long, user_id long, embedding array<float>, cell int")
    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(parts))
    ordered = placed.repartition("cell", salt).sortWithinPartitions("cell", "chunk_id")
    _blocks(ordered, "chunk_id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")


def _nearest(centres: np.ndarray, n: int, id_name: str):
    """Rows ``(id, user_id, embedding)`` -> one for each of the ``n`` nearest centres of the vector's direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_VECTORS):
                part = batch.slice(at, BLOCK_VECTORS)
                units = _matrix(range(part.num_rows), np.asarray(part.column(2).flatten(), dtype=np.float32).tobytes())
                near = units @ centres.T - (centres**2).sum(axis=1) / 2
                cells = np.argsort(-near, axis=1, kind="stable")[:, :n]
                rows = np.repeat(np.arange(part.num_rows), cells.shape[1])
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells.ravel(), pa.int32())], names=[id_name, "user_id", "embedding", "cell"])

    return run


def search_index(queries: DataFrame, path: str, k: int = 10, threshold: float = 0.4, nprobe: int = 8) -> DataFrame:
    """Approximate ``cosine_top_k`` in a stored index: each query looks into its ``nprobe`` nearest cells. Only the folders of cells that
    some query asks for are read; blocks of a cell's queries meet the blocks of its chunks."""
    spark = queries.sparkSession
    centres = np.array([r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])  # as many rows as cells
    if not len(centres):
        return spark.createDataFrame([], _SCORED + ", rank int")
    rows = queries.filter("embedding IS NOT NULL").select(F.col("query_id").cast("long"), F.col("user_id").cast("long"), F.col("embedding").cast("array<float>"))
    rows = rows.filter(F.exists("embedding", lambda x: x != 0))
    probes = map_batches(rows, _nearest(centres, nprobe, "query_id"), "query_id long, user_id long, embedding array<float>, cell int")
    asked = written(_blocks(probes.repartition("cell").sortWithinPartitions("cell", "query_id"), "query_id"))
    wanted = [r.cell for r in asked.select("cell").distinct().collect()]
    held = spark.read.schema(_BLOCK).parquet(f"{path}/cells").filter(F.col("cell").isin(wanted))
    return _ranked(_grid(asked, held, max(1, min(50, k)), 1 - threshold, True), k)


def ann_top_k(queries: DataFrame, chunks: DataFrame, sources: DataFrame, k: int = 10, threshold: float = 0.4, cells: int = 50, nprobe: int = 8, path: str | None = None) -> DataFrame:
    """``search_index`` in an index that is built first, at ``path`` or in the shared folder."""
    path = path or new_folder(queries.sparkSession) + "/index"
    build_index(chunks, sources, path, cells)
    return search_index(queries, path, k, threshold, nprobe)


def expand_adjacent_chunks(hits: DataFrame, chunks: DataFrame, sources: DataFrame, n: int = 1) -> DataFrame:
    """``hits(query_id, user_id, chunk_id)`` with the visible chunks within ``n`` places of each in its source, each once."""
    own = hits.join(chunks.select("chunk_id", "source_id", "chunk_index"), "chunk_id")
    keys = own.select("query_id", "user_id", "source_id", F.explode(F.sequence(F.col("chunk_index") - n, F.col("chunk_index") + n)).alias("chunk_index")).filter("chunk_index >= 0").distinct()
    allowed = sources.select("source_id", F.col("user_id").alias("owner"))
    near = keys.join(chunks.select("source_id", "chunk_index", "chunk_id"), ["source_id", "chunk_index"]).join(allowed, "source_id").filter(F.col("owner").isNull() | (F.col("owner") == F.col("user_id")))
    both = own.select("query_id", "source_id", "chunk_index", "chunk_id", F.lit(True).alias("hit")).unionByName(near.select("query_id", "source_id", "chunk_index", "chunk_id", F.lit(False).alias("hit")))
    return both.groupBy("query_id", "source_id", "chunk_index", "chunk_id").agg(F.bool_or("hit").alias("hit"))


def prompt_context(hits: DataFrame, max_chars: int = 3000) -> DataFrame:
    """``hits(query_id, rank, source_id, chunk_index, heading, content)`` -> one text for each query: sources by first hit, chunks in order."""
    text = F.trim(F.regexp_replace("content", r"\s+", " "))
    text = F.when(F.length(text) > max_chars, F.concat(F.left(text, F.lit(max_chars)), F.lit("…"))).otherwise(text)
    label = F.concat(F.lit("Chunk "), F.col("chunk_index").cast("string"))
    shown = F.concat(F.lit("["), F.coalesce("heading", label), F.lit("] (source: "), F.col("source_id").cast("string"), F.lit(", "), label, F.lit("): "), text)
    rows = hits.withColumn("__first", F.min("rank").over(W.partitionBy("query_id", "source_id"))).withColumn("__t", shown)
    parts = F.array_sort(F.collect_list(F.struct("__first", "source_id", "chunk_index", "__t")))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["__t"]), "\n\n").alias("context"))


def voice_context(hits: DataFrame, most: int = 5, max_chars: int = 200) -> DataFrame:
    """``hits(query_id, rank, similarity, heading, content)`` -> the short numbered form for spoken answers."""
    name = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("heading", F.lit("Untitled")))
    shown = F.concat(name, F.lit(" (Relevance: "), F.format_number(F.col("similarity") * 100, 1), F.lit("%)\n    "), F.left("content", F.lit(max_chars)), F.lit("\n\n"))
    parts = F.array_sort(F.collect_list(F.struct("rank", shown.alias("t"))))
    return hits.filter(F.col("rank") <= most).groupBy("query_id").agg(F.concat(F.lit("📚 Knowledge Base References:\n\n"), F.array_join(F.transform(parts, lambda p: p["t"]), "")).alias("context"))
