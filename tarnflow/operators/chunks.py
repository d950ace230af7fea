"""Chunks from sections: order-dependent packing in one small helper per document, overlap, and whole chunkers.

Packing is greedy with resets, which a running sum can't express; it runs over one row per document, in Arrow batches. The
chunkers read a document's lines and sections in the same pass (``manuals``, ``guides``); classes and overlaps are built-in.
A document stays in its row from its text to its chunks: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrow import map_batches
from . import line_arrays as A
from . import lines as L
from . import manuals
from .guides import INTRODUCTION, chunk_guides, step_segments
from .pieces import Piece

_UNIT = pa.list_(pa.struct([("heading", pa.string()), ("content", pa.string()), ("images", pa.list_(pa.string()))]))
UNITS = "array<struct<heading:string,content:string,images:array<string>>>"


def words(text: str) -> int:
    return len(text.split())


def words13(text: str) -> int:
    return words(text) * 13 // 10


def chars4(text: str) -> int:
    return len(text) // 4


def split_oversized(units: list[Piece], limit: int = 700) -> list[Piece]:
    """Sections over ``limit`` tokens by greedy paragraphs, images with the first; one huge paragraph stays whole."""
    out: list[Piece] = []
    for unit in units:
        if chars4(unit.content) <= limit:
            out.append(unit)
            continue
        held, size, images = [], 0, unit.images
        for part in (p.strip() for p in re.split(r"\n\s*\n", unit.content)):
            if not part:
                continue
            n = chars4(part)
            if held and size + n > limit:
                out.append(Piece(unit.heading, "\n\n".join(held), images))
                held, size, images = [], 0, ()
            held.append(part)
            size += n
        if held:
            out.append(Piece(unit.heading, "\n\n".join(held), images))
    return out


def merge_small(units: list[Piece], least: int = 80) -> list[Piece]:
    """Small chunks join the next with their heading (or if both are tiny or small), else the one before; until stable."""
    merged = _merged_once(units, least)
    while len(merged) < len(units):
        units, merged = merged, _merged_once(merged, least)
    return merged


def _merged_once(units: list[Piece], least: int) -> list[Piece]:
    """A small chunk is carried until the next one is seen; the two become one, or it settles on what stands before."""
    out: list[Piece] = []
    carried: Piece | None = None

    def settle(piece: Piece) -> None:
        if out and (out[-1].heading == piece.heading or chars4(piece.content) < 40):
            out[-1] = out[-1].plus(piece)
        else:
            out.append(piece)

    for unit in units:
        small = chars4(unit.content) < least
        if carried is not None:
            if unit.heading == carried.heading or (small and chars4(carried.content) < 40):
                out.append(carried.plus(unit))
                carried = None
                continue
            settle(carried)
            carried = None
        if small:
            carried = unit
        else:
            out.append(unit)
    if carried is not None:
        settle(carried)
    return out


def sentences(text: str) -> list[str]:
    out = []
    for p in re.split(r"\n\s*\n", text):
        p = p.strip()
        listed = re.search(r"(?m)^\s*(?:[•\-*■●]|\d+\.)\s", p)
        out += [s.strip() for s in (p.split("\n") if listed else re.split(r"(?<=[.!?])\s+(?=[A-Z])", p))]
    return [s for s in out if s]


def pack_sentences(units: list[Piece], limit: int = 600, target: int = 350) -> list[Piece]:
    """Sections over ``limit`` by greedy sentences to ``target``; a new chunk starts with the last two sentences before it."""
    out: list[Piece] = []
    for unit in units:
        if words13(unit.content) <= limit:
            out.append(unit)
            continue
        held: list[str] = []
        size, made = 0, 0
        named = lambda n, heading=unit.heading: heading if not n or heading is None else f"{heading} (continued)"
        for s in sentences(unit.content):
            n = words13(s)
            if held and size + n > target:
                out.append(Piece(named(made), "\n".join(held)))
                made += 1
                held = held[-2:]
                size = sum(map(words13, held))
            held.append(s)
            size += n
        if held:
            out.append(Piece(named(made), "\n".join(held)))
    return out


def merge_small_into_previous(units: list[Piece], least: int = 80, most: int = 600) -> list[Piece]:
    out: list[Piece] = []
    for unit in units:
        if out and words13(unit.content) < least and words13(out[-1].content) + words13(unit.content) <= most:
            out[-1] = out[-1].plus(unit)
        else:
            out.append(unit)
    return out


def combine_small_sections(units: list[Piece], least: int = 180, most: int = 450) -> list[Piece]:
    """A section joins the one before while that is small or both fit, on true counts."""
    out: list[Piece] = []
    for unit in units:
        if out and (words(out[-1].content) < least or words(out[-1].content) + words(unit.content) <= most):
            out[-1] = out[-1].plus(Piece(None, f"{unit.heading + chr(10) if unit.heading else ''}{unit.content}", unit.images))
        else:
            out.append(unit)
    return out


def segment_steps(units: list[Piece], max_chars: int = 1200, max_steps: int = 5) -> list[Piece]:
    """Greedy segments of a guide's introduction (no heading) and steps, limited by characters and by steps."""
    sizes = [(len(content) + len(heading or INTRODUCTION) + 10, heading is not None) for heading, content, _ in units]
    shown = [f"{heading}\n{content}" if heading else content for heading, content, _ in units]
    return [Piece(None, "\n\n".join(shown[i] for i in segment)) for segment in step_segments(sizes, max_chars, max_steps)]


def pack_units(documents: DataFrame, *rules: Callable[[list[Piece]], list[Piece]]) -> DataFrame:
    """``documents(doc_id, units)``, the sections of a document in order, through ``rules`` -> the same with chunks as units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # few documents at once as Python objects
                part = batch.slice(at, 64)
                packed = []
                for units in part.column(1).to_pylist():
                    pieces = [Piece(u["heading"], u["content"], tuple(u["images"] or ())) for u in units]
                    for rule in rules:
                        pieces = rule(pieces)
                    packed.append([{"heading": h, "content": c, "images": list(i)} for h, c, i in pieces])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, _UNIT)], names=["doc_id", "units"])

    return map_batches(documents.select("doc_id", F.col("units").cast(UNITS)), run, f"doc_id {dict(documents.dtypes)['doc_id']}, units {UNITS}")


def pack(sections: DataFrame, *rules: Callable[[list[Piece]], list[Piece]]) -> DataFrame:
    """``sections(doc_id, section_no, heading, content)`` through ``rules`` -> ``(doc_id, chunk_index, heading, content)``."""
    ordered = F.array_sort(F.collect_list(F.struct("section_no", "heading", "content")))
    arrays = sections.groupBy("doc_id").agg(F.transform(ordered, lambda u: _unit(u["heading"], u["content"])).alias("units"))
    out = pack_units(arrays, *rules)
    return out.select("doc_id", F.posexplode("units").alias("chunk_index", "u")).select("doc_id", "chunk_index", "u.heading", "u.content")


def _unit(heading: Column, content: Column, images: Column | None = None) -> Column:
    return F.struct(heading.alias("heading"), content.alias("content"), (F.array().cast("array<string>") if images is None else images).alias("images"))


def paragraph_groups(docs: DataFrame, n: int = 4, text_col: str = "text") -> DataFrame:
    """Every ``n`` paragraphs of a document as an unnamed section."""
    paragraphs = F.filter(F.transform(F.split(text_col, r"\n\s*\n"), T.strip), lambda p: p != "")
    rows = docs.select("doc_id", F.posexplode(paragraphs).alias("i", "p"))
    parts = F.array_sort(F.collect_list(F.struct("i", "p")))
    grouped = rows.groupBy("doc_id", F.floor(F.col("i") / n).cast("int").alias("section_no")).agg(F.array_join(F.transform(parts, lambda x: x["p"]), "\n\n").alias("content"))
    return grouped.select("doc_id", "section_no", F.lit(None).cast("string").alias("heading"), "content")


def _slices(content: Column, most: int = 450, overlap: int = 50, safety: int = 8) -> Column:
    """A text over ``most`` words in windows that overlap."""
    size, step = most - safety, most - safety - overlap
    windows = lambda tokens: F.transform(F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(step)), lambda i: F.array_join(F.slice(tokens, i + 1, size), " "))
    return T.let(T.words(content), lambda tokens: F.when(F.size(tokens) > most, windows(tokens)).otherwise(F.array(content)))


def slice_tokens(sections: DataFrame, most: int = 450, overlap: int = 50, safety: int = 8) -> DataFrame:
    """Sections over ``most`` words in windows that overlap; the heading on the first only. Built-in."""
    out = sections.select("doc_id", "section_no", "heading", F.posexplode(_slices(F.col("content"), most, overlap, safety)).alias("piece_no", "content"))
    return out.withColumn("heading", F.when(F.col("piece_no") == 0, F.col("heading")))


def _overlapped(content: Column, heading: Column, before: Column, head: Column, ratio: float) -> Column:
    """A chunk after the chunk ``before`` it with heading ``head``: its text, heading, and what overlaps."""

    def tailed(n: Column) -> Column:
        def cut(tail: Column) -> Column:
            stop, space = F.locate(". ", tail, 1), F.locate(" ", tail, 1)
            return T.strip(
                F.when((stop > 0) & (stop - 1 < F.floor(F.length(tail) / 2)) & (stop + 1 < F.length(tail)), F.substr(tail, stop + 2))
                .when((space > 1) & (space - 1 < F.floor(F.length(tail) / 3)), F.substr(tail, space + 1)).otherwise(tail)
            )

        usable = F.coalesce((n > 0) & (F.length(before) > n * 4), F.lit(False))
        return F.struct(n.alias("n"), F.when(usable, T.let(F.right(before, n * 4), cut)).otherwise("").alias("text"))

    def built(o: Column) -> Column:
        has = F.coalesce(o["text"] != "", F.lit(False))
        continued = F.when(heading.isNull() & head.isNotNull(), F.concat(F.lit("Continued: "), head)).when(heading == head, F.concat(F.lit("Continued: "), heading)).otherwise(heading)
        return F.struct(
            F.when(has, continued).otherwise(heading).alias("heading"), F.when(has, F.concat(o["text"], F.lit("\n\n"), content)).otherwise(content).alias("content"),
            has.alias("has_overlap"), F.when(has, o["n"]).alias("overlap_tokens"),
        )

    return T.let(T.let(F.floor(F.floor(F.length(before) / 4) * ratio).cast("int"), tailed), built)


def overlap_chunks(chunks: DataFrame, ratio: float = 0.15) -> DataFrame:
    """Each chunk but the first starts with the end of the one before: from a sentence in the first half of the last
    ``ratio`` of its tokens, else from a space in the first third."""
    order = W.partitionBy("doc_id").orderBy("chunk_index")
    rows = chunks.withColumn("__before", F.lag("content").over(order)).withColumn("__head", F.lag("heading").over(order))
    rows = rows.withColumn("__o", _overlapped(F.col("content"), F.col("heading"), F.col("__before"), F.col("__head"), ratio))
    for name in ("heading", "content", "has_overlap", "overlap_tokens"):
        rows = rows.withColumn(name, F.col("__o")[name])
    return rows.withColumn("token_count", T.token_estimate(F.col("content"))).drop("__before", "__head", "__o")


def step_overlap_segments(items: DataFrame) -> DataFrame:
    """``items(doc_id, segment, step, heading, body, title)``: a segment's text repeats the last step of the one before."""
    last = items.filter("step > 0").groupBy("doc_id", "segment").agg(F.max_by(F.struct("step", "heading", "body", "title"), "step").alias("i"))
    carried = last.select("doc_id", (F.col("segment") + 1).alias("segment"), "i.*").join(items.select("doc_id", "segment").distinct(), ["doc_id", "segment"])
    rows = items.select("doc_id", "segment", "step", "heading", "body", "title").unionByName(carried)
    shown = F.concat(F.when(F.col("step") > 0, F.concat(F.lit("Step "), F.col("step").cast("string"), F.lit(": "))).otherwise(""), "heading", F.lit("\n"), "body", F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("step", "heading", shown.alias("shown"))))
    out = rows.groupBy("doc_id", "segment").agg(F.first("title").alias("title"), ordered.alias("o"))
    return out.select(
        "doc_id", "segment", T.strip(F.concat(F.lit("Guide: "), "title", F.lit("\n\n"), F.array_join(F.transform("o", lambda x: x["shown"]), "\n"))).alias("content"),
        F.array_distinct(F.transform(F.filter("o", lambda x: x["step"] > 0), lambda x: x["step"])).alias("step_indices"), F.array_distinct(F.transform("o", lambda x: x["heading"])).alias("headings"),
    )


def light_sections(docs: DataFrame, text_col: str = "raw_content", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, section_no, heading, content)``, a row for each section."""
    found = pieces_of(docs, manuals.light_pieces, text_col=text_col, id_col=id_col)
    return found.select("doc_id", F.col("chunk_index").alias("section_no"), "heading", "content")


_PIECES = {"chunk_index": pa.int32(), "heading": pa.string(), "content": pa.string(), "image_urls": pa.list_(pa.string()), "before": pa.string(), "head": pa.string()}


def pieces_of(docs: DataFrame, read: Callable[[str], list[Piece]], *rules: Callable[[list[Piece]], list[Piece]], text_col: str, id_col: str, with_before: bool = False) -> DataFrame:
    """Texts to pieces and through ``rules``, in one pass: ``(doc_id, chunk_index, heading, content, image_urls, before, head)``; the last
    two are those of the piece before, where ``with_before`` asks for them."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # few documents at once as Python objects
                part = batch.slice(at, 64)
                places, made = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    pieces = read(text)
                    for rule in rules:
                        pieces = rule(pieces)
                    before = [Piece(None, ""), *pieces]
                    made += [(n, p.heading, p.content, list(p.images), before[n].content if with_before and n else None, before[n].heading if with_before else None) for n, p in enumerate(pieces)]
                    places += [i] * len(pieces)
                columns = zip(*made, strict=True) if made else [()] * len(_PIECES)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(places, pa.int64())), *[pa.array(x, t) for x, t in zip(columns, _PIECES.values(), strict=True)]], names=["doc_id", *_PIECES])

    return map_batches(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, chunk_index int, heading string, content string, image_urls array<string>, before string, head string")


def _exploded(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode("units").alias("chunk_index", "u"))


def chunk_documents(docs: DataFrame, mode: str = "light", text_col: str = "raw_content", id_col: str = "doc_id", title_col: str = "title") -> DataFrame:
    """Documents to chunks: cleaning, sections, packing, classes (overlap and image links for ``universal``; steps, their images
    and the document's title, by its text or ``title_col``, for ``guide``).

    A document without text, or of noise only, has no chunks. Nothing is shuffled.
    """
    if mode == "universal":
        packed = pieces_of(docs, manuals.universal_pieces, split_oversized, merge_small, text_col=text_col, id_col=id_col, with_before=True)
        kind = T.content_type(T.content_signals(F.col("content"), F.col("image_urls")), F.col("content"))
        lapped = _overlapped(F.col("content"), F.col("heading"), F.col("before"), F.col("head"), 0.15)
        chunks = packed.select("doc_id", "chunk_index", lapped.alias("o"), kind.alias("content_type"), "image_urls")
        return chunks.select("doc_id", "chunk_index", "o.*", T.token_estimate(F.col("o.content")).alias("token_count"), "content_type", "image_urls")
    if mode == "final":
        sections = docs.select(F.col(id_col).alias("doc_id"), A.final_sections(F.coalesce(F.col(text_col), F.lit(""))).alias("units"))
        units = sections.select("doc_id", F.transform("units", lambda u: _unit(u["heading"], u["content"])).alias("units"))
        sliced = F.flatten(F.transform("units", lambda u: F.transform(_slices(u["content"]), lambda c, i: F.struct(F.when(i == 0, u["heading"]).alias("heading"), c.alias("content")))))
        chunks = _exploded(pack_units(units, combine_small_sections).select("doc_id", sliced.alias("units"))).select("doc_id", "chunk_index", "u.*")
        return chunks.withColumn("token_count", T.token_estimate(F.col("content"), "words")).withColumn("content_type", T.content_type_light(F.col("content")))
    if mode == "guide":
        file_title = F.col(title_col) if title_col in docs.columns else F.lit("Untitled")
        return chunk_guides(docs, F.col(text_col), L.identifier(F.col(text_col), file_title), id_col)
    chunks = pieces_of(docs, manuals.light_pieces, pack_sentences, merge_small_into_previous, text_col=text_col, id_col=id_col).select("doc_id", "chunk_index", "heading", "content")
    return chunks.withColumn("token_count", T.token_estimate(F.col("content"), "words13")).withColumn("content_type", T.content_type_light(F.col("content")))


def chunk_corpus_report(chunks: DataFrame) -> DataFrame:
    narrative = F.col("content_type") == "narrative"
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"), F.round(F.avg("token_count"), 4).alias("avg_tokens"), F.count("heading").alias("with_heading"),
        F.sum(F.length("content")).alias("chars"), F.sum(T.word_count(F.col("content"))).alias("words"), F.count_if(narrative).alias("narrative"), F.count_if(~narrative).alias("other"),
    )


def attach_images_to_chunks(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """``chunks(doc_id, chunk_index, step_indices)`` with the distinct images of their steps, in step and image order."""
    steps = chunks.select("doc_id", "chunk_index", F.posexplode("step_indices").alias("i", "step"))
    found = steps.join(images, ["doc_id", "step"]).groupBy("doc_id", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("i", "image_no", "url"))).alias("o"))
    urls = F.array_distinct(F.transform("o", lambda x: x["url"]))
    return chunks.join(found.select("doc_id", "chunk_index", urls.alias("image_urls")), ["doc_id", "chunk_index"], "left")
