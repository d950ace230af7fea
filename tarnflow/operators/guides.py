"""Repair guides to chunks, each guide in its row: steps, greedy segments that overlap by a step, images and the document's title.

One pass in Arrow batches with compiled patterns; nothing is shuffled. The patterns are fixed values of the format.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_batches
from ..functions.text import LINK_OF_THREE

STEP_NUMBER = re.compile(r"(\d+)\.\s*(.*)")
UNNAMED_STEP = re.compile(r"(?i)^step\s*\d+$")
BULLET = re.compile(r"^[-*•]\s*")
IMAGE = re.compile(r"!\[(.*?)\]\((.*?)\)")
COMMENT_LINK = re.compile(r"https?://[^\s>]+")
THREE_PARTS = re.compile(LINK_OF_THREE)


class Item(NamedTuple):
    """The introduction (step 0) or a step, with the heading that is shown."""

    step: int
    heading: str
    body: str

    @property
    def shown(self) -> str:
        return f"{f'Step {self.step}: ' if self.step_like else ''}{self.heading}\n{self.body}"

    @property
    def step_like(self) -> bool:
        return self.heading is not INTRODUCTION


INTRODUCTION = "Introduction"


def step_segments(sizes: list[tuple[int, bool]], max_chars: int, max_steps: int) -> list[list[int]]:
    """Places of items in greedy segments, by ``(characters, whether it is a step)`` of each."""
    out: list[list[int]] = []
    chars = steps = 0
    for i, (n, step) in enumerate(sizes):
        if not out or chars + n > max_chars or steps + step > max_steps:
            out.append([])
            chars = steps = 0
        out[-1].append(i)
        chars, steps = chars + n, steps + step
    return out


def _is_noise(line: str) -> bool:
    return (line.startswith("![") and "](" in line) or (line.startswith("<!--") and line.endswith("-->"))


def _numbers(heads: list[str]) -> list[int]:
    """Steps' numbers: their own, else one more than the one before."""
    own = [STEP_NUMBER.match(h) for h in heads]
    return list(accumulate(own, lambda before, m: int(m[1]) if m else before + 1, initial=0))[1:]


def _heading(head: str, body: str) -> str:
    m = STEP_NUMBER.match(head)
    name = (m[2].strip() if m else head) or head
    if UNNAMED_STEP.match(name):
        said = (BULLET.sub("", x) for x in map(str.strip, body.splitlines()) if x and not x.startswith(">"))
        return next((x[:80] for x in said if x), name)
    return name


def read_guide(text: str) -> tuple[str, list[Item]]:
    """A guide's title and its items with a body. What stands before the title belongs to the introduction."""
    lines = text.splitlines()
    title_at = next((i for i, x in enumerate(lines) if x.startswith("# ")), len(lines))
    heads = [i for i, x in enumerate(lines) if x.startswith("## ")]
    names = [lines[i][3:].strip() for i in heads]
    after = min([i for i in heads if i > title_at] or [len(lines)]) if title_at < len(lines) else len(lines)
    loose = "\n".join(x for i, x in enumerate(lines[:after]) if i != title_at and (i < title_at or not heads or i < heads[0]) and not x.startswith("## ")).strip()
    items = [Item(0, INTRODUCTION, loose)] if loose else []
    for (a, b), name, number in zip(pairwise([*heads, len(lines)]), names, _numbers(names), strict=True):
        kept = [x.rstrip() for x in lines[max(a, title_at) + 1 : b] if not _is_noise(x.strip())]
        body = re.sub(r"\n{3,}", "\n\n", THREE_PARTS.sub(r"\1", "\n".join(kept))).strip()
        if body:
            items.append(Item(number, _heading(name, body), body))
    return (lines[title_at][2:].strip() if title_at < len(lines) else "Untitled Guide"), items


def guide_images(text: str) -> dict[int, list[str]]:
    """Links of images by step, in order: markdown images, and the first link of a comment."""
    lines = [x.strip() for x in text.splitlines()]
    heads = [i for i, x in enumerate(lines) if x.startswith("## ")]
    numbers = [0, *_numbers([lines[i][3:].strip() for i in heads])]
    out: dict[int, list[str]] = {}
    for (a, b), number in zip(pairwise([0, *heads, len(lines)]), numbers, strict=True):
        for line in lines[a:b]:
            links = [url.strip() for _, url in IMAGE.findall(line)]
            if line.startswith("<!--") and (found := COMMENT_LINK.search(line)):
                links.append(found[0].rstrip(".,]"))
            out.setdefault(number, []).extend(x for x in links if x)
    return out


def guide_chunks(text: str, name: str, max_chars: int = 1200, max_steps: int = 5, overlap: int = 1) -> list[dict]:
    """A guide's chunks; each begins with the last ``overlap`` steps of the one before."""
    title, items = read_guide(text)
    images = guide_images(text)
    segments = step_segments([(len(x.body) + len(x.heading) + 10, x.step_like) for x in items], max_chars, max_steps)
    chunks = []
    for number, segment in enumerate(segments):
        before = [items[i] for i in segments[number - 1] if items[i].step_like] if number and overlap else []
        own = before[-overlap:] + [items[i] for i in segment]
        body = "\n\n".join(x.shown for x in own)
        content = f"[Document: {name}]\n\n" + f"Guide: {title}\n\n{body}".strip()
        steps = list(dict.fromkeys(x.step for x in own if x.step_like))
        chunks.append({"chunk_index": number, "heading": own[0].heading, "content": content, "token_count": len(content.split()), "step_indices": steps, "image_urls": [url for step in steps for url in images.get(step, [])]})
    return chunks


_CHUNK = {"chunk_index": pa.int32(), "heading": pa.string(), "content": pa.string(), "token_count": pa.int32(), "step_indices": pa.list_(pa.int32()), "image_urls": pa.list_(pa.string())}


def chunk_guides(docs: DataFrame, text: Column, name: Column, id_col: str = "doc_id") -> DataFrame:
    """``docs`` -> ``(doc_id, chunk_index, heading, content, token_count, step_indices, image_urls, content_type, document_title)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(i, chunk) for i, (text, name) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)) for chunk in guide_chunks(text, name)]
            rows = batch.select([0, 2]).take(pa.array([i for i, _ in made], pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array([chunk[c] for _, chunk in made], t) for c, t in _CHUNK.items()]], names=["doc_id", "document_title", *_CHUNK])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(name, F.lit("Untitled")).alias("name"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, document_title string, chunk_index int, heading string, content string, token_count int, step_indices array<int>, image_urls array<string>"
    found = map_batches(rows, run, schema).withColumn("content_type", F.lit("narrative"))
    return found.select("doc_id", "chunk_index", "heading", "content", "token_count", "content_type", "step_indices", "image_urls", "document_title")
