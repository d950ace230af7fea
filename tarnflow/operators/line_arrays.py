"""The line operators on whole documents, whose lines are one array: columns to columns, no shuffle.

What depends on lines before it is said by marks in front of each line: the marked lines are joined to one text and taken
apart again where a mark begins a section or a line of its own, so each step takes time in proportion to the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, strip
from . import lines as L


def _joined(lines: Column, joins: Callable[[Column, Column], Column], part: Callable[[Column, Column], Column]) -> Column:
    """Runs of lines made one, by a space: ``joins(lines, i)`` tells whether line i continues the one before."""

    def of(held: Column) -> Column:
        def placed(flags: Column) -> Column:
            piece = lambda x, i: F.when(F.coalesce(F.get(flags, i + 1), F.lit(False)), F.rtrim(part(x, F.get(flags, i)))).otherwise(part(x, F.get(flags, i)))
            return F.array_join(F.transform(held, lambda x, i: F.concat(F.when(i == 0, "").when(F.get(flags, i), " ").otherwise("\n"), piece(x, i))), "")

        return F.split(let(F.transform(held, lambda x, i: joins(held, i)), placed), "\n")

    return F.when(F.size(lines) > 0, let(lines, of)).otherwise(F.array().cast("array<string>"))


def merge_paragraphs(lines: Column) -> Column:
    """Stray lines dropped; lines of a paragraph joined, headings apart."""
    plain = lambda x: (x != "") & ~x.startswith("#")
    kept = F.filter(F.transform(lines, strip), lambda x: ~L.is_stray(x))
    return _joined(kept, lambda held, i: F.coalesce(plain(F.get(held, i)) & plain(F.get(held, i - 1)), F.lit(False)), lambda x, joined: x)


def markdown_sections(lines: Column) -> Column:
    """``array<struct<heading, content>>``: a section with content for each heading, and one for what stands before the first."""
    marked = lambda held: F.array_join(F.transform(held, lambda x: F.concat(F.when(x.rlike(L.MARKDOWN_HEADING), "H").otherwise("L"), x)), "\n")

    def unit(section: Column) -> Column:
        head = F.when(section.startswith("H"), F.substr(F.substring_index(section, "\n", 1), F.lit(2)))
        body = F.when(section.startswith("H"), F.substr(section, F.length(F.substring_index(section, "\n", 1)) + 2)).otherwise(section)
        return F.struct(strip(head).alias("heading"), strip(F.regexp_replace(body, r"(?<=\n)L|\AL", "")).alias("content"))

    return F.filter(F.transform(F.split(let(lines, marked), "\n(?=H)"), unit), lambda u: u["content"] != "")


def final_sections(text: Column) -> Column:
    return markdown_sections(merge_paragraphs(F.split(text, "\n")))
