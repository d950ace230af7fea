"""Operators on documents as ordered lines ``(doc_id, line_no, line)``: noise, contents pages, wraps, headings, sections, steps.

All windows share one specification (partitioned by document, ordered by line), so a chain of them shuffles once.
Whole documents that keep their lines in an array are treated by ``line_arrays`` without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import either, let, strip

# Line patterns of extracted manuals.
NOISE = [
    r"^Page\s+\d+\s*$", r"^Page\s+\d+\s+of\s+\d+\s*$", r"^\d+\s*$", r"^©.*\d{4}.*$", r"^Copyright\s+.*\d{4}.*$", r"^Issue\s+\d+.*$", r"^Revision\s+\d+.*$", r"^Rev\.\s*\d+.*$",
    r"(?i)^this page (is )?intentionally (left )?blank", r"^\.{5,}", r"^[A-Z][a-z]+\s+Manual\s*$", r"^Chapter\s+\d+\s*$",
]
NOISE_LIGHT = [r"^Page\s+\d+\s*of\s+\d+\s*$", r"^-\s*\d+\s*-$", r"^\d+\s*$", r"^©\s*\d{4}.*All Rights Reserved.*$", r"^this page (is )?intentionally (left )?blank\s*$"]
JUNK = [
    r"(?i)copyright|©|\(c\)", r"(?i)^Page\s+\d+", r"^\d+\s*$", r"(?i)^url:\s*", r"\[TABLE_PLACEHOLDER\]", r"(?i)^(Issue|Revision|Rev\.|Publication)\s+\w+", r"^[A-Z]\d{3,}[A-Z]?\d*\s*$", r"(?i)^Effective:\s*\d+",
]
CONTENTS = [r"(?i)^table\s+of\s+contents?\s*$", r"(?i)^contents?\s*$", r"(?i)^index\s*$", r"(?i)^list\s+of\s+figures?\s*$", r"(?i)^list\s+of\s+tables?\s*$"]
HEADINGS_LIGHT = [
    r"^#{1,6}\s+.+", r"^[A-Z][A-Z\s\-\d]{2,60}$", r"^\d+\.[\d.]*\s+[A-Z].{0,80}$", r"^(?:Chapter|Section|Part|Step)\s+\d+", r"^[■●▶►→•]\s*.{3,60}$", r"^(?:WARNING|CAUTION|NOTE|IMPORTANT|TIP)\s*[:\-]?",
    r"^\[.{2,40}\]$", r"^.{3,50}:\s*$", r"^(?:EXPERIENCE|EDUCATION|SKILLS|PROJECTS|TECHNICAL SKILLS)\s*$", r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,5}\s*$",
]
_B, _E = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
FOREIGN = {
    5: [
        f"{_B}installazione{_E}", f"{_B}utilizzo{_E}", f"{_B}gruppo{_E}", f"{_B}elettroge{_E}", f"{_B}manutenzione{_E}", f"{_B}manuale{_E}", f"{_B}uso{_E}", f"{_B}anomalie{_E}", f"{_B}cause{_E}", f"{_B}rimedi{_E}",
        f"{_B}(?:il|lo|la|i|le|gli)\\s", f"{_B}(?:del|della|dei|delle|dello){_E}", f"{_B}(?:e|o|a)\\s", f"{_B}(?:sono|è|sto|stai|sta){_E}", f"{_B}(?:buono|cattivo|grande|piccolo){_E}", f"zione{_E}", f"tà{_E}", f"ità{_E}",
    ],
    3: [
        f"{_B}(?:el|la|los|las)\\s", f"{_B}(?:de|del|de la){_E}", f"{_B}ción{_E}", f"ía{_E}", f"{_B}(?:es|soy|está|estoy){_E}", f"{_B}(?:le|la|les)\\s", f"{_B}(?:de|du|des){_E}", f"{_B}(?:est|suis){_E}",
        f"{_B}(?:der|die|das|den|dem)\\s", f"{_B}(?:und|oder|aber){_E}", f"keit{_E}",
    ],
}
ARTICLE_PATTERN = f"{_B}(?:e|o|a)\\s"
MARKDOWN_HEADING = r"^(#{1,6})\s+"
URL_MARK = r"(?i)\burl:\s*"
GUIDE_IMAGE = r"!\[[^\]]*\]\(([^)]+)\)"


def document() -> W:
    return W.partitionBy("doc_id").orderBy("line_no")


def lines_of(docs: DataFrame, text_col: str = "raw_content", id_col: str = "doc_id") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line_no", "line"))


def text_of(lines: DataFrame) -> DataFrame:
    """Lines joined again: ``(doc_id, text)``."""
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("text"))


def any_of(c: Column, patterns: list[str], flags: str = "") -> Column:
    return c.rlike(either(patterns, flags))


def drop_noise_lines(lines: DataFrame) -> DataFrame:
    return lines.filter((strip(F.col("line")) == "") | ~any_of(strip(F.col("line")), NOISE))


def drop_noise_lines_light(lines: DataFrame) -> DataFrame:
    return lines.filter((strip(F.col("line")) == "") | ~any_of(strip(F.col("line")), NOISE_LIGHT, "(?i)"))


def is_contents_line(line: Column) -> Column:
    return line.contains("...") | line.contains(". . .") | line.rlike(r"^.{5,50}\s{3,}\d{1,4}\s*$") | (line.rlike(r"^[A-Za-z].+\s+\d{1,3}\s*$") & (F.length(line) < 80))


def drop_toc_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(~is_contents_line(strip(F.col("line"))))


def is_junk(s: Column) -> Column:
    """Of a stripped line that isn't blank."""
    return any_of(s, JUNK) | (s.rlike(r"^[\d\s\-\(\)]+$") & (F.length(s) < 15))


def drop_junk_lines(lines: DataFrame) -> DataFrame:
    """Lines without junk, stripped; at most one blank line in a row; ``url:`` inside a line removed."""
    kept = lines.withColumn("line", strip(F.col("line"))).filter((F.col("line") == "") | ~is_junk(F.col("line")))
    squeezed = kept.withColumn("__before", F.lag("line").over(document())).filter((F.col("line") != "") | (F.col("__before") != "")).drop("__before")
    return squeezed.withColumn("line", F.regexp_replace("line", URL_MARK, ""))


def _after_border(patterns: list[str]) -> str:
    """One pattern for any of ``patterns``, which looks for a word's start once for all that begin with one."""
    inner = [p.removeprefix(_B) for p in patterns if p.startswith(_B)]
    return either([f"{_B}(?:{either(inner)})", *[p for p in patterns if not p.startswith(_B)]])


def is_foreign(line: Column, strict_parity: bool = True) -> Column:
    """Whether the weights of the patterns that a line matches add up to more than 3: one of weight 5, or two of weight 3."""
    strong = [p for p in FOREIGN[5] if strict_parity or p != ARTICLE_PATTERN]
    weak = FOREIGN[3]

    def judged(low: Column) -> Column:
        hits = F.lit(0)
        for p in weak:
            hits = hits + low.rlike(p).cast("int")
        return low.rlike(_after_border(strong)) | (low.rlike(_after_border(weak)) & (hits > 1))

    return let(F.lower(line), judged)


def english_lines(lines: DataFrame, strict_parity: bool = True) -> DataFrame:
    """Lines that don't score as Italian, Spanish, French or German. With ``strict_parity`` the single words e, o and a
    count as Italian, so English lines with the article are dropped too."""
    return lines.filter((F.length(strip(F.col("line"))) < 3) | ~is_foreign(F.col("line"), strict_parity))


def drop_guide_noise_lines(lines: DataFrame) -> DataFrame:
    s = strip(F.col("line"))
    return lines.filter(~((s.startswith("![") & s.contains("](")) | (s.startswith("<!--") & s.endswith("-->"))))


def _is_upper(c: Column) -> Column:
    return (c == F.upper(c)) & (c != F.lower(c))


def is_major_heading(line: Column) -> Column:
    return (_is_upper(line) & (F.length(line) > 3)) | line.rlike(r"^\d+\.\s+[A-Z]") | line.startswith("#")


def contents_event(s: Column) -> Column:
    """Of a stripped line: ``open`` where a contents section begins, ``close`` at a major heading, else null."""
    return F.when(s == "", F.lit(None)).when(any_of(s, CONTENTS), F.lit("open")).when(is_major_heading(s), F.lit("close"))


def drop_toc_sections(lines: DataFrame, english_only: bool = False) -> DataFrame:
    """Contents sections removed: a contents heading opens one, the next major heading ends it and stays; blank lines stay."""
    if english_only:
        lines = english_lines(lines)
    s = strip(F.col("line"))
    state = F.last(contents_event(s), ignorenulls=True).over(document().rowsBetween(W.unboundedPreceding, 0))
    return lines.withColumn("__state", state).filter((s == "") | F.coalesce(F.col("__state") != "open", F.lit(True))).drop("__state")


def continues(s: Column, before: Column, stop: str, light: bool) -> Column:
    """Whether a stripped line continues the one before it."""
    first = F.substring(s, 1, 1)
    return F.coalesce((s != "") & (before != "") & ~F.lit(stop + (")" if light else "")).contains(F.right(before, F.lit(1))) & (first != F.upper(first)), F.lit(False))


def merge_wrapped_lines(lines: DataFrame, stop: str = ".!?:;", light: bool = False) -> DataFrame:
    """A line that starts lower-case continues a line that isn't blank and has no stop at its end; light also stops at
    ``)`` and never merges bullets. Gaps and islands: a merged run keeps the number of its first line."""
    s, before = strip(F.col("line")), strip(F.lag("line").over(document()))
    joins = continues(s, before, stop, light)
    run = F.sum(F.when(joins, 0).otherwise(1)).over(document().rowsBetween(W.unboundedPreceding, 0))
    marked = lines.withColumn("__joins", joins).withColumn("__run", run)
    parts = F.array_sort(F.collect_list(F.struct("line_no", F.when(F.col("__joins"), s).otherwise(F.col("line")).alias("line"))))
    merged = marked.groupBy("doc_id", "__run").agg(F.min("line_no").alias("line_no"), F.transform(parts, lambda p: p["line"]).alias("parts"))
    return merged.select("doc_id", "line_no", F.array_join(F.transform("parts", lambda x, i: F.when(i < F.size("parts") - 1, F.rtrim(x)).otherwise(x)), " ").alias("line"))


def is_heading(s: Column, following: Column, mode: str) -> Column:
    """Of a stripped line and the stripped line that follows it."""
    last, first = F.right(s, F.lit(1)), F.substring(s, 1, 1)
    capital = (first == F.upper(first)) & (first != F.lower(first))
    if mode == "light":
        fits = any_of(s, HEADINGS_LIGHT) | (_is_upper(s) & F.length(s).between(3, 60)) | ((F.length(s) < 40) & capital & ~F.lit(".!?,;:").contains(last) & (F.length(following) > F.length(s)))
        found = (s != "") & (F.length(s) <= 100) & ~(s.contains(". ") & (F.length(s) > 50)) & fits
    else:
        is_capital = lambda w: (F.substring(w, 1, 1) == F.upper(F.substring(w, 1, 1))) & (F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1)))
        titled = let(F.filter(F.split(s, r"\s+"), lambda w: w != ""), lambda words: (F.size(words) >= 2) & (F.size(F.filter(words, is_capital)) >= F.size(words) * 0.6))
        title = (F.length(s) < 60) & ~F.lit(".,;:!?").contains(last) & capital & (following != "") & titled
        found = (F.length(s) >= 2) & (s.startswith("#") | (_is_upper(s) & (F.length(s) >= 3) & s.contains(" ")) | s.rlike(r"^(\d+\.)+\s+[A-Z]") | s.rlike(r"^[A-Z]\.\d+\s+") | title)
    return F.coalesce(found, F.lit(False))


def detect_headings(lines: DataFrame, mode: str = "universal") -> DataFrame:
    """Adds ``is_heading`` (and ``level`` for markdown)."""
    if mode == "markdown":
        return lines.withColumn("level", F.length(F.regexp_extract("line", MARKDOWN_HEADING, 1))).withColumn("is_heading", F.col("level") > 0)
    return lines.withColumn("is_heading", is_heading(strip(F.col("line")), strip(F.coalesce(F.lead("line").over(document()), F.lit(""))), mode))


def split_sections(marked: DataFrame, min_chars: int = 10, prefix_heading: bool = False) -> DataFrame:
    """``detect_headings`` lines -> ``(doc_id, section_no, heading, content)``. A section without content goes with its heading."""
    section = F.sum(F.col("is_heading").cast("int")).over(document().rowsBetween(W.unboundedPreceding, 0))
    rows = marked.withColumn("section_no", section)
    body = F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("line_no", "line"))))
    out = rows.groupBy("doc_id", "section_no").agg(F.max(F.when(F.col("is_heading"), strip(F.col("line")))).alias("heading"), F.array_join(F.transform(body, lambda p: p["line"]), "\n").alias("content"))
    out = out.withColumn("content", strip(F.col("content"))).filter(F.length("content") >= min_chars)
    if prefix_heading:
        out = out.withColumn("content", F.concat(F.coalesce(F.concat("heading", F.lit("\n\n")), F.lit("")), "content"))
    return out


def guide_steps(lines: DataFrame) -> DataFrame:
    """Adds ``step`` (0 the introduction), the guide's ``title`` and the step's ``heading`` to a guide's lines."""
    first_title = F.min(F.when(F.col("line").startswith("# "), F.col("line_no"))).over(W.partitionBy("doc_id"))
    rows = lines.withColumn("__title_at", first_title).withColumn("title", F.coalesce(strip(F.substr(F.max(F.when(F.col("line_no") == first_title, F.col("line"))).over(W.partitionBy("doc_id")), F.lit(3))), F.lit("Untitled Guide")))
    rows = rows.filter(F.col("__title_at").isNull() | (F.col("line_no") != F.col("__title_at")))
    head = F.when(F.col("line").startswith("## "), strip(F.substr("line", F.lit(4))))
    rows = rows.withColumn("__head", head)
    number = F.regexp_extract("__head", r"^(\d+)\.\s*", 1).try_cast("int")
    upto = document().rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__n", number).withColumn("__group", F.count("__n").over(upto)).withColumn("__base", F.coalesce(F.last("__n", ignorenulls=True).over(upto), F.lit(0)))
    since = F.count(F.when(F.col("__head").isNotNull() & F.col("__n").isNull(), 1)).over(W.partitionBy("doc_id", "__group").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    started = F.count("__head").over(upto) > 0
    heading = F.regexp_replace(F.last("__head", ignorenulls=True).over(upto), r"^\d+\.\s*", "")
    out = rows.withColumn("step", F.when(started, F.col("__base") + since).otherwise(0).cast("int")).withColumn("heading", heading)
    return out.filter("__head IS NULL").select("doc_id", "line_no", "line", "title", "step", "heading")


def step_images(lines: DataFrame) -> DataFrame:
    """Images of a guide's steps: markdown images, or the first link of a comment; numbered within the step."""
    steps = guide_steps(lines)
    comment = F.when(F.col("line").contains("<!--"), F.filter(F.array(F.regexp_replace(F.regexp_extract("line", r"(https?://\S+)", 1), r"[.,\]]+$", "")), lambda u: u != "")).otherwise(F.array().cast("array<string>"))
    urls = F.concat(F.regexp_extract_all("line", F.lit(GUIDE_IMAGE), F.lit(1)), comment)
    found = steps.select("doc_id", "step", "line_no", F.posexplode(urls).alias("i", "url"))
    return found.withColumn("image_no", F.row_number().over(W.partitionBy("doc_id", "step").orderBy("line_no", "i")) - 1).select("doc_id", "step", "image_no", "url")


def drop_repeated_short_lines(lines: DataFrame, max_len: int = 40, times: int = 3) -> DataFrame:
    """Short lines whose text occurs more than ``times`` times in the document, and page lines, removed."""
    s = strip(F.col("line"))
    count = F.sum(F.when(F.length(s) <= 60, 1).otherwise(0)).over(W.partitionBy("doc_id", s))
    rows = lines.withColumn("__n", count)
    return rows.filter(~((s != "") & (F.length("line") < max_len) & (F.col("__n") > times)) & ~s.rlike(r"(?i)^page\s+\d+$")).drop("__n")


def first_occurrence_blocks(lines: DataFrame) -> DataFrame:
    """Repeated identical blocks (here lines) of a document removed; blank ones stay."""
    rank = F.row_number().over(W.partitionBy("doc_id", F.xxhash64("line"), "line").orderBy("line_no"))
    return lines.withColumn("__rank", rank).filter((F.col("__rank") == 1) | (F.trim("line") == "")).drop("__rank")


def soft_wrap_lines(lines: DataFrame, words: int = 6) -> DataFrame:
    """Short lines gather, a longer line closes their run; headings, tables, images and blanks break; page marks go."""
    s = strip(F.col("line"))
    rows = lines.filter(~s.rlike(r"(?i)^#?\s*page\s+\d+$")).withColumn("line", s)
    hard = (F.col("line") == "") | F.col("line").startswith("#") | F.col("line").rlike(r"(?i)^(?:\[TABLE_PLACEHOLDER\]|table:|image:|url:)")
    short = ~hard & (F.size(F.split("line", r"\s+")) <= words)
    rows = rows.withColumn("__hard", hard).withColumn("__short", short)
    continues = F.coalesce(F.lag("__short").over(document()), F.lit(False)) & ~F.col("__hard")
    run = F.sum(F.when(continues, 0).otherwise(1)).over(document().rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("__run", run)
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    merged = rows.groupBy("doc_id", "__run").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(parts, lambda p: p["line"]), " ").alias("line"))
    before = F.lag("line").over(document())
    return merged.select("doc_id", "line_no", "line").withColumn("__before", before).filter((F.col("line") != "") | F.coalesce(F.col("__before") != "", F.lit(False))).drop("__before")


def identifier(text: Column, file_title: Column) -> Column:
    """First usable H1 of 30 lines, else H2, else a title-like line of 20, else the file's title."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", 31), strip)
    head = F.slice(lines, 1, 30)
    usable = lambda h: (F.length(h) >= 3) & ~F.lower(h).isin("introduction", "contents", "table of contents", "index", "overview", "untitled")
    level = lambda mark: F.get(F.filter(F.transform(F.filter(head, lambda x: x.startswith(mark + " ")), lambda x: strip(F.substr(x, F.lit(len(mark) + 2)))), usable), F.lit(0))

    def titled(x: Column) -> Column:
        words = F.split(x, r"\s+")
        lower = F.size(F.filter(words, lambda w: (F.length(w) > 3) & (w == F.lower(w)) & (w != F.upper(w))))
        return F.length(x).between(3, 80) & ~x.rlike(r"\.\s") & x.rlike(r"^[\p{Lu}\d]") & ((F.size(words) >= 2) | _is_upper(x)) & (lower * 2 <= F.size(words)) & ~x.startswith("#")

    return F.coalesce(level("#"), level("##"), F.get(F.filter(F.slice(lines, 1, 20), titled), F.lit(0)), F.regexp_replace(file_title, r"(?i)\.pdf$", ""))


def document_identifier(docs: DataFrame, file_title: str = "title", text_col: str = "raw_content", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, identifier)``; no shuffle."""
    return docs.select(F.col(id_col).alias("doc_id"), identifier(F.col(text_col), F.col(file_title)).alias("identifier"))


def is_stray(s: Column) -> Column:
    """Of a stripped line: a contents heading, or a bare short mark."""
    return any_of(F.regexp_replace(s, r"^#+\s*", ""), CONTENTS) | (s.rlike(r"^[\d.\-•*\s]+$") & (F.length(s) <= 20) & (s != ""))


def normalize_pdf_markdown(lines: DataFrame) -> DataFrame:
    """Contents headings and bare short marks dropped; the lines of a paragraph joined, headings apart."""
    s = strip(F.col("line"))
    rows = lines.withColumn("line", s).filter(~is_stray(F.col("line")))
    plain = (F.col("line") != "") & ~F.col("line").startswith("#")
    rows = rows.withColumn("__plain", plain)
    joins = F.col("__plain") & F.coalesce(F.lag("__plain").over(document()), F.lit(False))
    rows = rows.withColumn("__run", F.sum(F.when(joins, 0).otherwise(1)).over(document().rowsBetween(W.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return rows.groupBy("doc_id", "__run").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(parts, lambda p: p["line"]), " ").alias("line")).drop("__run")


def merge_tables_into_pages(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """``lines(doc_id, page, line_no, line)``, ``tables(doc_id, page, table_no, rendered)``: the nth mark of a page becomes
    its nth table; tables without a mark follow at the page's end."""
    mark = F.col("line").contains("[TABLE_PLACEHOLDER]")
    page = W.partitionBy("doc_id", "page").orderBy("line_no")
    rows = lines.withColumn("__n", F.when(mark, F.sum(mark.cast("int")).over(page.rowsBetween(W.unboundedPreceding, 0)) - 1))
    numbered = tables.withColumn("__n", F.row_number().over(W.partitionBy("doc_id", "page").orderBy("table_no")) - 1).select("doc_id", "page", "__n", "rendered")
    placed = rows.join(numbered, ["doc_id", "page", "__n"], "left").withColumn("line", F.when(F.col("__n").isNotNull() & F.col("rendered").isNotNull(), F.col("rendered")).otherwise(F.col("line")))
    marks = rows.groupBy("doc_id", "page").agg(F.count("__n").alias("__marks"), F.max("line_no").alias("__last"))
    rest = numbered.join(marks, ["doc_id", "page"]).filter(F.col("__n") >= F.col("__marks")).select("doc_id", "page", (F.col("__last") + 1 + F.col("__n") - F.col("__marks")).alias("line_no"), F.col("rendered").alias("line"))
    return placed.select("doc_id", "page", "line_no", "line").unionByName(rest)


def replace_image_markers(docs: DataFrame, images: DataFrame) -> DataFrame:
    """``images(doc_id, image_no, url)``: ``[IMAGE:n]`` and then ``IMAGE:n`` become image lines, in image order."""
    found = images.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("image_no", "url"))).alias("__images"))
    shown = lambda i: F.concat(F.lit("\nimage: "), i["image_no"].cast("string"), F.lit("\nurl: "), i["url"], F.lit("\n"))
    name = lambda i: F.concat(F.lit("IMAGE:"), i["image_no"].cast("string"))
    step = lambda text, i: F.replace(F.replace(text, F.concat(F.lit("["), name(i), F.lit("]")), shown(i)), name(i), shown(i))
    out = docs.join(found, "doc_id", "left")
    return out.withColumn("raw_content", F.aggregate(F.coalesce("__images", F.array().cast("array<struct<image_no:int,url:string>>")), F.col("raw_content"), step)).drop("__images")
