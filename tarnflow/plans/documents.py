"""Queries over documents as lines, sections and chunks, with their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import batching
from ..operators import chunks as C
from ..operators import lines as L
from ..operators import quality as Q
from ..sources.adapters import view, with_views


def _lines(s, d):
    return L.lines_of(view(s, d, "v_manuals"))


def _on_lines(op, *args, **kw):
    return lambda s, d: op(_lines(s, d), *args, **kw)


def _headings(s, d):
    """Manuals as markdown guides: `#` titles, `##` steps at some lines."""
    line = F.when(F.col("line").startswith("1. "), F.lit("## 3. Open it")).when(F.col("line") == "SAFETY NOTES", F.lit("## Close it")).otherwise(F.col("line"))
    return _lines(s, d).withColumn("line", line)


def _sections(s, d):
    return C.light_sections(view(s, d, "v_manuals"))


def _line_sections(s, d):
    """Each line that isn't blank as an unnamed section."""
    rows = L.lines_of(view(s, d, "v_sources"), id_col="source_id")
    return rows.select("doc_id", F.col("line_no").alias("section_no"), F.lit(None).cast("string").alias("heading"), F.regexp_replace("line", r"^\s+|\s+$", "").alias("content")).filter("content <> ''")


def _digest(sections, rule):
    return lambda s, d: C.pack(sections(s, d), rule).select("doc_id", "chunk_index", F.md5("content").alias("content"))


def _whole(s, d):
    return view(s, d, "v_manuals").select("doc_id", F.lit(0).alias("section_no"), F.lit("Manual").alias("heading"), F.col("raw_content").alias("content"))


def _packed(*rules):
    return lambda s, d: C.pack(_sections(s, d), *rules)


def _pages(s, d):
    """Every line of every manual, a page for each ten lines; each third line marks a table; a table for each fifth line of a document."""
    line = F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("[TABLE_PLACEHOLDER] "), F.left("line", F.lit(5)))).otherwise(F.col("line"))
    page = F.floor(F.col("line_no") / 10).cast("int")
    lines = _lines(s, d).select("doc_id", page.alias("page"), "line_no", line.alias("line"))
    tables = _lines(s, d).filter("line_no % 5 <= doc_id % 5").select("doc_id", page.alias("page"), F.col("line_no").alias("table_no"), F.concat(F.lit("| "), "line", F.lit(" |")).alias("rendered"))
    return L.merge_tables_into_pages(lines, tables)


def _marked(s, d):
    """Every text with marks of images where its sentences and lines end, and some images for it."""
    text = F.replace(F.replace("raw_content", F.lit(". "), F.lit(". [IMAGE:1] ")), F.lit("\n"), F.lit(" IMAGE:2\nIMAGE:12 "))
    docs = view(s, d, "v_sources").select(F.col("source_id").alias("doc_id"), text.alias("raw_content"))
    images = docs.select("doc_id", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 3).cast("int") + 1)).alias("image_no")).filter("doc_id % 4 <> 0").select("doc_id", "image_no", F.concat(F.lit("u"), F.col("image_no").cast("string")).alias("url"))
    return L.replace_image_markers(docs, images)


def _final_chunks(s, d):
    return C.chunk_documents(view(s, d, "v_manuals"), "final")


def _guides(s, d):
    """Manuals as guides in which every paragraph is a step without a name of its own."""
    text = F.replace(F.replace("raw_content", F.lit("1. Setup"), F.lit("## 3. Open it")), F.lit("\n\n"), F.lit("\n## Step 1\n"))
    chunks = C.chunk_documents(view(s, d, "v_manuals").withColumn("raw_content", text), "guide")
    return chunks.withColumn("step_indices", F.array_join("step_indices", ",")).withColumn("image_urls", F.array_join("image_urls", "|"))


def _items(s, d):
    steps = L.guide_steps(_headings(s, d))
    return steps.groupBy("doc_id", "step").agg(F.first("title").alias("title"), F.first("heading").alias("heading"), F.count("*").cast("string").alias("body")).select("doc_id", "step", "title", F.coalesce("heading", F.lit("Introduction")).alias("heading"), "body", F.floor(F.col("step") / 4).cast("int").alias("segment"))


def _batches(s, d):
    rows = view(s, d, "v_chunks").select((F.col("source_id") % 3).alias("family_id"), F.col("chunk_id").alias("position"), "chunk_id", (F.octet_length("content") + F.col("token_count")).cast("long").alias("bytes"))
    return batching.pack_embedding_batches(rows, 7, 1200)


def _words_of_one_family(s, d):
    """All texts of one family, by their words, over many blocks."""
    rows = view(s, d, "v_sources").select(F.lit("all").alias("family_id"), (F.col("source_id") % 97).alias("position"), F.col("source_id").alias("chunk_id"), T.word_count(F.col("raw_content")).alias("words"))
    return batching.pack_embedding_batches(rows, 20, 3000, "words", 100)


def _images(s, d):
    steps = L.step_images(_headings(s, d))
    chunks = view(s, d, "v_manuals").select("doc_id", F.lit(0).alias("chunk_index"), F.array(F.lit(3), F.lit(4)).alias("step_indices"))
    return C.attach_images_to_chunks(chunks, steps).select("doc_id", "chunk_index", F.array_join("image_urls", "|").alias("urls"))


QUERIES = {
    "drop_noise_lines": _on_lines(L.drop_noise_lines),
    "drop_noise_lines_light": _on_lines(L.drop_noise_lines_light),
    "drop_toc_lines": _on_lines(L.drop_toc_lines),
    "drop_junk_lines": _on_lines(L.drop_junk_lines),
    "english_lines": _on_lines(L.english_lines),
    "english_lines_without_articles": _on_lines(L.english_lines, strict_parity=False),
    "drop_guide_noise_lines": _on_lines(L.drop_guide_noise_lines),
    "drop_toc_sections": _on_lines(L.drop_toc_sections),
    "merge_wrapped_lines": _on_lines(L.merge_wrapped_lines),
    "merge_wrapped_lines_light": _on_lines(L.merge_wrapped_lines, light=True),
    "detect_headings": lambda s, d: L.detect_headings(_lines(s, d)).select("doc_id", "line_no", "is_heading"),
    "detect_headings_light": lambda s, d: L.detect_headings(_lines(s, d), "light").select("doc_id", "line_no", "is_heading"),
    "detect_headings_markdown": lambda s, d: L.detect_headings(_lines(s, d), "markdown").select("doc_id", "line_no", "level"),
    "split_sections": lambda s, d: L.split_sections(L.detect_headings(_lines(s, d), "markdown")),
    "guide_steps": lambda s, d: L.guide_steps(_headings(s, d)).select("doc_id", "line_no", "title", "step", "heading"),
    "step_images": lambda s, d: L.step_images(_headings(s, d)),
    "drop_repeated_short_lines": _on_lines(L.drop_repeated_short_lines),
    "first_occurrence_blocks": _on_lines(L.first_occurrence_blocks),
    "soft_wrap_lines": _on_lines(L.soft_wrap_lines),
    "document_identifier": lambda s, d: L.document_identifier(view(s, d, "v_sources"), id_col="source_id"),
    "normalize_pdf_markdown": _on_lines(L.normalize_pdf_markdown),
    "merge_tables_into_pages": _pages,
    "replace_image_markers": _marked,
    "paragraph_groups": lambda s, d: C.paragraph_groups(view(s, d, "v_manuals"), 4, "raw_content"),
    "split_oversized": _digest(_whole, C.split_oversized),
    "merge_small": _packed(C.merge_small),
    "pack_sentences": _packed(C.pack_sentences),
    "merge_small_into_previous": _digest(_line_sections, C.merge_small_into_previous),
    "combine_small_sections": _digest(_line_sections, C.combine_small_sections),
    "segment_steps": _digest(_line_sections, C.segment_steps),
    "slice_tokens": lambda s, d: C.slice_tokens(view(s, d, "v_sources").select(F.col("source_id").alias("doc_id"), F.lit(0).alias("section_no"), F.col("title").alias("heading"), F.col("raw_content").alias("content"))),
    "overlap_chunks": lambda s, d: C.overlap_chunks(_final_chunks(s, d).select("doc_id", "chunk_index", "heading", "content")),
    "step_overlap_segments": lambda s, d: C.step_overlap_segments(_items(s, d)).select("doc_id", "segment", "content", F.array_join("step_indices", ",").alias("step_indices"), F.array_join("headings", "|").alias("headings")),
    "pack_embedding_batches": _batches,
    "pack_embedding_batches_words": _words_of_one_family,
    "attach_images_to_chunks": _images,
    "chunk_documents": lambda s, d: C.chunk_documents(view(s, d, "v_sources"), id_col="source_id"),
    "chunk_documents_universal": lambda s, d: C.chunk_documents(view(s, d, "v_manuals"), "universal").withColumn("image_urls", F.array_join("image_urls", "|")),
    "chunk_documents_final": _final_chunks,
    "chunk_documents_guide": _guides,
    "chunk_corpus_report": lambda s, d: C.chunk_corpus_report(_final_chunks(s, d)),
    "content_type_histogram": lambda s, d: Q.content_type_histogram(_final_chunks(s, d)),
}

_L = "lines AS (SELECT doc_id, CAST(i - 1 AS INT) AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(raw_content, chr(10)) AS l FROM v_manuals)))"
_S = "s AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t FROM lines)"


def _hits(column: str, patterns: list[str], flags: str = "") -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{flags}{p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"


_UPPER = "(t = upper(t) AND t <> lower(t))"
_MAJOR = f"(({_UPPER} AND length(t) > 3) OR regexp_matches(t, '^\\d+\\.\\s+[A-Z]') OR starts_with(t, '#'))"
_TOC = "(contains(t, '...') OR contains(t, '. . .') OR regexp_matches(t, '^.{5,50}\\s{3,}\\d{1,4}\\s*$') OR (regexp_matches(t, '^[A-Za-z].+\\s+\\d{1,3}\\s*$') AND length(t) < 80))"
_score = lambda skip: " + ".join(f"CASE WHEN regexp_matches(lower(line), '{p}') THEN {w} ELSE 0 END" for w, ps in L.FOREIGN.items() for p in ps if p != skip)
_W = "OVER (PARTITION BY doc_id ORDER BY line_no)"


def _merge(stop: str) -> str:
    return f"""SELECT doc_id, CAST(min(line_no) AS INT) AS line_no, string_agg(CASE WHEN line_no < fin THEN rtrim(part) ELSE part END, ' ' ORDER BY line_no) AS line
      FROM (SELECT *, max(line_no) OVER (PARTITION BY doc_id, run) AS fin FROM (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) {_W} AS run, CASE WHEN joins THEN t ELSE line END AS part
        FROM (SELECT *, coalesce(t <> '' AND before <> '' AND NOT contains('{stop}', right(before, 1)) AND left(t, 1) <> upper(left(t, 1)), false) AS joins FROM (SELECT *, lag(t) {_W} AS before FROM s)))) GROUP BY doc_id, run"""


ORACLES = {
    "drop_noise_lines": with_views(f"SELECT doc_id, line_no, line FROM s WHERE t = '' OR NOT {_hits('t', L.NOISE)}", _L, _S),
    "drop_noise_lines_light": with_views(f"SELECT doc_id, line_no, line FROM s WHERE t = '' OR NOT {_hits('t', L.NOISE_LIGHT, '(?i)')}", _L, _S),
    "drop_toc_lines": with_views(f"SELECT doc_id, line_no, line FROM s WHERE NOT {_TOC}", _L, _S),
    "drop_junk_lines": with_views(
        f"""SELECT doc_id, line_no, regexp_replace(t, '(?i)\\burl:\\s*', '', 'g') AS line FROM (SELECT *, lag(t) {_W} AS before FROM s WHERE t = '' OR NOT ({_hits('t', L.JUNK)} OR (regexp_matches(t, '^[\\d\\s\\-\\(\\)]+$') AND length(t) < 15)))
            WHERE t <> '' OR before <> ''""",
        _L,
        _S,
    ),
    "english_lines": with_views(f"SELECT doc_id, line_no, line FROM s WHERE length(t) < 3 OR {_score(None)} <= 3", _L, _S),
    "english_lines_without_articles": with_views(f"SELECT doc_id, line_no, line FROM s WHERE length(t) < 3 OR {_score(L.ARTICLE_PATTERN)} <= 3", _L, _S),
    "drop_guide_noise_lines": with_views("SELECT doc_id, line_no, line FROM s WHERE NOT ((starts_with(t, '![') AND contains(t, '](')) OR (starts_with(t, '<!--') AND ends_with(t, '-->')))", _L, _S),
    "drop_toc_sections": with_views(
        f"""SELECT doc_id, line_no, line FROM (SELECT *, last_value(event IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state
            FROM (SELECT *, CASE WHEN t = '' THEN NULL WHEN {_hits('t', L.CONTENTS)} THEN 'open' WHEN {_MAJOR} THEN 'close' END AS event FROM s)) WHERE t = '' OR state IS NULL OR state <> 'open'""",
        _L,
        _S,
    ),
    "merge_wrapped_lines": with_views(_merge(".!?:;"), _L, _S),
    "merge_wrapped_lines_light": with_views(_merge(".!?:;)"), _L, _S),
    "detect_headings_markdown": with_views("SELECT doc_id, line_no, CAST(length(regexp_extract(line, '^(#{1,6})\\s+', 1)) AS INT) AS level FROM s", _L, _S),
    "detect_headings_light": with_views(
        f"""SELECT doc_id, line_no, t <> '' AND length(t) <= 100 AND NOT (contains(t, '. ') AND length(t) > 50) AND ({_hits('t', L.HEADINGS_LIGHT)} OR ({_UPPER} AND length(t) BETWEEN 3 AND 60)
            OR (length(t) < 40 AND left(t, 1) = upper(left(t, 1)) AND left(t, 1) <> lower(left(t, 1)) AND NOT contains('.!?,;:', right(t, 1)) AND length(nxt) > length(t))) AS is_heading
            FROM (SELECT *, coalesce(lead(t) {_W}, '') AS nxt FROM s)""",
        _L,
        _S,
    ),
    "split_sections": with_views(
        f"""SELECT doc_id, section_no, heading, content FROM (SELECT doc_id, section_no, max(CASE WHEN h THEN t END) AS heading, regexp_replace(coalesce(string_agg(CASE WHEN NOT h THEN line END, chr(10) ORDER BY line_no), ''), '^\\s+|\\s+$', '', 'g') AS content
            FROM (SELECT *, sum(CAST(h AS INT)) {_W} AS section_no FROM (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+') AS h FROM s)) GROUP BY 1, 2) WHERE length(content) >= 10""",
        _L,
        _S,
    ),
    "drop_repeated_short_lines": with_views(
        "SELECT doc_id, line_no, line FROM (SELECT *, sum(CASE WHEN length(t) <= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, t) AS n FROM s) WHERE NOT (t <> '' AND length(line) < 40 AND n > 3) AND NOT regexp_matches(t, '(?i)^page\\s+\\d+$')", _L, _S
    ),
    "first_occurrence_blocks": with_views("SELECT doc_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS r FROM lines) WHERE r = 1 OR trim(line) = ''", _L),
    "replace_image_markers": with_views(
        """SELECT source_id AS doc_id, CASE WHEN source_id % 4 = 0 THEN text WHEN source_id % 3 >= 1 THEN replace(replace(one, '[IMAGE:2]', chr(10) || 'image: 2' || chr(10) || 'url: u2' || chr(10)), 'IMAGE:2', chr(10) || 'image: 2' || chr(10) || 'url: u2' || chr(10)) ELSE one END AS raw_content
           FROM (SELECT source_id, text, replace(replace(text, '[IMAGE:1]', m), 'IMAGE:1', m) AS one FROM (SELECT source_id, replace(replace(raw_content, '. ', '. [IMAGE:1] '), chr(10), ' IMAGE:2' || chr(10) || 'IMAGE:12 ') AS text, chr(10) || 'image: 1' || chr(10) || 'url: u1' || chr(10) AS m FROM v_sources))"""
    ),
    "slice_tokens": with_views(
        """SELECT source_id AS doc_id, 0 AS section_no, CASE WHEN p = 0 THEN title END AS heading, CAST(p AS INT) AS piece_no, CASE WHEN n > 450 THEN array_to_string(w[p * 392 + 1 : p * 392 + 442], ' ') ELSE raw_content END AS content
           FROM (SELECT *, unnest(range(0, CASE WHEN n > 450 THEN (n - 1) // 392 + 1 ELSE 1 END)) AS p FROM (SELECT *, len(w) AS n FROM (SELECT *, [x for x in regexp_split_to_array(raw_content, '\\s+') if x <> ''] AS w FROM v_sources)))"""
    ),
}

_PARAGRAPHS = "p AS (SELECT doc_id, [x for x in [regexp_replace(y, '^\\s+|\\s+$', '', 'g') for y in regexp_split_to_array(raw_content, '\\n\\s*\\n')] if x <> ''] AS l FROM v_manuals)"
_CAPITAL = "(left({0}, 1) = upper(left({0}, 1)) AND left({0}, 1) <> lower(left({0}, 1)))"
_GUIDE = """g AS (SELECT doc_id, line_no, CASE WHEN starts_with(line, '1. ') THEN '## 3. Open it' WHEN line = 'SAFETY NOTES' THEN '## Close it' ELSE line END AS line FROM lines),
  heads AS (SELECT *, min(CASE WHEN starts_with(line, '# ') THEN line_no END) OVER (PARTITION BY doc_id) AS title_at, CASE WHEN starts_with(line, '## ') THEN trim(substr(line, 4)) END AS head FROM g),
  numbered AS (SELECT *, try_cast(regexp_extract(head, '^(\\d+)\\.\\s*', 1) AS INT) AS n FROM heads WHERE title_at IS NULL OR line_no <> title_at),
  runs AS (SELECT *, count(n) OVER u AS grp, count(head) OVER u AS started, coalesce(last_value(n IGNORE NULLS) OVER u, 0) AS base, last_value(head IGNORE NULLS) OVER u AS named FROM numbered
    WINDOW u AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  steps AS (SELECT doc_id, line_no, line, 'Manual ' || doc_id AS title, CAST(CASE WHEN started > 0 THEN base + count(CASE WHEN head IS NOT NULL AND n IS NULL THEN 1 END) OVER (PARTITION BY doc_id, grp ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE 0 END AS INT) AS step,
    regexp_replace(named, '^\\d+\\.\\s*', '') AS heading, head FROM runs)"""
_IMAGES = """images AS (SELECT doc_id, step, row_number() OVER (PARTITION BY doc_id, step ORDER BY line_no) - 1 AS image_no, url FROM (SELECT doc_id, step, line_no, unnest(regexp_extract_all(line, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1)) AS url FROM steps WHERE head IS NULL))"""


def _joined(source: str, joins: str) -> str:
    """Runs of lines for which ``joins`` holds, each joined to the line before it."""
    return f"""SELECT doc_id, CAST(min(line_no) AS INT) AS line_no, string_agg(line, ' ' ORDER BY line_no) AS line FROM (SELECT *, sum(CASE WHEN {joins} THEN 0 ELSE 1 END) {_W} AS run FROM {source}) GROUP BY doc_id, run"""


ORACLES |= {
    "detect_headings": with_views(
        f"""SELECT doc_id, line_no, length(t) >= 2 AND (starts_with(t, '#') OR ({_UPPER} AND length(t) >= 3 AND contains(t, ' ')) OR regexp_matches(t, '^(\\d+\\.)+\\s+[A-Z]') OR regexp_matches(t, '^[A-Z]\\.\\d+\\s+')
            OR (length(t) < 60 AND NOT contains('.,;:!?', right(t, 1)) AND {_CAPITAL.format('t')} AND len(w) >= 2 AND len([x for x in w if {_CAPITAL.format('x')}]) >= len(w) * 0.6 AND nxt <> '')) AS is_heading
            FROM (SELECT *, [x for x in regexp_split_to_array(t, '\\s+') if x <> ''] AS w, coalesce(lead(t) {_W}, '') AS nxt FROM s)""",
        _L,
        _S,
    ),
    "paragraph_groups": with_views("SELECT doc_id, CAST(i AS INT) AS section_no, CAST(NULL AS VARCHAR) AS heading, array_to_string(l[i * 4 + 1 : i * 4 + 4], chr(10) || chr(10)) AS content FROM (SELECT *, unnest(range(0, (len(l) - 1) // 4 + 1)) AS i FROM p)", _PARAGRAPHS),
    "guide_steps": with_views("SELECT doc_id, line_no, title, step, heading FROM steps WHERE head IS NULL", _L, _GUIDE),
    "step_images": with_views("SELECT doc_id, step, CAST(image_no AS INT) AS image_no, url FROM images", _L, _GUIDE, _IMAGES),
    "attach_images_to_chunks": with_views(
        "SELECT doc_id, 0 AS chunk_index, string_agg(url, '|' ORDER BY first) AS urls FROM v_manuals LEFT JOIN (SELECT doc_id, url, min((step, image_no)) AS first FROM images WHERE step IN (3, 4) GROUP BY 1, 2) USING (doc_id) GROUP BY doc_id", _L, _GUIDE, _IMAGES
    ),
    "soft_wrap_lines": with_views(
        f"""SELECT doc_id, line_no, line FROM (SELECT *, lag(line) {_W} AS before FROM ({_joined('marked', 'coalesce(lag_short, false) AND NOT hard')})) WHERE line <> '' OR before <> ''""",
        _L,
        _S,
        f"""kinds AS (SELECT doc_id, line_no, t AS line, t = '' OR starts_with(t, '#') OR regexp_matches(t, '(?i)^(?:\\[TABLE_PLACEHOLDER\\]|table:|image:|url:)') AS hard FROM s WHERE NOT regexp_matches(t, '(?i)^#?\\s*page\\s+\\d+$')),
        marked AS (SELECT *, lag(NOT hard AND len(regexp_split_to_array(line, '\\s+')) <= 6) {_W} AS lag_short FROM kinds)""",
    ),
    "normalize_pdf_markdown": with_views(
        _joined("marked", "plain AND coalesce(before, false)"),
        _L,
        _S,
        f"""plains AS (SELECT doc_id, line_no, t AS line, t <> '' AND NOT starts_with(t, '#') AS plain FROM s WHERE NOT {_hits("regexp_replace(t, '^#+\\s*', '')", L.CONTENTS)} AND NOT (regexp_matches(t, '^[\\d.\\-•*\\s]+$') AND length(t) <= 20 AND t <> '')),
        marked AS (SELECT *, lag(plain) {_W} AS before FROM plains)""",
    ),
    "merge_tables_into_pages": with_views(
        """SELECT doc_id, page, line_no, coalesce(rendered, line) AS line FROM marks LEFT JOIN tables USING (doc_id, page, n)
           UNION ALL SELECT doc_id, page, CAST(last + 1 + n - m AS INT), rendered FROM tables JOIN (SELECT doc_id, page, max(line_no) AS last, count(n) AS m FROM marks GROUP BY 1, 2) USING (doc_id, page) WHERE n >= m""",
        _L,
        "marks AS (SELECT doc_id, page, line_no, CASE WHEN mark THEN '[TABLE_PLACEHOLDER] ' || left(line, 5) ELSE line END AS line, CASE WHEN mark THEN count(CASE WHEN mark THEN 1 END) OVER (PARTITION BY doc_id, page ORDER BY line_no) - 1 END AS n FROM (SELECT doc_id, CAST(line_no // 10 AS INT) AS page, line_no, line, line_no % 3 = 0 AS mark FROM lines))",
        "tables AS (SELECT doc_id, CAST(line_no // 10 AS INT) AS page, row_number() OVER (PARTITION BY doc_id, line_no // 10 ORDER BY line_no) - 1 AS n, '| ' || line || ' |' AS rendered FROM lines WHERE line_no % 5 <= doc_id % 5)",
    ),
}

_UNITS = """units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, content, len([x for x in regexp_split_to_array(content, '\\s+') if x <> '']) AS n FROM
  (SELECT doc_id, i, regexp_replace(l[i], '^\\s+|\\s+$', '', 'g') AS content FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT source_id AS doc_id, string_split(raw_content, chr(10)) AS l FROM v_sources))) WHERE content <> '')"""
_PARTS = """units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, content, length(content) // 4 AS n FROM
  (SELECT doc_id, i, regexp_replace(l[i], '^\\s+|\\s+$', '', 'g') AS content FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(raw_content, '\\n\\s*\\n') AS l FROM v_manuals WHERE length(raw_content) // 4 > 700))) WHERE content <> '')"""


def _greedy(joins: str, cost: str = "u.n") -> str:
    """The greedy fold: a unit joins the chunk before it where ``joins`` holds for the chunk's cost ``c.size``."""
    return f"""packed AS ( /* recursive */ SELECT doc_id, i, 0 AS chunk, {cost} AS size, 1 AS steps FROM units u WHERE i = 1
      UNION ALL SELECT u.doc_id, u.i, CASE WHEN {joins} THEN c.chunk ELSE c.chunk + 1 END, CASE WHEN {joins} THEN c.size + {cost} ELSE {cost} END, CASE WHEN {joins} THEN c.steps + 1 ELSE 1 END
      FROM packed c JOIN units u ON u.doc_id = c.doc_id AND u.i = c.i + 1)"""


_CHUNKS = "SELECT doc_id, CAST(chunk AS INT) AS chunk_index, md5(string_agg(content, chr(10) || chr(10) ORDER BY i)) AS content FROM packed JOIN units USING (doc_id, i) GROUP BY 1, 2"
ORACLES |= {
    "combine_small_sections": with_views(_CHUNKS, _UNITS, _greedy("c.size < 180 OR c.size + u.n <= 450")),
    "merge_small_into_previous": with_views(_CHUNKS, _UNITS, _greedy("u.n * 13 // 10 < 80 AND c.size * 13 // 10 + u.n * 13 // 10 <= 600")),
    "segment_steps": with_views(_CHUNKS, _UNITS, _greedy("c.size + length(u.content) + 22 <= 1200", "(length(u.content) + 22)")),
    "split_oversized": with_views(_CHUNKS + " UNION ALL SELECT doc_id, 0, md5(raw_content) FROM v_manuals WHERE length(raw_content) // 4 <= 700", _PARTS, _greedy("c.size + u.n <= 700")),
}

_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_TITLED = "(length(x) BETWEEN 3 AND 80 AND NOT regexp_matches(x, '\\.\\s') AND regexp_matches(x, '^[\\p{Lu}\\d]') AND (len(w) >= 2 OR (x = upper(x) AND x <> lower(x))) AND len([y for y in w if length(y) > 3 AND y = lower(y) AND y <> upper(y)]) * 2 <= len(w) AND NOT starts_with(x, '#'))"
_USABLE = "length(h) >= 3 AND lower(h) NOT IN ('introduction', 'contents', 'table of contents', 'index', 'overview', 'untitled')"
_LIGHT_KIND = """CASE WHEN length(content) - length(replace(content, '|', '')) > 5 OR length(content) - length(replace(content, chr(9), '')) > 5 THEN 'table'
  WHEN len([x for x in string_split(content, chr(10)) if trim(x) <> '']) > 0 AND len([x for x in string_split(content, chr(10)) if regexp_matches(x, '^\\s*[•\\-*■●]')]) > 0.5 * len([x for x in string_split(content, chr(10)) if trim(x) <> '']) THEN 'list'
  WHEN length(regexp_replace(content, '\\P{Nd}', '', 'g')) > 0.3 * length(content) THEN 'reference' ELSE 'narrative' END"""
_NUMBER = "len([y for y in regexp_split_to_array({}, '\\s+') if y <> ''])"

ORACLES |= {
    "pack_embedding_batches": with_views(
        "SELECT doc_id AS family_id, chunk_id, CAST(chunk AS BIGINT) AS batch_no FROM packed JOIN units USING (doc_id, i)",
        "units AS (SELECT source_id % 3 AS doc_id, row_number() OVER (PARTITION BY source_id % 3 ORDER BY chunk_id) AS i, chunk_id, strlen(content) + token_count AS n FROM v_chunks)",
        _greedy("c.steps < 7 AND c.size + u.n <= 1200"),
    ),
    "pack_embedding_batches_words": with_views(
        "SELECT 'all' AS family_id, chunk_id, CAST(chunk AS BIGINT) AS batch_no FROM packed JOIN units USING (doc_id, i)",
        f"units AS (SELECT 0 AS doc_id, row_number() OVER (ORDER BY source_id % 97, source_id) AS i, source_id AS chunk_id, {_NUMBER.format('raw_content')} AS n FROM v_sources)",
        _greedy("c.steps < 20 AND c.size + u.n <= 3000"),
    ),
    "document_identifier": with_views(
        f"""SELECT source_id AS doc_id, coalesce([h for h in [{_TRIM.format("substr(x, 3)")} for x in l[:30] if starts_with(x, '# ')] if {_USABLE}][1], [h for h in [{_TRIM.format("substr(x, 4)")} for x in l[:30] if starts_with(x, '## ')] if {_USABLE}][1],
            (SELECT arg_min(x, i) FROM (SELECT i, l[i] AS x, regexp_split_to_array(l[i], '\\s+') AS w FROM unnest(range(1, least(len(l), 20) + 1)) t(i)) WHERE {_TITLED}), regexp_replace(title, '(?i)\\.pdf$', '')) AS identifier
            FROM (SELECT source_id, title, [{_TRIM.format("x")} for x in string_split(raw_content, chr(10))] AS l FROM v_sources)"""
    ),
    "step_overlap_segments": with_views(
        """SELECT doc_id, segment, trim('Guide: ' || any_value(title) || chr(10) || chr(10) || string_agg(CASE WHEN step > 0 THEN 'Step ' || step || ': ' ELSE '' END || heading || chr(10) || body || chr(10), chr(10) ORDER BY step), ' ' || chr(10)) AS content,
           string_agg(CASE WHEN step > 0 THEN CAST(step AS VARCHAR) END, ',' ORDER BY step) AS step_indices, array_to_string(list_distinct_in_order(list(heading ORDER BY step)), '|') AS headings
           FROM (SELECT * FROM items UNION ALL SELECT l.doc_id, l.segment + 1, l.step, l.heading, l.body, l.title FROM (SELECT * FROM items WHERE step > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, segment ORDER BY step DESC) = 1) l
             WHERE EXISTS (SELECT 1 FROM items i WHERE i.doc_id = l.doc_id AND i.segment = l.segment + 1)) GROUP BY doc_id, segment""".replace("list_distinct_in_order(list(heading ORDER BY step))", "list_reduce([[h] for h in list(heading ORDER BY step)], lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END)"),
        _L,
        _GUIDE,
        "items AS (SELECT doc_id, CAST(step // 4 AS INT) AS segment, step, coalesce(any_value(heading), 'Introduction') AS heading, CAST(count(*) AS VARCHAR) AS body, any_value(title) AS title FROM steps WHERE head IS NULL GROUP BY doc_id, step)",
    ),
}

#: Chunks of the final chunker, from whole texts.
_FINAL = (
    f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk, p) - 1 AS INT) AS chunk_index, heading, content, CAST({_NUMBER.format("content")} AS INT) AS token_count, {_LIGHT_KIND} AS content_type
            FROM (SELECT doc_id, chunk, p, CASE WHEN p = 0 THEN heading END AS heading, CASE WHEN n > 450 THEN array_to_string(w[p * 392 + 1 : p * 392 + 442], ' ') ELSE content END AS content
              FROM (SELECT *, unnest(range(0, CASE WHEN n > 450 THEN (n - 1) // 392 + 1 ELSE 1 END)) AS p FROM (SELECT *, len(w) AS n FROM (SELECT *, [x for x in regexp_split_to_array(content, '\\s+') if x <> ''] AS w
                FROM (SELECT doc_id, chunk, arg_min(heading, i) AS heading, string_agg(CASE WHEN opens THEN content ELSE coalesce(heading || chr(10), '') || content END, chr(10) || chr(10) ORDER BY i) AS content FROM packed JOIN units USING (doc_id, i) GROUP BY 1, 2)))))""",
        _L,
        _S,
        f"""plains AS (SELECT doc_id, line_no, t AS line, t <> '' AND NOT starts_with(t, '#') AS plain FROM s WHERE NOT {_hits("regexp_replace(t, '^#+\\s*', '')", L.CONTENTS)} AND NOT (regexp_matches(t, '^[\\d.\\-•*\\s]+$') AND length(t) <= 20 AND t <> '')),
        marked AS (SELECT *, lag(plain) {_W} AS before FROM plains), whole AS ({_joined("marked", "plain AND coalesce(before, false)")}),
        parted AS (SELECT *, sum(CAST(h AS INT)) {_W} AS section_no FROM (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+') AS h FROM whole)),
        kept AS (SELECT doc_id, section_no, max(CASE WHEN h THEN {_TRIM.format("line")} END) AS heading, {_TRIM.format("coalesce(string_agg(CASE WHEN NOT h THEN line END, chr(10) ORDER BY line_no), '')")} AS content FROM parted GROUP BY 1, 2),
        units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_no) AS i, heading, content, {_NUMBER.format("content")} AS n, {_NUMBER.format("coalesce(heading, '')")} AS h FROM kept WHERE content <> '')""",
        """packed AS ( /* recursive */ SELECT doc_id, i, 0 AS chunk, n AS size, true AS opens FROM units WHERE i = 1
          UNION ALL SELECT u.doc_id, u.i, CASE WHEN c.size < 180 OR c.size + u.n <= 450 THEN c.chunk ELSE c.chunk + 1 END, CASE WHEN c.size < 180 OR c.size + u.n <= 450 THEN c.size + u.n + u.h ELSE u.n END, NOT (c.size < 180 OR c.size + u.n <= 450)
          FROM packed c JOIN units u ON u.doc_id = c.doc_id AND u.i = c.i + 1)""",
)
_CHUNKED = (*_FINAL[1:], f"chunks AS ({_FINAL[0]})")
ORACLES |= {
    "chunk_documents_final": with_views(*_FINAL),
    "chunk_corpus_report": with_views(
        f"""SELECT doc_id, count(*) AS chunks, min(token_count) AS min_tokens, max(token_count) AS max_tokens, round(avg(token_count), 4) AS avg_tokens, count(heading) AS with_heading, CAST(sum(length(content)) AS BIGINT) AS chars,
            CAST(sum({_NUMBER.format("content")}) AS BIGINT) AS words, count_if(content_type = 'narrative') AS narrative, count_if(content_type <> 'narrative') AS other FROM chunks GROUP BY 1""",
        *_CHUNKED,
    ),
    "overlap_chunks": with_views(
        f"""SELECT doc_id, chunk_index, CASE WHEN has AND heading IS NULL AND head IS NOT NULL THEN 'Continued: ' || head WHEN has AND heading = head THEN 'Continued: ' || heading ELSE heading END AS heading,
           CASE WHEN has THEN lap || chr(10) || chr(10) || content ELSE content END AS content, has AS has_overlap, CASE WHEN has THEN n END AS overlap_tokens, CAST(length(CASE WHEN has THEN lap || chr(10) || chr(10) || content ELSE content END) // 4 AS INT) AS token_count
           FROM (SELECT *, coalesce(usable AND lap <> '', false) AS has FROM (SELECT *, {_TRIM.format("CASE WHEN stop > 0 AND stop - 1 < length(tail) // 2 AND stop + 1 < length(tail) THEN substr(tail, stop + 2) WHEN space > 1 AND space - 1 < length(tail) // 3 THEN substr(tail, space + 1) ELSE tail END")} AS lap
             FROM (SELECT *, instr(tail, '. ') AS stop, instr(tail, ' ') AS space FROM (SELECT *, n > 0 AND length(before) > n * 4 AS usable, CASE WHEN n > 0 THEN right(before, n * 4) ELSE '' END AS tail
               FROM (SELECT *, CAST(floor(length(before) // 4 * 0.15) AS INT) AS n FROM (SELECT *, lag(content) OVER o AS before, lag(heading) OVER o AS head FROM chunks WINDOW o AS (PARTITION BY doc_id ORDER BY chunk_index)))))))""",
        *_CHUNKED,
    ),
}

_STEPS = _GUIDE.replace("CASE WHEN starts_with(line, '1. ') THEN '## 3. Open it' WHEN line = 'SAFETY NOTES' THEN '## Close it' ELSE line END AS line", "line")
_BODY = _TRIM.format("regexp_replace(regexp_replace(coalesce(string_agg(CASE WHEN NOT noise THEN rtrim(line, ' ' || chr(9)) END, chr(10) ORDER BY line_no), ''), '\\[[^|\\]]+\\|[^|\\]]*\\|([^|\\]]+)\\]', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
_SAID = "[y for y in [regexp_replace(x, '^[-*•]\\s*', '') for x in [regexp_replace(z, '^\\s+|\\s+$', '', 'g') for z in string_split(body, chr(10))] if x <> '' AND NOT starts_with(x, '>')] if y <> ''][1]"
_FITS = "c.size + u.n <= 1200 AND c.steps + u.st <= 5"
ORACLES["content_type_histogram"] = with_views("SELECT content_type, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, content_type = 'narrative' AS embeddable FROM chunks GROUP BY 1", *_CHUNKED)
ORACLES["chunk_documents_guide"] = with_views(
    f"""SELECT doc_id, CAST(chunk AS INT) AS chunk_index, arg_min(heading, i) AS heading, '[Document: Manual ' || doc_id || ']' || chr(10) || chr(10) || {_TRIM.format("'Guide: Manual ' || doc_id || chr(10) || chr(10) || string_agg(CASE WHEN st = 1 THEN 'Step ' || step || ': ' ELSE '' END || heading || chr(10) || body, chr(10) || chr(10) ORDER BY i)")} AS content,
        CAST(3 + {_NUMBER.format(_TRIM.format("'Guide: Manual ' || doc_id || chr(10) || chr(10) || string_agg(CASE WHEN st = 1 THEN 'Step ' || step || ': ' ELSE '' END || heading || chr(10) || body, chr(10) || chr(10) ORDER BY i)"))} AS INT) AS token_count, 'narrative' AS content_type,
        coalesce(string_agg(CASE WHEN st = 1 THEN CAST(step AS VARCHAR) END, ',' ORDER BY i), '') AS step_indices, coalesce(string_agg(CASE WHEN st = 1 THEN urls END, '|' ORDER BY i), '') AS image_urls, 'Manual ' || doc_id AS document_title
        FROM (SELECT doc_id, chunk, i FROM packed UNION ALL SELECT doc_id, chunk + 1, max(i) FROM packed JOIN units USING (doc_id, i) WHERE st = 1 AND (doc_id, chunk + 1) IN (SELECT doc_id, chunk FROM packed) GROUP BY 1, 2) JOIN units USING (doc_id, i) GROUP BY doc_id, chunk""",
    "texts AS (SELECT doc_id, replace(replace(raw_content, '1. Setup', '## 3. Open it'), chr(10) || chr(10), chr(10) || '## Step 1' || chr(10)) AS raw_content FROM v_manuals)",
    _L.replace("FROM v_manuals", "FROM texts"),
    _STEPS,
    f"""marked AS (SELECT *, regexp_matches(line, '^\\s*!\\[.*\\]\\(') OR (starts_with(trim(line), '<!--') AND ends_with(trim(line), '-->')) AS noise, [x for x in regexp_extract_all(line, '!\\[.*?\\]\\((.*?)\\)', 1) if x <> ''] AS found FROM steps WHERE head IS NULL),
    bodies AS (SELECT doc_id, step, any_value(heading) AS heading, CASE WHEN step = 0 THEN {_TRIM.format("string_agg(line, chr(10) ORDER BY line_no)")} ELSE {_BODY} END AS body, string_agg(CASE WHEN len(found) > 0 THEN array_to_string(found, '|') END, '|' ORDER BY line_no) AS urls FROM marked GROUP BY doc_id, step),
    named AS (SELECT doc_id, step, CAST(step > 0 AS INT) AS st, body, urls, CASE WHEN step = 0 THEN 'Introduction' WHEN regexp_matches(heading, '(?i)^step\\s*\\d+$') THEN coalesce(left({_SAID}, 80), heading) ELSE heading END AS heading FROM bodies WHERE body <> ''),
    units AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS i, length(body) + length(heading) + 10 AS n FROM named)""",
    f"""packed AS ( /* recursive */ SELECT doc_id, i, 0 AS chunk, n AS size, st AS steps FROM units WHERE i = 1
      UNION ALL SELECT u.doc_id, u.i, CASE WHEN {_FITS} THEN c.chunk ELSE c.chunk + 1 END, CASE WHEN {_FITS} THEN c.size + u.n ELSE u.n END, CASE WHEN {_FITS} THEN c.steps + u.st ELSE u.st END FROM packed c JOIN units u ON u.doc_id = c.doc_id AND u.i = c.i + 1)""",
)
