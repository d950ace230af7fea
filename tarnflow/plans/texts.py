"""Queries that apply the text functions to whole tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.adapters import view, with_views


def _on(name: str, key: str, **columns):
    return lambda s, d: view(s, d, name).select(key, *[c().alias(k) for k, c in columns.items()])


_raw = lambda: F.col("raw_content")
_signals = lambda: T.content_signals(_raw(), T.image_urls(_raw()))
_rounded = lambda s, c: F.round(s[c], 6).alias(c)


def _with_signals(*make):
    def run(s, d):
        rows = view(s, d, "v_manuals").select("doc_id", "raw_content", _signals().alias("s"))
        return rows.select("doc_id", *[m() for m in make])

    return run


_S = lambda: F.col("s")
QUERIES = {
    "word_count": _on("v_sources", "source_id", words=lambda: T.word_count(_raw())),
    "token_estimate": _on("v_sources", "source_id", chars4=lambda: T.token_estimate(_raw()), words13=lambda: T.token_estimate(_raw(), "words13"), words=lambda: T.token_estimate(_raw(), "words")),
    "content_signals": _with_signals(lambda: _S()["word_count"].alias("word_count"), lambda: _S()["sentence_count"].alias("sentence_count"), lambda: _rounded(_S(), "alpha_ratio"), lambda: _rounded(_S(), "numeric_ratio"), lambda: _rounded(_S(), "table_density"), lambda: _S()["has_images"].alias("has_images")),
    "content_type": _with_signals(lambda: T.content_type(_S(), _raw()).alias("kind")),
    "should_embed": _with_signals(lambda: T.should_embed(_S(), T.content_type(_S(), _raw())).alias("embed")),
    "content_type_light": _on("v_sources", "source_id", kind=lambda: T.content_type_light(_raw())),
    "is_table_block": _on("v_sources", "source_id", is_table=lambda: T.is_table_block(_raw())),
    "heading_level": _on("v_chunks", "chunk_id", level=lambda: T.heading_level(F.col("token_count") / 10)),
    "extract_images": _on("v_manuals", "doc_id", urls=lambda: F.array_join(T.image_urls(_raw()), "|"), text=lambda: T.without_images(_raw())),
    "normalize_heading": _on("v_models", "model_id", heading=lambda: T.normalize_heading(F.concat(F.when(F.col("model_id") % 3 == 0, "## Page ").when(F.col("model_id") % 3 == 1, "# Figure #").otherwise("#"), F.col("title")))),
    "display_heading": _on("v_manuals", "doc_id", heading=lambda: T.display_heading(F.when(F.col("doc_id") % 2 == 0, "Step 4").otherwise("Other"), F.regexp_replace(_raw(), "^# Manual", "> quoted\n- Manual"))),
    "clean_guide_body": _on("v_manuals", "doc_id", body=lambda: T.clean_guide_body(F.concat(F.lit("[link|x|shown]  \n\n\n\n"), _raw()))),
    "normalize_whitespace": _on("v_manuals", "doc_id", universal=lambda: T.normalize_whitespace(_raw()), light=lambda: T.normalize_whitespace(_raw(), "light"), query=lambda: T.normalize_whitespace(_raw(), "query")),
    "prepare_embedding_text": _on("v_chunks", "chunk_id", text=lambda: T.prepare_embedding_text(F.concat(F.lit("  a \n\n b "), F.col("content")), F.col("heading"), F.col("chunk_id") % 2 == 0, F.col("chunk_id") % 3 == 0)),
    "split_sentences": _on("v_manuals", "doc_id", n=lambda: F.size(T.split_sentences(_raw()))),
    "normalize_url": _on("v_models", "model_id", url=lambda: T.normalize_url(F.when(F.col("model_id") % 4 == 0, "").when(F.col("model_id") % 4 == 1, F.concat(F.lit("/g/"), F.col("model_id").cast("string"))).when(F.col("model_id") % 4 == 2, "http://x.example/a").otherwise("rel"), "https://base.example")),
    "split_manufacturer": _on("v_models", "model_id", manufacturer=lambda: T.split_manufacturer(F.when(F.col("model_id") % 5 == 0, "Single").otherwise(F.col("title")))["manufacturer"], number=lambda: T.split_manufacturer(F.col("title"))["model_number"]),
    "uuid5": _on("v_models", "model_id", id=lambda: T.uuid5(F.concat(F.lit("catalog/model/"), F.col("path")))),
    "split_sentences_list": _on("v_manuals", "doc_id", sentences=lambda: F.array_join(T.split_sentences(F.replace(_raw(), F.lit("SAFETY NOTES"), F.lit("SAFETY NOTES\n- one thing. Two\n- three"))), "|")),
    "vector_literal": _on("v_chunks", "chunk_id", literal=lambda: T.vector_literal(F.transform("embedding", lambda x: F.floor(x.cast("float") * F.lit(100).cast("float")).cast("int")))),
    "sanitize_vector": _on("v_chunks", "chunk_id", size=lambda: F.size(T.sanitize_vector(F.col("embedding"), 64)), total=lambda: F.round(F.aggregate(T.sanitize_vector(F.transform("embedding", lambda x: F.when(x > 0.1, F.lit(float("nan")).cast("float")).otherwise(x)), 64), F.lit(0.0), lambda a, x: a + x.cast("double")), 4)),
    "mock_embedding": _on("v_chunks", "chunk_id", first=lambda: F.get(T.mock_embedding(F.col("content"), 8), F.lit(0)), last=lambda: F.get(T.mock_embedding(F.col("content"), 8), F.lit(7))),
    "fallback_title": _on("v_messages", "message_id", short=lambda: T.fallback_title(F.when(F.col("turn") == 0, " ").otherwise(F.col("content")), F.col("message_id") % 2 == 0), long=lambda: T.fallback_title(F.col("content"), F.lit(False), 60)),
    "prefix_document_title": _on("v_chunks", "chunk_id", text=lambda: T.prefix_document_title(F.col("content"), F.col("heading"))),
}

_SP = "[ \\t\\n\\r\\f\\v]"
_WORDS = f"len([w for w in regexp_split_to_array(raw_content, '{_SP}+') if w <> ''])"
_SIG = f"""sig AS (SELECT *, CASE WHEN found = 0 AND word_count > 0 THEN 1 ELSE found END AS sentence_count FROM (
  SELECT doc_id, raw_content, {_WORDS} AS word_count, len(regexp_extract_all(raw_content, '[.!?]+')) AS found,
    len(regexp_extract_all(raw_content, '\\p{{L}}')) / length(raw_content) AS alpha_ratio, len(regexp_extract_all(raw_content, '\\p{{Nd}}')) / length(raw_content) AS numeric_ratio,
    len([x for x in string_split(raw_content, chr(10)) if regexp_matches(x, '\\S+\\s{{3,}}\\S+\\s{{3,}}\\S+') OR contains(x, chr(9)) OR contains(x, '|')]) / len(string_split(raw_content, chr(10))) AS table_density,
    true AS has_images, lower(raw_content) AS low FROM v_manuals))"""
_KIND = """kinds AS (SELECT *, CASE WHEN has_images AND word_count < 20 THEN 'image_only' WHEN table_density >= 0.4 THEN 'table'
  WHEN numeric_ratio > 0.3 OR contains(low, '...') OR contains(low, '. . .') OR (contains(low, 'issue') AND regexp_matches(low, '\\d{4}') AND word_count < 50) OR contains(low, 'copyright') OR contains(low, '©')
    OR (word_count < 30 AND sentence_count < 2) OR alpha_ratio < 0.5 THEN 'reference'
  WHEN sentence_count >= 2 AND alpha_ratio >= 0.65 AND numeric_ratio <= 0.3 THEN 'narrative' ELSE 'reference' END AS kind FROM sig)"""
_trim = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_hex = lambda x: f"CAST('0x' || {x} AS UBIGINT)"

_PLAIN = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_SENTENCES = f"""[z for z in [{_PLAIN.format('y')} for y in flatten([CASE WHEN regexp_matches(q, '(?m)^\\s*(?:[•\\-*■●]|\\d+\\.)\\s') THEN string_split(q, chr(10)) ELSE string_split(regexp_replace(q, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) END
  for q in [{_PLAIN.format('x')} for x in regexp_split_to_array(raw_content, '\\n\\s*\\n')] if q <> ''])] if z <> '']"""
_SPLIT = f"SELECT doc_id, CAST(len({_SENTENCES}) AS INT) AS n FROM v_manuals"
ORACLES = {
    "word_count": with_views(f"SELECT source_id, {_WORDS} AS words FROM v_sources"),
    "token_estimate": with_views(f"SELECT source_id, CAST(floor(length(raw_content) / 4.0) AS INT) AS chars4, CAST(floor({_WORDS} * 13 / 10.0) AS INT) AS words13, {_WORDS} AS words FROM v_sources"),
    "content_signals": with_views("SELECT doc_id, word_count, sentence_count, round(alpha_ratio, 6) AS alpha_ratio, round(numeric_ratio, 6) AS numeric_ratio, round(table_density, 6) AS table_density, has_images FROM sig", _SIG),
    "content_type": with_views("SELECT doc_id, kind FROM kinds", _SIG, _KIND),
    "should_embed": with_views("SELECT doc_id, kind = 'narrative' AND word_count >= 20 AND ((sentence_count >= 2 AND alpha_ratio >= 0.6 AND numeric_ratio <= 0.4) OR (word_count >= 50 AND alpha_ratio >= 0.7 AND sentence_count >= 1)) AS embed FROM kinds", _SIG, _KIND),
    "content_type_light": with_views(
        """SELECT source_id, CASE WHEN len(regexp_extract_all(raw_content, '\\|')) > 5 OR len(regexp_extract_all(raw_content, '\\t')) > 5 THEN 'table' WHEN len(lines) > 0 AND len([x for x in lines if regexp_matches(x, '^\\s*[•\\-*■●]')]) > 0.5 * len(lines) THEN 'list'
           WHEN len(regexp_extract_all(raw_content, '\\p{Nd}')) > 0.3 * length(raw_content) THEN 'reference' ELSE 'narrative' END AS kind FROM (SELECT *, [x for x in string_split(raw_content, chr(10)) if trim(x) <> ''] AS lines FROM v_sources)"""
    ),
    "heading_level": with_views("SELECT chunk_id, CASE WHEN token_count / 10.0 >= 18 THEN '# ' WHEN token_count / 10.0 >= 14 THEN '## ' WHEN token_count / 10.0 >= 12 THEN '### ' ELSE '' END AS level FROM v_chunks"),
    "extract_images": with_views(f"SELECT doc_id, 'http://img.example.com/' || doc_id || '.png' AS urls, {_trim("regexp_replace(raw_content, '!\\[[^\\]]*\\]\\(([^)]+)\\)', '', 'g')")} AS text FROM v_manuals"),
    "normalize_heading": with_views("SELECT model_id, CASE WHEN model_id % 3 = 0 THEN 'Page ' || title WHEN model_id % 3 = 1 THEN 'Figure #' || title ELSE title END AS heading FROM v_models"),
    "display_heading": with_views("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Manual ' || doc_id ELSE 'Other' END AS heading FROM v_manuals"),
    "normalize_whitespace": with_views(
        f"""SELECT doc_id, regexp_replace(regexp_replace(raw_content, '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g'), ' +', ' ', 'g') AS universal,
            regexp_replace(regexp_replace(regexp_replace(raw_content, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g') AS light, {_trim(f"regexp_replace(raw_content, '{_SP}+', ' ', 'g')")} AS query FROM v_manuals"""
    ),
    "prepare_embedding_text": with_views(
        """SELECT chunk_id, CASE WHEN heading IS NOT NULL THEN '[Section: ' || heading || '] ' ELSE '' END || CASE WHEN chunk_id % 2 = 0 THEN '[Procedure/Instructions] ' ELSE '' END
           || CASE WHEN chunk_id % 3 = 0 THEN '[Table/Data] ' ELSE '' END || 'a b ' || content AS text FROM v_chunks"""
    ),
    "normalize_url": with_views("SELECT model_id, CASE model_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'https://base.example/g/' || model_id WHEN 2 THEN 'http://x.example/a' ELSE 'rel' END AS url FROM v_models"),
    "split_manufacturer": with_views("SELECT model_id, CASE WHEN model_id % 5 <> 0 AND contains(title, ' ') THEN split_part(title, ' ', 1) END AS manufacturer, title AS number FROM v_models"),
    "uuid5": with_views(
        """SELECT model_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE WHEN substr(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9' WHEN substr(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END
           || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM (SELECT model_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('catalog/model/' || path)) AS h FROM v_models)"""
    ),
    "vector_literal": with_views("SELECT chunk_id, CASE WHEN embedding IS NOT NULL THEN '[' || array_to_string([CAST(floor(CAST(x AS FLOAT) * 100) AS INT) for x in embedding], ',') || ']' END AS literal FROM v_chunks"),
    "split_sentences_list": with_views(
        f"SELECT doc_id, coalesce(array_to_string({_SENTENCES}, '|'), '') AS sentences FROM (SELECT doc_id, replace(raw_content, 'SAFETY NOTES', 'SAFETY NOTES' || chr(10) || '- one thing. Two' || chr(10) || '- three') AS raw_content FROM v_manuals)"
    ),
    "split_sentences": with_views(_SPLIT),
    "sanitize_vector": with_views("SELECT chunk_id, CASE WHEN embedding IS NOT NULL THEN len(embedding) END AS size, round(list_sum([CASE WHEN x > CAST(0.1 AS DOUBLE) THEN 0.0 ELSE CAST(x AS DOUBLE) END for x in embedding]), 4) AS total FROM v_chunks"),
    "mock_embedding": with_views(
        f"""SELECT chunk_id, b / 1000.0 AS first, ((b + 7) % 1000) / 1000.0 AS last FROM (SELECT chunk_id, CAST((({_hex('substr(h, 1, 16)')} % 1000) * 616 + {_hex('substr(h, 17, 16)')} % 1000) % 1000 AS INT) AS b FROM (SELECT chunk_id, md5(content) AS h FROM v_chunks))"""
    ),
    "fallback_title": with_views(
        """SELECT message_id, CASE WHEN turn = 0 THEN CASE WHEN message_id % 2 = 0 THEN 'Image Analysis' ELSE 'New Chat' END WHEN trim(content) = '' THEN CASE WHEN message_id % 2 = 0 THEN 'Image Analysis' ELSE 'New Chat' END WHEN length(trim(content)) > 50 THEN left(trim(content), 50) || '...' ELSE trim(content) END AS short,
           CASE WHEN trim(content) = '' THEN 'New Chat' WHEN length(trim(content)) > 60 THEN left(trim(content), 57) || '...' ELSE trim(content) END AS long FROM v_messages"""
    ),
    "prefix_document_title": with_views("SELECT chunk_id, CASE WHEN heading IS NULL THEN content ELSE '[Document: ' || heading || ']' || chr(10) || chr(10) || content END AS text FROM v_chunks"),
}

_NUMBER = "regexp_matches(x, '^[\\d.,%\\-+/ ]+$')"
ORACLES |= {
    "clean_guide_body": with_views(
        f"SELECT doc_id, {_trim("regexp_replace(regexp_replace(array_to_string([regexp_replace(x, '\\s+$', '') for x in string_split('[link|x|shown]  ' || repeat(chr(10), 4) || raw_content, chr(10))], chr(10)), '\\[[^|\\]]+\\|[^|\\]]*\\|([^|\\]]+)\\]', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS body FROM v_manuals"
    ),
    "is_table_block": with_views(
        f"""SELECT source_id, len(l) >= 4 AND ((len([x for x in l[1:5] if regexp_matches(x, '(?i)\\b(?:item|qty|quantity|part|description|no|number|unit|price|total)\\b')]) >= 2 AND len([x for x in l if {_NUMBER}]) >= 0.3 * len(l))
            OR len([x for x in l if NOT regexp_matches(x, '\\s')]) >= 0.6 * len(l) OR (len(places) = 3 AND len([i for i in places if i % 3 = 2]) = 3 AND len(l) >= 6)) AS is_table
            FROM (SELECT *, [i for i in range(0, len(l)) if regexp_matches(l[i + 1], '^[\\d.,%\\-+/ ]+$')][1:3] AS places FROM (SELECT source_id, [x for x in [regexp_replace(y, '^\\s+|\\s+$', '', 'g') for y in string_split(raw_content, chr(10))] if x <> ''] AS l FROM v_sources))"""
    ),
}
