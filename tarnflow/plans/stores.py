"""Queries over stored sources, chunks and catalog rows: retrieval, keyed writes and audits, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import new_folder
from ..operators import merge as M
from ..operators import quality as Q
from ..operators import retrieval as R
from ..sources import stores
from ..sources.adapters import view, with_views


def _v(s, d, *names):
    return [view(s, d, n) for n in names]


def _rag(op, *args, **kw):
    def run(s, d):
        out = op(*_v(s, d, "v_queries", "v_chunks", "v_sources"), *args, **kw)
        return out.select("query_id", "chunk_id", "rank", F.round("similarity", 4).alias("similarity"))

    return run


def _hits(s, d):
    hits = R.cosine_top_k(*_v(s, d, "v_queries", "v_chunks", "v_sources"), k=5, threshold=0.6)
    return hits.join(view(s, d, "v_queries").select("query_id", "user_id"), "query_id")


def _context(s, d):
    rows = _hits(s, d).join(view(s, d, "v_chunks").select("chunk_id", "source_id", "chunk_index", "heading", "content"), "chunk_id")
    return R.prompt_context(rows)


def _voice(s, d):
    return R.voice_context(_hits(s, d).join(view(s, d, "v_chunks").select("chunk_id", "heading", "content"), "chunk_id"))


def _families(s, d):
    target = view(s, d, "v_models").groupBy("family_id").agg(F.first("family_name").alias("name")).select("family_id", "name", F.when(F.col("family_id").endswith("1"), F.lit("old text")).alias("description"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")).alias("metadata"))
    keys = view(s, d, "v_models").select("model_id", F.when(F.col("model_id") % 3 == 0, F.concat(F.lit("New#"), (F.col("model_id") % 10).cast("string"))).otherwise(F.col("family_id")).alias("family_id")).filter("model_id % 2 = 0")
    updates = keys.select("family_id", F.col("model_id").alias("seq"), F.concat(F.lit("name "), F.col("model_id").cast("string")).alias("name"), F.when(F.col("model_id") % 4 == 0, F.concat(F.lit("text "), F.col("model_id").cast("string"))).alias("description"), F.create_map(F.lit("b"), F.lit("9"), F.lit("c"), F.lit("3")).alias("metadata"))
    out = M.upsert_families(target, updates)
    return out.select("family_id", "name", "description", F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("metadata"))


def _models(s, d):
    target = view(s, d, "v_models").filter("model_id % 2 = 0").select("model_id", "family_id", "title", F.lit(None).cast("string").alias("description"), F.create_map(F.lit("a"), F.lit("1")).alias("metadata"))
    updates = view(s, d, "v_models").filter("model_id % 3 = 0").select("model_id", F.lit(1).alias("seq"), F.lit("other").alias("family_id"), F.when(F.col("model_id") % 4 != 0, F.upper("title")).alias("title"), F.lit("d").alias("description"), F.create_map(F.lit("a"), F.lit("2")).alias("metadata"))
    return M.upsert_models(target, updates).select("model_id", "family_id", "title", "description", F.col("metadata")["a"].alias("a"))


def _sources(s, d):
    return _source_columns(M.upsert_sources(*_source_rows(s, d)))


def _source_rows(s, d):
    device = lambda m, v: F.struct(m.cast("long").alias("model_id"), F.lit(v).alias("path"))
    i = F.col("source_id")
    target = view(s, d, "v_sources").filter("source_id % 2 = 0").select("source_id", "title", "raw_content", "model_id", F.array(device(i % 3, "old"), device(i % 5 + 10, "old")).alias("devices"))
    updates = view(s, d, "v_sources").select("source_id", F.lit(1).alias("seq"), F.when(i % 3 == 0, F.lit("")).otherwise(F.lit("new title")).alias("title"), F.lit("").alias("raw_content"), F.lit(None).cast("long").alias("model_id"), F.array(device(i % 3, "new")).alias("devices"))
    more = updates.filter("source_id % 4 = 0").withColumn("seq", F.lit(2)).withColumn("title", F.lit("last title")).withColumn("devices", F.array(device(F.lit(99), "more")))
    return target, updates.unionByName(more)


def _source_columns(out):
    return out.select("source_id", "title", F.length("raw_content").alias("chars"), "model_id", F.array_join(F.transform("devices", lambda x: F.concat(x["model_id"].cast("string"), F.lit(":"), x["path"])), ",").alias("devices"))


def _new_chunks(s, d):
    return view(s, d, "v_chunks").filter("source_id % 3 = 0 AND chunk_index < 2").withColumn("content", F.lit("new")).unionByName(view(s, d, "v_chunks").filter("source_id = 5").withColumn("source_id", F.lit(100000).cast("long")))


def _embedded(s, d):
    return _embedding_columns(M.apply_embeddings(view(s, d, "v_chunks"), _new_vectors(s, d), 64))


def _new_vectors(s, d):
    return view(s, d, "v_chunks").filter("chunk_id % 2 = 1").select("chunk_id", F.when(F.col("chunk_id") % 3 == 0, F.array_repeat(F.lit(1.0).cast("float"), 3)).otherwise(F.array_repeat(F.lit(1.0).cast("float"), 64)).alias("new"))


def _embedding_columns(out):
    return out.select("chunk_id", F.size("embedding").alias("dims"), F.coalesce(F.forall("embedding", lambda x: x == 1.0), F.lit(False)).alias("is_new"))


def _stored(rows, key, write):
    """``rows`` as a stored table, after ``write``; the write is done twice, as after a failure."""

    def run(s, d):
        path = new_folder(s) + "/store"
        stores.create_store(rows(s, d), path, key, 16)
        for _ in range(2):
            write(s, d, path)
        return stores.read_store(s, path)

    return run


def _stored_sources(s, d):
    target, updates = _source_rows(s, d)
    out = _stored(lambda s, d: target, "source_id", lambda s, d, path: stores.write_sources(s, path, "new", updates))(s, d)
    return _source_columns(out)


def _stored_chunks(s, d):
    return _stored(lambda s, d: view(s, d, "v_chunks"), "source_id", lambda s, d, path: stores.write_chunks(s, path, "new", _new_chunks(s, d)))(s, d).select("source_id", "chunk_index", "content")


def _stored_embeddings(s, d):
    out = _stored(lambda s, d: view(s, d, "v_chunks"), "source_id", lambda s, d, path: stores.write_embeddings(s, path, "new", _new_vectors(s, d), 64))(s, d)
    return _embedding_columns(out)


def _wrong(s, d):
    return M.wrong_dimensions(view(s, d, "v_chunks").select("chunk_id", F.when(F.col("chunk_id") % 3 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("new")), 64)


def _cascade(s, d):
    tables = dict(zip(("users", "sessions", "messages", "subscriptions", "uploads", "sources"), _v(s, d, "v_users", "v_sessions", "v_messages", "v_subscriptions", "v_uploads", "v_sources"), strict=True))
    tables["settings"] = tables["users"].select("user_id", F.lit("dark").alias("theme"))
    tables["attachments"] = tables["messages"].filter("turn % 2 = 0").select((F.col("message_id") + 5).alias("attachment_id"), "message_id")
    tables["analyses"] = tables["attachments"].select((F.col("attachment_id") * 2).alias("analysis_id"), "attachment_id")
    out = M.cascade_delete(tables, view(s, d, "v_users").filter("user_id % 3 = 0").select("user_id"))
    rows = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count(next(c for c in ("user_id", "session_id", "message_id", "attachment_id") if c in df.columns)).alias("owned")) for name, df in out.items()]
    first = rows[0]
    for r in rows[1:]:
        first = first.unionByName(r)
    return first


def _deleted(s, d):
    linked = F.when(F.col("source_id") % 5 == 0, F.col("source_id") + 1)
    uploads = view(s, d, "v_sources").filter("user_id IS NOT NULL").select((F.col("source_id") + 7).alias("upload_id"), "user_id", F.col("title").alias("file_name"), linked.alias("source_id"))
    kept = M.delete_documents(uploads, view(s, d, "v_sources"), view(s, d, "v_chunks"), uploads.filter("upload_id % 2 = 0").select("upload_id"))
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in zip(("uploads", "sources", "chunks"), kept, strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def _with_metadata(s, d):
    i = F.col("source_id")
    text = F.when(i % 7 == 0, F.lit("{bad")).when(i % 7 == 1, F.lit('{"guide_id": null, "tools": null}')).when(i % 7 == 2, F.lit(None)).otherwise(F.concat(F.lit('{"guide_id": '), i.cast("string"), F.lit(', "url": "u", "parts": []}')))
    return view(s, d, "v_sources").withColumn("metadata", text)


def _issues(s, d):
    models = view(s, d, "v_models")
    families = models.select("family_id", F.when(F.col("family_id").endswith("2"), F.lit(" ")).otherwise(F.col("family_name")).alias("family_name")).distinct().filter("family_id <> 'Brand#11'").unionByName(models.limit(0).select("family_id", "family_name"))
    lone = families.limit(0).sparkSession.range(1).select(F.lit("Lone").alias("family_id"), F.lit("lone maker").alias("family_name"))
    return Q.validation_issues(families.unionByName(lone), models, _with_metadata(s, d))


QUERIES = {
    "visible_chunks": lambda s, d: R.visible_chunks(*_v(s, d, "v_chunks", "v_sources"), 3).select("chunk_id", "source_id"),
    "visible_chunks_voice": lambda s, d: R.visible_chunks(*_v(s, d, "v_chunks", "v_sources"), 3, "voice").select("chunk_id", "source_id"),
    "cosine_top_k": _rag(R.cosine_top_k, 10, 0.6),
    "cosine_top_k_scoped": _rag(R.cosine_top_k_scoped, 4, 3),
    "cosine_top_k_soft": _rag(R.cosine_top_k_soft, 10, 0.4, 3),
    "ann_top_k": _rag(R.ann_top_k, 10, 0.6),
    "expand_adjacent_chunks": lambda s, d: R.expand_adjacent_chunks(_hits(s, d), *_v(s, d, "v_chunks", "v_sources")),
    "prompt_context": _context,
    "voice_context": _voice,
    "upsert_families": _families,
    "upsert_models": _models,
    "upsert_sources": _sources,
    "insert_if_absent": lambda s, d: M.insert_if_absent(view(s, d, "v_chunks").filter("chunk_id % 2 = 0"), view(s, d, "v_chunks").withColumn("content", F.lit("late")), ["source_id", "chunk_index"]).select("chunk_id", "content"),
    "replace_source_chunks": lambda s, d: M.replace_source_chunks(view(s, d, "v_chunks"), _new_chunks(s, d)).select("source_id", "chunk_index", "content"),
    "replace_source_chunks_refusing": lambda s, d: M.refused_sources(view(s, d, "v_chunks"), _new_chunks(s, d)),
    "apply_embeddings": _embedded,
    "upsert_sources_stored": _stored_sources,
    "replace_source_chunks_stored": _stored_chunks,
    "apply_embeddings_stored": _stored_embeddings,
    "wrong_dimensions": _wrong,
    "cascade_delete": _cascade,
    "delete_documents": _deleted,
    "new_keys": lambda s, d: M.new_keys(view(s, d, "v_chunks").select("source_id", (F.col("chunk_index") + 2).alias("chunk_index")), view(s, d, "v_chunks"), ["source_id", "chunk_index"]),
    "dedupe_keep_first": lambda s, d: M.dedupe_keep_first(view(s, d, "v_models"), ["family_id"], [F.col("model_id").desc()]).select("family_id", "model_id"),
    "orphans": lambda s, d: Q.orphans(*_v(s, d, "v_sources", "v_models"), "model_id", "model_id").select("source_id", "model_id"),
    "parents_without_children": lambda s, d: Q.parents_without_children(view(s, d, "v_users"), view(s, d, "v_sessions"), "user_id").select("user_id"),
    "chunk_source_stats": lambda s, d: Q.chunk_source_stats(view(s, d, "v_chunks")),
    "chunk_quality_audit": lambda s, d: Q.chunk_quality_audit(view(s, d, "v_manuals").select(F.col("raw_content").alias("content"), F.length("raw_content").alias("token_count"))),
    "content_length_stats": lambda s, d: Q.content_length_stats(view(s, d, "v_sources"), "pdf"),
    "field_completeness": lambda s, d: Q.field_completeness(view(s, d, "v_sources")),
    "content_structure": lambda s, d: Q.content_structure(view(s, d, "v_manuals")),
    "metadata_completeness": lambda s, d: Q.metadata_completeness(_with_metadata(s, d)),
    "validation_issues": _issues,
    "validation_summary": lambda s, d: Q.validation_summary(_issues(s, d)),
    "validation_stats": lambda s, d: Q.validation_stats(view(s, d, "v_models").select("family_id", "family_name").distinct(), view(s, d, "v_models"), _with_metadata(s, d)),
    "keyword_inventory": lambda s, d: Q.keyword_inventory(*_v(s, d, "v_sources", "v_models"), view(s, d, "v_models").select("family_id", F.col("family_name").alias("name")).distinct(), view(s, d, "v_chunks"), "3"),
    "reconcile_counts": lambda s, d: Q.reconcile_counts(view(s, d, "v_sources").select("source_id", F.lit(5).cast("long").alias("expected")), view(s, d, "v_chunks").filter("chunk_id % 9 <> 0"), "source_id"),
    "top_documents": lambda s, d: Q.top_documents(*_v(s, d, "v_sources", "v_models"), 5),
    "top_documents_like": lambda s, d: Q.top_documents(_with_metadata(s, d), view(s, d, "v_models"), 4, "words", "DOC-1%"),
    "size_bucket_sample": lambda s, d: Q.size_bucket_sample(view(s, d, "v_sources")),
    "edge_case_sample": lambda s, d: Q.edge_case_sample(view(s, d, "v_sources").withColumn("raw_content", F.when(F.col("source_id") % 3 == 0, F.concat(F.lit("## 1. one\n"), "raw_content")).when(F.col("source_id") % 3 == 1, F.replace("raw_content", F.lit(". "), F.lit(".\n## "))).otherwise(F.col("raw_content"))), 2),
    "filter_chunks_by_words": lambda s, d: Q.filter_chunks_by_words(view(s, d, "v_sources").withColumn("content", F.col("raw_content")), 50, 300).select("source_id"),
    "embedding_ingest_stats": lambda s, d: Q.embedding_ingest_stats(view(s, d, "v_chunks").select((F.col("chunk_id") % 4).alias("batch_no"), F.when(F.col("embedding").isNull(), F.lit("missing")).alias("error"))),
}

_SCORES = """scored AS (SELECT q.query_id, q.user_id, c.chunk_id, c.source_id, s.user_id AS owner, list_inner_product(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(c.embedding, lambda x: CAST(x AS DOUBLE)))
  / sqrt(list_inner_product(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(q.embedding, lambda x: CAST(x AS DOUBLE))) * list_inner_product(list_transform(c.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(c.embedding, lambda x: CAST(x AS DOUBLE)))) AS sim
  FROM v_queries q, v_chunks c JOIN v_sources s ON s.source_id = c.source_id WHERE c.embedding IS NOT NULL AND q.embedding IS NOT NULL)"""
_TOP = "SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, round(sim, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM scored WHERE {}) WHERE rank <= {}"
_HITS = "hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM scored WHERE (owner IS NULL OR owner = user_id) AND sim > 0.4) WHERE rank <= 5)"
_META = """meta AS (SELECT *, CASE source_id % 7 WHEN 0 THEN '{bad' WHEN 1 THEN '{"guide_id": null, "tools": null}' WHEN 2 THEN NULL ELSE '{"guide_id": ' || source_id || ', "url": "u", "parts": []}' END AS metadata FROM v_sources)"""
_ISSUES = """families AS (SELECT DISTINCT family_id, CASE WHEN family_id LIKE '%2' THEN ' ' ELSE family_name END AS family_name FROM v_models WHERE family_id <> 'Brand#11' UNION ALL SELECT 'Lone', 'lone maker'),
issues AS (SELECT *, type || ' in ' || section || ' ' || id AS message FROM (
  SELECT 'families' AS section, 'missing_name' AS type, family_id AS id FROM families WHERE trim(family_name) = ''
  UNION ALL SELECT 'models', 'orphaned_model', CAST(model_id AS VARCHAR) FROM v_models WHERE family_id NOT IN (SELECT family_id FROM families)
  UNION ALL SELECT 'sources', 'missing_content', CAST(source_id AS VARCHAR) FROM meta WHERE coalesce(raw_content, '') = ''
  UNION ALL SELECT 'sources', 'short_content', CAST(source_id AS VARCHAR) FROM meta WHERE raw_content <> '' AND length(regexp_replace(raw_content, '^\\s+|\\s+$', '', 'g')) < 10
  UNION ALL SELECT 'sources', 'missing_metadata', CAST(source_id AS VARCHAR) FROM meta WHERE metadata IS NULL
  UNION ALL SELECT 'sources', 'invalid_metadata', CAST(source_id AS VARCHAR) FROM meta WHERE source_id % 7 = 0
  UNION ALL SELECT 'sources', 'orphaned_source', CAST(source_id AS VARCHAR) FROM meta WHERE model_id IS NOT NULL AND model_id NOT IN (SELECT model_id FROM v_models)
  UNION ALL SELECT 'families', 'family_without_models', family_id FROM families WHERE family_id NOT IN (SELECT family_id FROM v_models)))"""
_words = "len([w for w in regexp_split_to_array(raw_content, '\\s+') if w <> ''])"

ORACLES = {
    "visible_chunks": with_views("SELECT chunk_id, source_id FROM v_chunks JOIN v_sources s USING (source_id) WHERE embedding IS NOT NULL AND (s.user_id IS NULL OR s.user_id = 3)"),
    "visible_chunks_voice": with_views("SELECT chunk_id, source_id FROM v_chunks JOIN v_sources s USING (source_id) WHERE embedding IS NOT NULL AND s.user_id = 3"),
    "cosine_top_k": with_views(_TOP.format("(owner IS NULL OR owner = user_id) AND sim > 0.4", 10), _SCORES),
    "cosine_top_k_scoped": with_views(_TOP.format("(owner IS NULL OR owner = user_id) AND source_id = 4", 3), _SCORES),
    "cosine_top_k_soft": with_views(
        """SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, round(sim, 4) AS similarity FROM (SELECT *, count_if(sim >= 0.4) OVER (PARTITION BY query_id) AS good, count(*) OVER (PARTITION BY query_id) AS n
           FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM scored WHERE owner = user_id) WHERE rank <= 10)
           WHERE CASE WHEN good >= 3 THEN sim >= 0.4 WHEN n >= 3 THEN rank <= 3 WHEN good > 0 THEN sim >= 0.4 ELSE true END""",
        _SCORES,
    ),
    "expand_adjacent_chunks": with_views(
        """SELECT query_id, source_id, chunk_index, chunk_id, bool_or(hit) AS hit FROM (SELECT h.query_id, c.source_id, c.chunk_index, c.chunk_id, true AS hit FROM hits h JOIN v_chunks c USING (chunk_id)
           UNION ALL SELECT h.query_id, n.source_id, n.chunk_index, n.chunk_id, false FROM hits h JOIN v_chunks c USING (chunk_id) JOIN v_chunks n ON n.source_id = c.source_id AND n.chunk_index BETWEEN c.chunk_index - 1 AND c.chunk_index + 1
             JOIN v_sources s ON s.source_id = n.source_id WHERE s.user_id IS NULL OR s.user_id = h.user_id) GROUP BY ALL""",
        _SCORES,
        _HITS,
    ),
    "prompt_context": with_views(
        """SELECT query_id, string_agg('[' || coalesce(heading, 'Chunk ' || chunk_index) || '] (source: ' || source_id || ', Chunk ' || chunk_index || '): ' || content, chr(10) || chr(10) ORDER BY first, source_id, chunk_index) AS context
           FROM (SELECT h.query_id, c.*, min(h.rank) OVER (PARTITION BY h.query_id, c.source_id) AS first FROM hits h JOIN v_chunks c USING (chunk_id)) GROUP BY query_id""",
        _SCORES,
        _HITS,
    ),
    "voice_context": with_views(
        """SELECT query_id, '📚 Knowledge Base References:' || chr(10) || chr(10) || string_agg('[' || rank || '] ' || coalesce(heading, 'Untitled') || ' (Relevance: ' || printf('%.1f', sim * 100) || '%)' || chr(10) || '    ' || left(content, 200) || chr(10) || chr(10), '' ORDER BY rank) AS context
           FROM hits JOIN (SELECT chunk_id, heading, content FROM v_chunks) USING (chunk_id) GROUP BY query_id""",
        _SCORES,
        _HITS,
    ),
    "upsert_families": with_views(
        """SELECT coalesce(t.family_id, u.family_id) AS family_id, coalesce(u.name, t.name) AS name, coalesce(u.description, t.description) AS description,
           CASE WHEN t.family_id IS NULL THEN 'b=9,c=3' WHEN u.family_id IS NULL THEN 'a=1,b=2' ELSE 'a=1,b=9,c=3' END AS metadata
           FROM (SELECT DISTINCT family_id, family_name AS name, CASE WHEN family_id LIKE '%1' THEN 'old text' END AS description FROM v_models) t FULL JOIN
           (SELECT k AS family_id, arg_max('name ' || model_id, model_id) AS name, arg_max('text ' || model_id, model_id) FILTER (model_id % 4 = 0) AS description
            FROM (SELECT model_id, CASE WHEN model_id % 3 = 0 THEN 'New#' || (model_id % 10) ELSE family_id END AS k FROM v_models WHERE model_id % 2 = 0) GROUP BY 1) u USING (family_id)"""
    ),
    "upsert_models": with_views(
        """SELECT model_id, CASE WHEN model_id % 2 = 0 THEN family_id ELSE 'other' END AS family_id, CASE WHEN model_id % 3 = 0 AND model_id % 4 <> 0 THEN upper(title) WHEN model_id % 2 = 0 THEN title END AS title,
           CASE WHEN model_id % 3 = 0 THEN 'd' END AS description, CASE WHEN model_id % 3 = 0 THEN '2' ELSE '1' END AS a FROM v_models WHERE model_id % 2 = 0 OR model_id % 3 = 0"""
    ),
    "upsert_sources": with_views(
        """SELECT source_id, CASE WHEN source_id % 4 = 0 THEN 'last title' WHEN source_id % 3 = 0 THEN CASE WHEN source_id % 2 = 0 THEN title END ELSE 'new title' END AS title, CASE WHEN source_id % 2 = 0 THEN length(raw_content) END AS chars,
           CASE WHEN source_id % 2 = 0 THEN model_id END AS model_id, (source_id % 3) || ':new' || CASE WHEN source_id % 2 = 0 THEN ',' || (source_id % 5 + 10) || ':old' ELSE '' END || CASE WHEN source_id % 4 = 0 THEN ',99:more' ELSE '' END AS devices FROM v_sources"""
    ),
    "insert_if_absent": with_views("SELECT chunk_id, CASE WHEN chunk_id % 2 = 0 THEN content ELSE 'late' END AS content FROM v_chunks"),
    "replace_source_chunks": with_views(
        "SELECT source_id, chunk_index, content FROM v_chunks WHERE source_id % 3 <> 0 UNION ALL SELECT source_id, chunk_index, 'new' FROM v_chunks WHERE source_id % 3 = 0 AND chunk_index < 2 UNION ALL SELECT 100000, chunk_index, content FROM v_chunks WHERE source_id = 5"
    ),
    "replace_source_chunks_refusing": with_views("SELECT DISTINCT source_id FROM v_chunks WHERE source_id % 3 = 0 AND chunk_index < 2"),
    "apply_embeddings": with_views(
        "SELECT chunk_id, CASE WHEN embedding IS NOT NULL THEN len(embedding) WHEN chunk_id % 2 = 1 AND chunk_id % 3 <> 0 THEN 64 ELSE NULL END AS dims, embedding IS NULL AND chunk_id % 2 = 1 AND chunk_id % 3 <> 0 AS is_new FROM v_chunks"
    ),
    "wrong_dimensions": with_views("SELECT chunk_id, 'expected 64 dimensions, found ' || CASE WHEN embedding IS NULL THEN 0 ELSE 3 END AS error FROM v_chunks WHERE chunk_id % 3 = 0 OR embedding IS NULL"),
    "cascade_delete": with_views(
        """SELECT 'users' AS name, count(*) AS n, count(user_id) AS owned FROM v_users WHERE user_id % 3 <> 0 UNION ALL SELECT 'sessions', count(*), count(user_id) FROM v_sessions WHERE user_id NOT IN (SELECT user_id FROM v_users WHERE user_id % 3 = 0)
           UNION ALL SELECT 'messages', count(*), count(session_id) FROM v_messages WHERE session_id IN (SELECT session_id FROM v_sessions WHERE user_id NOT IN (SELECT user_id FROM v_users WHERE user_id % 3 = 0))
           UNION ALL SELECT 'subscriptions', count(*), count(user_id) FROM v_subscriptions WHERE user_id NOT IN (SELECT user_id FROM v_users WHERE user_id % 3 = 0) UNION ALL SELECT 'uploads', count(*), count(user_id) FROM v_uploads WHERE user_id NOT IN (SELECT user_id FROM v_users WHERE user_id % 3 = 0)
           UNION ALL SELECT 'settings', count(*), count(user_id) FROM v_users WHERE user_id % 3 <> 0
           UNION ALL SELECT 'attachments', count(*), count(*) FROM v_messages WHERE turn % 2 = 0 AND session_id IN (SELECT session_id FROM v_sessions WHERE user_id NOT IN (SELECT user_id FROM v_users WHERE user_id % 3 = 0))
           UNION ALL SELECT 'analyses', count(*), count(*) FROM v_messages WHERE turn % 2 = 0 AND session_id IN (SELECT session_id FROM v_sessions WHERE user_id NOT IN (SELECT user_id FROM v_users WHERE user_id % 3 = 0))
           UNION ALL SELECT 'sources', count(*), count(CASE WHEN user_id NOT IN (SELECT user_id FROM v_users WHERE user_id % 3 = 0) THEN 1 END) FROM v_sources"""
    ),
    "delete_documents": with_views(
        """SELECT 'uploads' AS name, count(*) AS n FROM v_sources WHERE user_id IS NOT NULL AND source_id % 2 = 0 UNION ALL SELECT 'sources', count(*) FROM v_sources WHERE source_id NOT IN (SELECT source_id FROM dead)
           UNION ALL SELECT 'chunks', count(*) FROM v_chunks WHERE source_id NOT IN (SELECT source_id FROM dead)""",
        "dead AS (SELECT source_id FROM v_sources WHERE user_id IS NOT NULL AND source_id % 2 = 1 AND source_id % 5 <> 0 AND source_type = 'pdf' UNION SELECT source_id + 1 FROM v_sources WHERE user_id IS NOT NULL AND source_id % 2 = 1 AND source_id % 5 = 0)",
    ),
    "new_keys": with_views("SELECT DISTINCT source_id, chunk_index + 2 AS chunk_index FROM v_chunks WHERE (source_id, chunk_index + 2) NOT IN (SELECT (source_id, chunk_index) FROM v_chunks)"),
    "dedupe_keep_first": with_views("SELECT family_id, max(model_id) AS model_id FROM v_models GROUP BY 1"),
    "orphans": with_views("SELECT source_id, model_id FROM v_sources WHERE model_id IS NOT NULL AND model_id NOT IN (SELECT model_id FROM v_models)"),
    "parents_without_children": with_views("SELECT user_id FROM v_users WHERE user_id NOT IN (SELECT user_id FROM v_sessions)"),
    "chunk_source_stats": with_views("SELECT source_id, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, round(avg(token_count), 4) AS avg_tokens, count(embedding) AS embedded, count(heading) AS with_heading FROM v_chunks GROUP BY 1"),
    "chunk_quality_audit": with_views(
        """SELECT count(*) AS chunks, count_if(regexp_matches(c, '\\.{3,}')) AS dotted, count_if(contains(lower(c), '[image')) AS image_marks, count_if(contains(lower(c), 'copyright') OR contains(c, '©')) AS copyright, count_if(contains(c, '[TABLE_PLACEHOLDER]')) AS table_marks,
           count_if(regexp_matches(lower(c), 'url:\\s*($|\\n)')) AS dangling, min(length(c)) AS min_tokens, max(length(c)) AS max_tokens, CAST(floor(avg(length(c))) AS BIGINT) AS avg_tokens FROM (SELECT raw_content AS c FROM v_manuals)"""
    ),
    "content_length_stats": with_views(
        f"""SELECT count(*) AS total, count_if(n > 100) AS over_100, count_if(n > 1000) AS over_1000, CAST(floor(count_if(n > 100) * 100 / count(*)) AS BIGINT) AS percent_over_100, CAST(floor(count_if(n > 1000) * 100 / count(*)) AS BIGINT) AS percent_over_1000,
            round(avg(n), 4) AS avg_length, min(n) AS min_length, max(n) AS max_length, round(avg(w), 4) AS avg_words FROM (SELECT CAST(length(raw_content) AS INT) AS n, {_words} AS w FROM v_sources WHERE source_type = 'pdf')"""
    ),
    "field_completeness": with_views(
        f"""SELECT count(*) AS total, count_if(coalesce(title, '') <> '') AS title, count_if(length(raw_content) > 10) AS content, count(model_id) AS model, count_if({_words} > 0) AS words, CAST(floor(count(model_id) * 100 / count(*)) AS BIGINT) AS model_percent,
            CASE WHEN count_if(length(raw_content) > 10) = count(*) THEN 'PASSED' WHEN count_if(length(raw_content) > 10) > 0.9 * count(*) THEN 'WARNING' ELSE 'FAILED' END AS verdict FROM v_sources"""
    ),
    "content_structure": with_views("SELECT count(*) AS total, count_if(contains(raw_content, '##')) AS with_sections, count_if(contains(raw_content, 'Note:') OR contains(raw_content, 'Warning:') OR contains(raw_content, 'Caution:')) AS with_notes, count_if(contains(raw_content, '# ') AND length(raw_content) > 100) AS with_titles FROM v_manuals"),
    "metadata_completeness": with_views("SELECT count(*) AS total, count_if(source_id % 7 > 2) AS guide_id, count_if(source_id % 7 > 2) AS url, 0 AS step_images, count_if(source_id % 7 = 1) AS tools, count_if(source_id % 7 > 2) AS parts FROM v_sources"),
    "validation_issues": with_views("SELECT section, type, id, message FROM issues", _META, _ISSUES),
    "validation_summary": with_views("SELECT section, type, count(*) AS n FROM issues GROUP BY GROUPING SETS ((), (section), (type))", _META, _ISSUES),
    "keyword_inventory": with_views(
        """SELECT 'sources' AS name, count(*) AS total, count_if(contains(lower(raw_content), '3')) AS matches FROM v_sources UNION ALL SELECT 'models', count(*), count_if(contains(lower(title), '3')) FROM v_models
           UNION ALL SELECT 'chunks', count(*), count_if(contains(lower(content), '3')) FROM v_chunks UNION ALL SELECT 'sources of models', count(*), count(DISTINCT source_id) FROM v_sources JOIN v_models USING (model_id) WHERE contains(lower(v_models.title), '3')
           UNION ALL SELECT 'chunks of ' || source_type, count(*), count_if(contains(lower(content), '3')) FROM v_chunks JOIN v_sources USING (source_id) GROUP BY source_type
           UNION ALL SELECT 'families', count(*), count_if(contains(lower(family_name), '3')) FROM (SELECT DISTINCT family_id, family_name FROM v_models) UNION ALL SELECT 'models of families', count(*), count_if(contains(lower(title), '3')) FROM v_models WHERE contains(lower(family_name), '3')"""
    ),
    "reconcile_counts": with_views("SELECT source_id, CAST(CASE WHEN source_id IN (SELECT source_id FROM v_sources) THEN 5 ELSE 0 END AS BIGINT) AS expected, coalesce(n, 0) AS stored, CASE WHEN source_id IN (SELECT source_id FROM v_sources) THEN 5 ELSE 0 END = coalesce(n, 0) AS matches FROM (SELECT source_id FROM v_sources) FULL JOIN (SELECT source_id, count(*) AS n FROM v_chunks WHERE chunk_id % 9 <> 0 GROUP BY 1) USING (source_id)"),
    "top_documents": with_views("SELECT source_id, s.title, CAST(length(raw_content) AS INT) AS size, left(raw_content, 40) AS preview, m.title AS model_title, CAST(NULL AS VARCHAR) AS url FROM (SELECT * FROM v_sources ORDER BY length(raw_content) DESC, source_id LIMIT 5) s LEFT JOIN v_models m USING (model_id)"),
    "top_documents_like": with_views(
        f"SELECT source_id, s.title, CAST(size AS INT) AS size, left(raw_content, 40) AS preview, m.title AS model_title, CASE WHEN source_id % 7 > 2 THEN 'u' END AS url FROM (SELECT *, {_words} AS size FROM v_sources WHERE title ILIKE 'DOC-1%' ORDER BY size DESC, source_id LIMIT 4) s LEFT JOIN v_models m USING (model_id)"
    ),
    "validation_stats": with_views(
        """SELECT section, field, n FROM (SELECT 'families' AS section, unnest(['total', 'with_name']) AS field, unnest([count(*), count(*)]) AS n FROM (SELECT DISTINCT family_id FROM v_models)
           UNION ALL SELECT 'models', unnest(['total', 'with_name', 'with_family']), unnest([count(*), count_if(trim(title) <> ''), count(family_id)]) FROM v_models
           UNION ALL SELECT 'sources', unnest(['total', 'with_title', 'with_content', 'with_model', 'with_metadata']), unnest([count(*), count_if(trim(title) <> ''), count_if(raw_content <> ''), count(model_id), count_if(source_id % 7 <> 2)]) FROM v_sources)"""
    ),
    "edge_case_sample": with_views(
        f"""SELECT kind, CAST(rank AS INT) AS rank, source_id, words FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY place, source_id) AS rank FROM (
            SELECT 'very_short' AS kind, words AS place, source_id, words FROM odd WHERE words < 100 UNION ALL SELECT 'single_step', 0, source_id, words FROM odd WHERE contains(raw_content, '## 1.') AND NOT contains(raw_content, '## 2.') AND NOT contains(raw_content, '## 3.')
            UNION ALL SELECT 'many_steps', -marks, source_id, words FROM odd WHERE words BETWEEN 500 AND 1500 AND marks > 10 UNION ALL SELECT 'long', 0, source_id, words FROM odd WHERE words > 2000)) WHERE rank <= 2""",
        f"odd AS (SELECT *, {_words} AS words, (length(raw_content) - length(replace(raw_content, '##', ''))) // 2 AS marks FROM (SELECT source_id, CASE source_id % 3 WHEN 0 THEN '## 1. one' || chr(10) || raw_content WHEN 1 THEN replace(raw_content, '. ', '.' || chr(10) || '## ') ELSE raw_content END AS raw_content FROM v_sources))",
    ),
    "size_bucket_sample": with_views(
        f"""SELECT bucket, CAST(rank AS INT) AS rank, source_id, words FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY CASE WHEN bucket = 'large' THEN -words ELSE words END, source_id) AS rank
            FROM (SELECT source_id, {_words} AS words, CASE WHEN {_words} < 500 THEN 'small' WHEN {_words} < 2000 THEN 'medium' ELSE 'large' END AS bucket FROM v_sources)) WHERE rank <= 2"""
    ),
    "filter_chunks_by_words": with_views(f"SELECT source_id FROM v_sources WHERE {_words} BETWEEN 50 AND 300"),
    "embedding_ingest_stats": with_views("SELECT chunk_id % 4 AS batch_no, count(*) AS lines, count_if(embedding IS NULL) AS failed, count(embedding) AS updates FROM v_chunks GROUP BY 1"),
}
ORACLES |= {f"{name}_stored": ORACLES[name] for name in ("upsert_sources", "replace_source_chunks", "apply_embeddings")}
