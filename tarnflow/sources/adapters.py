"""Adapter views that give the library's input shapes over the test tables; the same SQL for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_users": """
        SELECT c_custkey AS user_id, c_name AS email, split_part(c_name, '#', 1) AS first_name,
        CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE split_part(c_name, '#', 2) END AS last_name,
        CASE c_custkey % 4 WHEN 0 THEN 'civilian' WHEN 1 THEN 'military' WHEN 2 THEN 'student' ELSE 'admin' END AS role,
        CASE WHEN c_acctbal < 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status,
        CAST('2022-01-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' DAY * CAST(c_custkey % 900 AS INT) AS created_at
        FROM customer
    """,
    "v_uploads": """
        SELECT o_orderkey AS upload_id, o_custkey AS user_id,
        concat('file-', CAST(o_orderkey AS VARCHAR(20)), CASE o_orderkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.tar.gz' ELSE '' END) AS file_name,
        CAST(round(o_totalprice) AS BIGINT) AS file_size,
        CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status,
        o_orderdate AS uploaded_at
        FROM orders
    """,
    "v_subscriptions": """
        SELECT o_orderkey AS subscription_id, o_custkey AS user_id, o_orderpriority AS plan_name,
        CASE WHEN o_orderkey % 2 = 0 THEN 'active' ELSE 'canceled' END AS status, o_orderdate AS created_at
        FROM orders
    """,
    "v_sessions": """
        SELECT conv_id AS session_id, 1 + conv_id % 40 AS user_id,
        CASE WHEN conv_id % 5 = 0 THEN 'archived' ELSE 'active' END AS status,
        CASE WHEN conv_id % 3 = 0 THEN NULL ELSE concat('summary ', CAST(conv_id AS VARCHAR(20))) END AS context_summary,
        CAST('2024-01-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' HOUR * CAST(conv_id * 9 AS INT) AS created_at,
        CAST('2024-01-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' HOUR * CAST(conv_id * 9 + max(turn) AS INT) AS updated_at
        FROM conversations GROUP BY conv_id
    """,
    "v_messages": """
        SELECT conv_id * 1000 + turn AS message_id, conv_id AS session_id, turn, role, text AS content,
        CASE conv_id % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' ELSE NULL END AS model,
        CASE WHEN role = 'assistant' THEN CAST(floor(length(text) / 4.0) AS INT) END AS prompt_tokens,
        CASE WHEN role = 'assistant' THEN CAST(floor(length(text) / 3.0) AS INT) END AS completion_tokens,
        (conv_id * 7 + turn * 5) % 9 = 0 AS is_stopped,
        CAST('2024-01-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' HOUR * CAST(conv_id * 9 + turn AS INT) AS created_at
        FROM conversations
    """,
    "v_models": """
        SELECT p_partkey AS model_id, p_brand AS family_id, concat(p_brand, ' maker') AS family_name,
        concat(p_brand, '/', p_type, '/', p_name, ' ', CAST(p_partkey AS VARCHAR(20))) AS path,
        concat(p_name, ' ', CAST(p_partkey AS VARCHAR(20))) AS title
        FROM part
    """,
    "v_guides": """
        SELECT doc_id AS guide_id, CASE doc_id % 5 WHEN 0 THEN ' Red Widget ' WHEN 1 THEN concat('brand#', CAST(doc_id % 30 AS VARCHAR(20)))
        WHEN 2 THEN 'economy/small' WHEN 3 THEN '' ELSE 'no such thing' END AS category
        FROM documents
    """,
    "v_sources": """
        SELECT doc_id AS source_id, concat('doc-', CAST(doc_id AS VARCHAR(20)), '.pdf') AS title,
        CASE WHEN doc_id % 3 = 0 THEN 'pdf' ELSE 'guide' END AS source_type, text AS raw_content, lang,
        CASE WHEN doc_id % 10 = 0 THEN NULL ELSE 1 + (doc_id * 7) % 2300 END AS model_id,
        CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 1 + doc_id % 40 END AS user_id
        FROM documents
    """,
    "v_chunks": """
        SELECT vec_id AS chunk_id, CAST(floor(vec_id / 5.0) AS BIGINT) AS source_id, CAST(vec_id % 5 AS INT) AS chunk_index,
        concat('chunk text ', CAST(vec_id AS VARCHAR(20))) AS content,
        CASE WHEN vec_id % 4 = 0 THEN NULL ELSE concat('Heading ', CAST(label AS VARCHAR(20))) END AS heading,
        CAST(20 + vec_id % 300 AS INT) AS token_count,
        CASE WHEN vec_id % 11 = 0 THEN NULL ELSE embedding END AS embedding
        FROM embeddings
    """,
    "v_queries": """
        SELECT vec_id AS query_id, 1 + vec_id % 40 AS user_id, embedding FROM embeddings WHERE vec_id % 20 = 0
    """,
    "v_job_events": """
        SELECT event_id, user_id AS job_id, user_id % 10 AS batch_id,
        CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing'
        WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, props, ts
        FROM events
    """,
    "v_manuals": """
        SELECT doc_id, concat('# Manual ', CAST(doc_id AS VARCHAR(20)), chr(10), 'Table of Contents', chr(10), 'Setup ..... 4', chr(10),
        '1. Setup', chr(10), chr(10), replace(text, chr(10), concat(chr(10), chr(10))), chr(10), chr(10),
        'SAFETY NOTES', chr(10), 'Page ', CAST(doc_id % 90 AS VARCHAR(20)), chr(10), 'Read this manual', chr(10), 'before use.', chr(10),
        '![fig](http://img.example.com/', CAST(doc_id AS VARCHAR(20)), '.png)', chr(10), 'Copyright 2024') AS raw_content
        FROM documents
    """,
}

_TABLE = re.compile(r"\bFROM (\w+)")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of ``sf_dir`` by its own name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    table = _TABLE.search(VIEWS[name])[1]
    return spark.sql(_TABLE.sub(r"FROM {\1}", VIEWS[name]), **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def with_views(body: str, *more: str) -> str:
    """DuckDB SQL: ``body`` with the views that it names (and ``more`` common table expressions) before it."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", body + " ".join(more))]
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + list(more)
    recursive = "RECURSIVE " if any("/* recursive */" in m for m in more) else ""
    return f"WITH {recursive}{', '.join(parts)} {body}" if parts else body
