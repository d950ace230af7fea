"""Queries over chat sessions and reports, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chat, reports
from ..sources.adapters import view, with_views

NOW = "2024-01-20 00:00:00"
_now = lambda: F.to_timestamp(F.lit(NOW))


def _attachments(spark, sf_dir):
    return view(spark, sf_dir, "v_messages").filter("message_id % 3 <> 0").select(
        (F.col("message_id") * 2).alias("attachment_id"), "message_id", F.when(F.col("message_id") % 5 == 0, F.lit("file")).otherwise(F.lit("image")).alias("type"), "created_at",
        F.when(F.col("message_id") % 4 != 0, F.concat(F.lit('{"size": '), (F.col("message_id") % 900).cast("string"), F.lit("}"))).alias("metadata"),
    )


_ATTACHMENTS = """attachments AS (SELECT message_id * 2 AS attachment_id, message_id, CASE WHEN message_id % 5 = 0 THEN 'file' ELSE 'image' END AS type, created_at,
  CASE WHEN message_id % 4 <> 0 THEN message_id % 900 END AS size FROM v_messages WHERE message_id % 3 <> 0)"""


def _analyses(spark, sf_dir):
    a = _attachments(spark, sf_dir)
    text = F.concat(F.lit("  scene "), (F.col("attachment_id") % 7).cast("string"), F.repeat(F.lit(" é"), (F.col("attachment_id") % 40 * 20).cast("int")))
    return a.select((F.col("attachment_id") + 1).alias("analysis_id"), "attachment_id", F.to_json(F.struct(F.when(F.col("attachment_id") % 11 != 0, text).alias("description"))).alias("scene_description"), F.col("created_at").alias("analysed_at"))


_M = "v_messages"
QUERIES = {
    "user_chat_stats": lambda s, d: reports.user_chat_stats(view(s, d, "v_users"), view(s, d, "v_sessions"), view(s, d, _M)),
    "users_overview": lambda s, d: reports.users_overview(view(s, d, "v_users"), view(s, d, "v_uploads"), view(s, d, "v_sessions"), view(s, d, "v_subscriptions")),
    "dashboard_counts": lambda s, d: reports.dashboard_counts(view(s, d, "v_users"), view(s, d, "v_uploads"), view(s, d, "v_sessions"), view(s, d, "v_subscriptions"), _now()),
    "trend_counts": lambda s, d: reports.trend_counts(view(s, d, "v_users"), "created_at", 2023),
    "trend_counts_by_year": lambda s, d: reports.trend_counts(view(s, d, "v_uploads"), "uploaded_at"),
    "list_uploads": lambda s, d: reports.list_uploads(view(s, d, "v_uploads"), view(s, d, "v_users")),
    "page": lambda s, d: reports.page(view(s, d, "v_uploads").filter("status = 'ready'").select("upload_id", "file_name"), [F.col("upload_id").desc()], 3, 10),
    "batch_job_summary": lambda s, d: reports.batch_job_summary(view(s, d, "v_job_events")),
    "job_status": lambda s, d: reports.latest_job_status(view(s, d, "v_job_events")),
    "batch_completion": lambda s, d: reports.batch_completion(view(s, d, "v_job_events")),
    "stalled_jobs": lambda s, d: reports.stalled_jobs(view(s, d, "v_job_events"), "1 day"),
    "last_messages": lambda s, d: chat.last_messages(view(s, d, _M)).select("message_id", "session_id", "position"),
    "context_window": lambda s, d: chat.context_window(view(s, d, _M)).select("message_id", "session_id", "role"),
    "summary_work": lambda s, d: chat.summary_work(view(s, d, _M), 2, 4),
    "older_messages": lambda s, d: chat.older_messages(view(s, d, _M), 2, 5),
    "list_sessions": lambda s, d: chat.list_sessions(view(s, d, "v_sessions"), view(s, d, _M), None, "active", 2, 10),
    "mark_last_user_stopped": lambda s, d: chat.mark_last_user_stopped(view(s, d, _M), view(s, d, "v_sessions").filter("session_id % 3 = 0"), _now()).select("message_id", "is_stopped", "stopped_at"),
    "preceding_user_message": lambda s, d: chat.preceding_user_message(view(s, d, _M)),
    "cleanup_stopped": lambda s, d: chat.cleanup_stopped(view(s, d, _M)).select("message_id", "session_id"),
    "messages_after_edit": lambda s, d: chat.messages_after_edit(view(s, d, _M), view(s, d, _M).filter("role = 'user' AND session_id % 2 = 0 AND turn <= 1").select("message_id", F.concat(F.lit("edited "), F.col("message_id").cast("string")).alias("new_content"))).select("message_id", "content", "is_stopped"),
    "recent_orphan_messages": lambda s, d: chat.recent_orphan_messages(view(s, d, _M), _now(), 864000).select("message_id", "session_id"),
    "incomplete_messages": lambda s, d: chat.incomplete_messages(view(s, d, _M).withColumn("content", F.when(F.col("turn") % 4 == 1, F.lit("")).otherwise(F.col("content")))).select("message_id", "incomplete"),
    "chunks_in_order": lambda s, d: chat.chunks_in_order(view(s, d, "v_chunks")).select("source_id", F.array_join(F.transform("chunks", lambda c: F.concat_ws("|", c["chunk_index"].cast("string"), F.coalesce(c["heading"], F.lit("-")), c["content"])), ";").alias("chunks")),
    "session_transcript": lambda s, d: chat.session_transcript(view(s, d, _M), _attachments(s, d)).select("session_id", F.array_join(F.transform("turns", lambda t: F.concat_ws("|", t["message_id"].cast("string"), t["role"], F.array_join(t["files"].cast("array<string>"), "+"))), ";").alias("transcript")),
    "user_images": lambda s, d: chat.user_images(_attachments(s, d), view(s, d, _M), view(s, d, "v_sessions"), 3, 1, 5),
    "image_summaries": lambda s, d: chat.image_summaries(_analyses(s, d), _attachments(s, d), view(s, d, _M), 700).select("session_id", F.array_join("summaries", "|").alias("summaries"), "left_out"),
}

_LIVE = """live AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, message_id) AS old, count(*) OVER (PARTITION BY session_id) AS total
  FROM v_messages WHERE NOT is_stopped)"""


def _framed(size: int) -> tuple[str, str]:
    return _LIVE, f"""framed AS (SELECT *, CASE WHEN total <= {size} THEN 1 WHEN fin IS NULL THEN total + 1 ELSE total - {size} + 1 + CASE WHEN (fin - (total - {size})) % 2 = 1 AND fin - (total - {size}) > 1 THEN 1 ELSE 0 END END AS first
      FROM (SELECT *, max(CASE WHEN role = 'assistant' AND old > total - {size} THEN old END) OVER (PARTITION BY session_id) AS fin FROM live))"""


_PRECEDING = """preceding AS (SELECT a.message_id, a.session_id, arg_max(u.message_id, (u.created_at, u.message_id)) AS user_message_id, arg_max(u.is_stopped, (u.created_at, u.message_id)) AS user_is_stopped
  FROM v_messages a LEFT JOIN v_messages u ON u.session_id = a.session_id AND u.role = 'user' AND u.created_at < a.created_at
  WHERE a.role = 'assistant' AND a.is_stopped GROUP BY ALL)"""
_LATEST = "latest AS (SELECT job_id, arg_max(batch_id, (ts, event_id)) AS batch_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts FROM v_job_events GROUP BY job_id)"
_JOBS = "SELECT batch_id, count(*) AS jobs, count_if(status = 'queued') AS queued, count_if(status = 'processing') AS processing, count_if(status = 'completed') AS completed, count_if(status = 'failed') AS failed, bool_and(status IN ('completed', 'failed')) AS all_done FROM {} GROUP BY batch_id"

ORACLES = {
    "user_chat_stats": with_views(
        """SELECT u.user_id, u.email, coalesce(s.n, 0) AS total_sessions, coalesce(m.m, 0) AS total_messages, coalesce(m.p, 0) AS user_tokens, coalesce(m.c, 0) AS system_tokens,
           coalesce(m.p, 0) + coalesce(m.c, 0) AS total_tokens, CAST(round(coalesce(m.price, 0), 4) AS DOUBLE) AS total_price
           FROM v_users u LEFT JOIN (SELECT user_id, count(*) AS n FROM v_sessions GROUP BY 1) s USING (user_id)
           LEFT JOIN (SELECT user_id, count(*) AS m, CAST(sum(CASE WHEN role = 'assistant' THEN coalesce(prompt_tokens, 0) ELSE 0 END) AS BIGINT) AS p,
             CAST(sum(CASE WHEN role = 'assistant' THEN coalesce(completion_tokens, 0) ELSE 0 END) AS BIGINT) AS c,
             sum(CASE WHEN role = 'assistant' THEN coalesce(prompt_tokens, 0) * CASE WHEN model = 'gpt-4o' THEN 0.000005000 ELSE 0.000001500 END
               + coalesce(completion_tokens, 0) * CASE WHEN model = 'gpt-4o' THEN 0.000015000 ELSE 0.000007500 END ELSE 0 END) AS price
             FROM v_messages JOIN v_sessions USING (session_id) GROUP BY 1) m USING (user_id)"""
    ),
    "users_overview": with_views(
        """SELECT u.user_id, trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')) AS name, email, role, 'https://api.dicebear.com/7.x/avataaars/svg?seed=' || coalesce(first_name, 'User') AS profile_image,
           lower(status) AS status, coalesce(up.n, 0) AS uploads, coalesce(se.n, 0) AS sessions, coalesce(p.plan, 'free') AS subscription_plan FROM v_users u
           LEFT JOIN (SELECT user_id, count(*) AS n FROM v_uploads GROUP BY 1) up USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS n FROM v_sessions GROUP BY 1) se USING (user_id)
           LEFT JOIN (SELECT user_id, arg_min(plan_name, (created_at, subscription_id)) AS plan FROM v_subscriptions GROUP BY 1) p USING (user_id)"""
    ),
    "dashboard_counts": with_views(
        f"""SELECT * FROM (SELECT count(*) AS total_users, count_if(status = 'ACTIVE') AS active_users, count_if(created_at >= TIMESTAMP '{NOW}' - INTERVAL 1 MONTH) AS new_users,
            count_if(role = 'civilian') AS civilian_users, count_if(role = 'military') AS military_users, count_if(role = 'student') AS student_users, count_if(role = 'admin') AS admin_users FROM v_users),
            (SELECT count(*) AS uploads, count_if(status = 'ready') AS ready_uploads FROM v_uploads), (SELECT count_if(status = 'active') AS active_sessions FROM v_sessions),
            (SELECT count_if(status = 'active') AS active_subscriptions FROM v_subscriptions)"""
    ),
    "trend_counts": with_views("SELECT strftime(created_at, '%Y-%m') AS bucket, count(*) AS n FROM v_users WHERE created_at >= TIMESTAMP '2023-01-01' AND created_at < TIMESTAMP '2024-01-01' GROUP BY 1"),
    "trend_counts_by_year": with_views("SELECT strftime(uploaded_at, '%Y') AS bucket, count(*) AS n FROM v_uploads GROUP BY 1"),
    "list_uploads": with_views(
        """SELECT CAST(row_number() OVER (ORDER BY uploaded_at, upload_id) AS VARCHAR) AS id, o.user_id, trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')) AS user_name, file_name,
           upper(string_split(file_name, '.')[-1]) AS file_type, file_size, o.status FROM v_uploads o LEFT JOIN v_users u USING (user_id)"""
    ),
    "page": with_views("SELECT upload_id, file_name, total, CAST(ceil(total / 10.0) AS BIGINT) AS total_pages FROM (SELECT *, count(*) OVER () AS total FROM v_uploads WHERE status = 'ready') ORDER BY upload_id DESC LIMIT 10 OFFSET 20"),
    "batch_job_summary": with_views(_JOBS.format("v_job_events")),
    "job_status": with_views("SELECT * FROM latest", _LATEST),
    "batch_completion": with_views(_JOBS.format("latest"), _LATEST),
    "stalled_jobs": with_views("SELECT event_id, job_id, status, ts, next_ts FROM (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS next_ts FROM v_job_events) WHERE status NOT IN ('completed', 'failed') AND (next_ts IS NULL OR ts + INTERVAL 1 DAY < next_ts)"),
    "last_messages": with_views("SELECT message_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, message_id) AS position FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, message_id DESC) AS r FROM v_messages) WHERE r <= 5"),
    "context_window": with_views("SELECT message_id, session_id, role FROM framed WHERE total <= 6 OR (old >= first AND old <= fin)", *_framed(6)),
    "summary_work": with_views(
        """SELECT session_id, any_value(total) AS total, count(*) AS evicted, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || coalesce(content, ''), chr(10) ORDER BY old) AS evicted_text,
           CASE WHEN any_value(total) % 4 = 0 THEN 'recompress' ELSE 'rolling' END AS mode FROM framed WHERE total > 2 AND old < first AND old >= first - 2 GROUP BY session_id""",
        *_framed(2),
    ),
    "older_messages": with_views("SELECT session_id, count(*) AS messages, string_agg(role || ': ' || coalesce(content, ''), chr(10) ORDER BY r DESC) AS text FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, message_id DESC) AS r FROM v_messages) WHERE r > 2 AND r <= 5 GROUP BY 1"),
    "list_sessions": with_views(
        """SELECT session_id, user_id, status, updated_at, coalesce(m.n, 0) AS messages, m.last_message, total, CAST(ceil(total / 10.0) AS BIGINT) AS total_pages
           FROM (SELECT *, count(*) OVER () AS total FROM v_sessions WHERE status = 'active' ORDER BY updated_at DESC, session_id LIMIT 10 OFFSET 10)
           LEFT JOIN (SELECT session_id, count(*) AS n, arg_max(content, (created_at, message_id)) AS last_message FROM v_messages GROUP BY 1) m USING (session_id)"""
    ),
    "mark_last_user_stopped": with_views(
        f"""SELECT message_id, hit OR is_stopped AS is_stopped, CASE WHEN hit THEN TIMESTAMP '{NOW}' END AS stopped_at
            FROM (SELECT *, session_id % 3 = 0 AND role = 'user' AND row_number() OVER (PARTITION BY session_id, role ORDER BY created_at DESC, message_id DESC) = 1 AS hit FROM v_messages)"""
    ),
    "preceding_user_message": with_views("SELECT * FROM preceding", _PRECEDING),
    "cleanup_stopped": with_views("SELECT message_id, session_id FROM v_messages WHERE message_id NOT IN (SELECT message_id FROM preceding UNION SELECT user_message_id FROM preceding WHERE user_is_stopped)", _PRECEDING),
    "messages_after_edit": with_views(
        """SELECT message_id, CASE WHEN message_id IN (SELECT message_id FROM edits) THEN 'edited ' || message_id ELSE content END AS content, is_stopped AND message_id NOT IN (SELECT message_id FROM edits) AS is_stopped
           FROM v_messages m WHERE role <> 'assistant' OR NOT EXISTS (SELECT 1 FROM edits e WHERE e.session_id = m.session_id AND m.created_at > e.created_at)""",
        "edits AS (SELECT * FROM v_messages WHERE role = 'user' AND session_id % 2 = 0 AND turn <= 1)",
    ),
    "recent_orphan_messages": with_views(f"SELECT arg_max(message_id, (created_at, message_id)) AS message_id, session_id FROM v_messages WHERE role = 'assistant' AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 864000 SECOND GROUP BY session_id"),
    "incomplete_messages": with_views("SELECT message_id, role = 'assistant' AND coalesce(CASE WHEN turn % 4 = 1 THEN '' ELSE content END, '') = '' AS incomplete FROM v_messages"),
    "chunks_in_order": with_views("SELECT source_id, string_agg(chunk_index || '|' || coalesce(heading, '-') || '|' || content, ';' ORDER BY chunk_index, chunk_id) AS chunks FROM v_chunks GROUP BY 1"),
    "session_transcript": with_views("SELECT session_id, string_agg(m.message_id || '|' || role || '|' || coalesce(CAST(attachment_id AS VARCHAR), ''), ';' ORDER BY m.created_at, m.message_id) AS transcript FROM v_messages m LEFT JOIN attachments a ON a.message_id = m.message_id GROUP BY session_id", _ATTACHMENTS),
    "user_images": with_views(
        """SELECT attachment_id, message_id, session_id, created_at, coalesce(size, 0) AS size, total > 5 AS has_more FROM (SELECT a.*, m.session_id, count(*) OVER () AS total FROM attachments a JOIN v_messages m USING (message_id)
           JOIN v_sessions s USING (session_id) WHERE type = 'image' AND s.user_id = 3) ORDER BY created_at DESC, attachment_id LIMIT 5""",
        _ATTACHMENTS,
    ),
    "image_summaries": with_views(
        """SELECT session_id, coalesce(string_agg(text, '|' ORDER BY n) FILTER (used <= 700), '') AS summaries, count(*) FILTER (used <= 700) < count(*) AS left_out
           FROM (SELECT *, sum(strlen(text)) OVER w AS used, row_number() OVER w AS n FROM (SELECT *, row_number() OVER (PARTITION BY session_id, text ORDER BY created_at DESC, attachment_id DESC) AS dup FROM described WHERE text <> '') WHERE dup = 1
           WINDOW w AS (PARTITION BY session_id ORDER BY created_at DESC, attachment_id DESC)) GROUP BY session_id""",
        _ATTACHMENTS,
        "described AS (SELECT m.session_id, a.attachment_id, a.created_at, trim(CASE WHEN a.attachment_id % 11 <> 0 THEN '  scene ' || (a.attachment_id % 7) || repeat(' é', CAST(a.attachment_id % 40 * 20 AS BIGINT)) END) AS text FROM attachments a JOIN v_messages m USING (message_id))",
    ),
}
