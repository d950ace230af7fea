"""Chat sessions: context windows, transcripts, edits and clean-up, for all sessions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_NEWEST = lambda: [F.col("created_at").desc(), F.col("message_id").desc()]
_OLDEST = lambda: [F.col("created_at"), F.col("message_id")]


def _session(order: list[Column]) -> W:
    return W.partitionBy("session_id").orderBy(*order)


def last_messages(messages: DataFrame, n: int = 5) -> DataFrame:
    """The latest ``n`` messages of each session, numbered oldest first."""
    kept = messages.withColumn("__rank", F.row_number().over(_session(_NEWEST()))).filter(F.col("__rank") <= n).drop("__rank")
    return kept.withColumn("position", F.row_number().over(_session(_OLDEST())))


def _window(messages: DataFrame, size: int) -> DataFrame:
    """Live messages with ``__old`` (1 oldest), ``__total`` and ``__in`` (in the context window)."""
    live = messages.filter("NOT coalesce(is_stopped, false)")
    ranked = live.withColumn("__old", F.row_number().over(_session(_OLDEST()))).withColumn("__total", F.count("*").over(W.partitionBy("session_id")))
    recent = F.col("__old") > F.col("__total") - size
    last_answer = F.max(F.when(recent & (F.col("role") == "assistant"), F.col("__old"))).over(W.partitionBy("session_id"))
    ranked = ranked.withColumn("__end", last_answer)
    length = F.col("__end") - (F.col("__total") - size)
    first = F.col("__total") - size + 1 + F.when((length % 2 == 1) & (length > 1), 1).otherwise(0)
    inside = F.when(F.col("__total") <= size, F.lit(True)).otherwise(F.coalesce((F.col("__old") >= first) & (F.col("__old") <= F.col("__end")), F.lit(False)))
    return ranked.withColumn("__first", F.when(F.col("__total") <= size, F.lit(1)).when(F.col("__end").isNull(), F.col("__total") + 1).otherwise(first)).withColumn("__in", inside)


def context_window(messages: DataFrame, size: int = 6) -> DataFrame:
    """Live messages that go with the next request: all up to ``size``; else the last ``size`` without trailing
    messages that aren't answers, and without the oldest if that leaves an odd number over one."""
    return _window(messages, size).filter("__in").drop("__old", "__total", "__end", "__first", "__in")


def summary_work(messages: DataFrame, size: int = 6, every: int = 20) -> DataFrame:
    """Sessions with more live messages than ``size``: the one or two messages just before the window, and how to fold them in."""
    w = _window(messages, size).filter(F.col("__total") > size)
    shown = F.concat(F.when(F.col("role") == "user", F.lit("User: ")).otherwise(F.lit("Assistant: ")), F.coalesce("content", F.lit("")))
    out = w.filter((F.col("__old") < F.col("__first")) & (F.col("__old") >= F.col("__first") - 2))
    parts = F.array_sort(F.collect_list(F.struct("__old", shown.alias("t"))))
    out = out.groupBy("session_id").agg(F.first("__total").alias("total"), F.count("*").alias("evicted"), F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("evicted_text"))
    return out.withColumn("mode", F.when(F.col("total") % every == 0, F.lit("recompress")).otherwise(F.lit("rolling")))


def older_messages(messages: DataFrame, keep: int = 5, cap: int | None = None) -> DataFrame:
    """All but the last ``keep`` messages of each session (of its last ``cap``), as lines of ``role: content``."""
    ranked = messages.withColumn("__rank", F.row_number().over(_session(_NEWEST()))).filter(F.col("__rank") > keep)
    if cap is not None:
        ranked = ranked.filter(F.col("__rank") <= cap)
    lines = F.array_sort(F.collect_list(F.struct((-F.col("__rank")).alias("r"), F.concat("role", F.lit(": "), F.coalesce("content", F.lit(""))).alias("t"))))
    return ranked.groupBy("session_id").agg(F.count("*").alias("messages"), F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("text"))


def list_sessions(sessions: DataFrame, messages: DataFrame, user_id: int | None = None, status: str | None = None, page: int = 1, limit: int = 10) -> DataFrame:
    """A page of sessions, newest updated first, with the latest message, the message count and the number of pages."""
    wanted = sessions
    if user_id is not None:
        wanted = wanted.filter(F.col("user_id") == user_id)
    if status is not None:
        wanted = wanted.filter(F.col("status") == status)
    latest = messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.max_by("content", F.struct("created_at", "message_id")).alias("last_message"))
    total = wanted.agg(F.count("*").alias("total"))
    shown = wanted.orderBy(F.col("updated_at").desc(), "session_id").offset((page - 1) * limit).limit(limit)
    out = shown.join(latest, "session_id", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("session_id", "user_id", "status", "updated_at", F.coalesce("messages", F.lit(0)).alias("messages"), "last_message", "total", F.ceil(F.col("total") / limit).alias("total_pages"))


def mark_last_user_stopped(messages: DataFrame, stopped: DataFrame, at: Column) -> DataFrame:
    """The latest user message of each session of ``stopped(session_id)`` becomes stopped at ``at``."""
    named = messages.join(stopped.select("session_id", F.lit(True).alias("__s")).distinct(), "session_id", "left")
    rank = F.row_number().over(W.partitionBy("session_id", "role").orderBy(*_NEWEST()))
    hit = F.coalesce(F.col("__s"), F.lit(False)) & (F.col("role") == "user") & (rank == 1)
    named = named.withColumn("__hit", hit)
    return named.withColumn("is_stopped", F.col("__hit") | F.coalesce("is_stopped", F.lit(False))).withColumn("stopped_at", F.when(F.col("__hit"), at)).drop("__s", "__hit")


def preceding_user_message(messages: DataFrame) -> DataFrame:
    """For each stopped answer, the latest user message of the session that is strictly older (as-of join by one window)."""
    frame = W.partitionBy("session_id").orderBy(F.unix_micros("created_at")).rangeBetween(W.unboundedPreceding, -1)
    asked = F.max(F.when(F.col("role") == "user", F.struct("created_at", "message_id", "is_stopped"))).over(frame)
    found = messages.withColumn("__asked", asked).filter("role = 'assistant' AND is_stopped")
    return found.select("message_id", "session_id", F.col("__asked.message_id").alias("user_message_id"), F.col("__asked.is_stopped").alias("user_is_stopped"))


def cleanup_stopped(messages: DataFrame) -> DataFrame:
    """Messages that stay when stopped answers go, each with its prompt if that is stopped too (judged on the snapshot)."""
    found = preceding_user_message(messages)
    gone = found.select("message_id").union(found.filter("user_is_stopped").select("user_message_id")).distinct()
    return messages.join(gone, "message_id", "left_anti")


def messages_after_edit(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits(message_id, new_content)`` applied: later answers of the session go, the edited row is no longer stopped."""
    own = edits.join(messages.select("message_id", "session_id", "created_at"), "message_id")
    first = own.groupBy("session_id").agg(F.min("created_at").alias("__edited"))
    kept = messages.join(first, "session_id", "left").filter(F.coalesce((F.col("role") != "assistant") | (F.col("created_at") <= F.col("__edited")), F.lit(True)) | F.col("__edited").isNull())
    new = kept.join(edits.select("message_id", F.col("new_content").alias("__new"), F.lit(True).alias("__hit")), "message_id", "left")
    hit = F.coalesce("__hit", F.lit(False))
    return new.withColumn("content", F.when(hit, F.col("__new")).otherwise(F.col("content"))).withColumn("is_stopped", ~hit & F.coalesce("is_stopped", F.lit(False))).drop("__edited", "__new", "__hit")


def recent_orphan_messages(messages: DataFrame, now: Column, seconds: int = 60) -> DataFrame:
    """The latest answer of each session among those of the last ``seconds``."""
    recent = messages.filter((F.col("role") == "assistant") & (F.col("created_at") >= now - F.make_interval(secs=F.lit(seconds))))
    return recent.withColumn("__rank", F.row_number().over(_session(_NEWEST()))).filter("__rank = 1").drop("__rank")


def incomplete_messages(messages: DataFrame) -> DataFrame:
    """Every message with ``incomplete``: an answer without content, which a clean-up deletes."""
    return messages.withColumn("incomplete", (F.col("role") == "assistant") & (F.coalesce("content", F.lit("")) == ""))


def chunks_in_order(chunks: DataFrame, source_id: int | None = None) -> DataFrame:
    """The chunks of a source (or of each) in their order, as an array of content with heading and place."""
    rows = chunks if source_id is None else chunks.filter(F.col("source_id") == source_id)
    return rows.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "heading", "content"))).alias("chunks"))


def session_transcript(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """One row for each session: its messages in order as an array, each with its attachments' ids in order."""
    files = attachments.groupBy("message_id").agg(F.array_sort(F.collect_list("attachment_id")).alias("files"))
    rows = messages.join(files, "message_id", "left")
    turns = F.array_sort(F.collect_list(F.struct("created_at", "message_id", "role", "content", F.coalesce("files", F.array().cast("array<bigint>")).alias("files"))))
    return rows.groupBy("session_id").agg(turns.alias("turns"))


def user_images(attachments: DataFrame, messages: DataFrame, sessions: DataFrame, user_id: int, page: int = 1, limit: int = 20) -> DataFrame:
    """A page of a user's images, newest first; size from the metadata or 0; whether more follow."""
    own = attachments.filter("type = 'image'").join(messages.select("message_id", "session_id"), "message_id").join(sessions.filter(F.col("user_id") == user_id).select("session_id"), "session_id")
    total = own.agg(F.count("*").alias("total"))
    size = F.coalesce(F.get_json_object("metadata", "$.size").try_cast("long"), F.lit(0))
    shown = own.orderBy(F.col("created_at").desc(), "attachment_id").offset((page - 1) * limit).limit(limit)
    out = shown.crossJoin(F.broadcast(total))  # one row
    return out.select("attachment_id", "message_id", "session_id", "created_at", size.alias("size"), (F.col("total") > page * limit).alias("has_more"))


def image_summaries(analyses: DataFrame, attachments: DataFrame, messages: DataFrame, budget: int = 5120) -> DataFrame:
    """Distinct image descriptions of each session, newest first, as long as they fit ``budget`` bytes of UTF-8."""
    rows = analyses.join(attachments.select("attachment_id", "message_id", F.col("created_at").alias("attached_at")), "attachment_id")
    rows = rows.join(messages.select("message_id", "session_id", F.col("created_at").alias("sent_at")), "message_id")
    rows = rows.withColumn("text", F.trim(F.get_json_object("scene_description", "$.description"))).filter("text <> ''")
    order = [F.col("sent_at").desc(), F.col("attached_at").desc(), F.col("analysed_at").desc(), F.col("analysis_id").desc()]
    first = rows.withColumn("__dup", F.row_number().over(W.partitionBy("session_id", "text").orderBy(*order))).filter("__dup = 1")
    newest = W.partitionBy("session_id").orderBy(*order)
    used = first.withColumn("__used", F.sum(F.octet_length("text")).over(newest.rowsBetween(W.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(newest))
    fits = F.when(F.col("__used") <= budget, F.struct("__n", "text"))
    out = used.groupBy("session_id").agg(F.array_sort(F.collect_list(fits)).alias("kept"), F.count("*").alias("found"))
    return out.select("session_id", F.transform("kept", lambda k: k["text"]).alias("summaries"), (F.size("kept") < F.col("found")).alias("left_out"))
