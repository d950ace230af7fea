"""Usage, cost, growth and listing reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Price of one token by model; unknown models cost what the small one does.
PRICING = {"gpt-4o": ("0.000005", "0.000015"), "gpt-4o-mini": ("0.0000015", "0.0000075")}
DEFAULT_MODEL = "gpt-4o-mini"
AVATAR = "https://api.dicebear.com/7.x/avataaars/svg?seed="


def user_chat_stats(users: DataFrame, sessions: DataFrame, messages: DataFrame, pricing: dict[str, tuple[str, str]] = PRICING) -> DataFrame:
    """Sessions, messages, tokens and price of each user; users without any stay. Messages are summed by session first."""
    answer = F.col("role") == "assistant"
    prompt, completion = (F.when(answer, F.coalesce(c, F.lit(0))).otherwise(0).cast("long") for c in ("prompt_tokens", "completion_tokens"))

    def rate(i: int) -> Column:
        price = F.lit(pricing[DEFAULT_MODEL][i]).cast("decimal(12,9)")
        for model, rates in pricing.items():
            price = F.when(F.col("model") == model, F.lit(rates[i]).cast("decimal(12,9)")).otherwise(price)
        return price

    price = prompt.cast("decimal(18,0)") * rate(0) + completion.cast("decimal(18,0)") * rate(1)
    by_session = messages.groupBy("session_id").agg(F.count("*").alias("m"), F.sum(prompt).alias("p"), F.sum(completion).alias("c"), F.sum(price).alias("price"))
    by_user = sessions.join(by_session, "session_id", "left").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("m").alias("m"), F.sum("p").alias("p"), F.sum("c").alias("c"), F.sum("price").alias("price"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = users.select("user_id", "email").join(by_user, "user_id", "left")
    return out.select(
        "user_id", "email", zero("sessions").alias("total_sessions"), zero("m").alias("total_messages"), zero("p").alias("user_tokens"), zero("c").alias("system_tokens"),
        (zero("p") + zero("c")).alias("total_tokens"), F.round(F.coalesce("price", F.lit(0)), 4).cast("double").alias("total_price"),
    )


def _counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("user_id").agg(F.count("*").alias(name))


def full_name(first: str, last: str) -> Column:
    return F.trim(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit(""))))


def users_overview(users: DataFrame, uploads: DataFrame, sessions: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each user with upload and session counts, first plan (else free) and avatar; counted apart, so nothing fans out."""
    plan = subscriptions.groupBy("user_id").agg(F.min_by("plan_name", F.struct("created_at", "subscription_id")).alias("plan"))
    out = users.join(_counts(uploads, "uploads"), "user_id", "left").join(_counts(sessions, "sessions"), "user_id", "left").join(plan, "user_id", "left")
    return out.select(
        "user_id", full_name("first_name", "last_name").alias("name"), "email", "role", F.concat(F.lit(AVATAR), F.coalesce("first_name", F.lit("User"))).alias("profile_image"), F.lower("status").alias("status"),
        F.coalesce("uploads", F.lit(0)).alias("uploads"), F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("plan", F.lit("free")).alias("subscription_plan"),
    )


def dashboard_counts(users: DataFrame, uploads: DataFrame, sessions: DataFrame, subscriptions: DataFrame, now: Column) -> DataFrame:
    """One row of totals; one aggregate over each table."""
    roles = ["civilian", "military", "student", "admin"]
    people = users.agg(F.count("*").alias("total_users"), F.count_if(F.col("status") == "ACTIVE").alias("active_users"), F.count_if(F.col("created_at") >= F.add_months(now, -1)).alias("new_users"), *[F.count_if(F.col("role") == r).alias(f"{r}_users") for r in roles])
    files = uploads.agg(F.count("*").alias("uploads"), F.count_if(F.col("status") == "ready").alias("ready_uploads"))
    chats = sessions.agg(F.count_if(F.col("status") == "active").alias("active_sessions"))
    plans = subscriptions.agg(F.count_if(F.col("status") == "active").alias("active_subscriptions"))
    return people.crossJoin(files).crossJoin(chats).crossJoin(plans)  # one row each


def trend_counts(df: DataFrame, date_col: str, year: int | None = None, month: int | None = None) -> DataFrame:
    """Rows by year, or by month of ``year`` (or one month of it), from the half-open range; empty buckets are absent."""
    day = F.col(date_col)
    if year is None:
        bucket = F.date_format(day, "yyyy")
    else:
        start = f"{year}-{month or 1:02d}-01"
        df = df.filter((day >= F.to_timestamp(F.lit(start))) & (day < F.add_months(F.to_date(F.lit(start)), 1 if month else 12).cast("timestamp")))
        bucket = F.date_format(day, "yyyy-MM")
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).orderBy("bucket")


def list_uploads(uploads: DataFrame, users: DataFrame, group_rows: int = 100_000) -> DataFrame:
    """Uploads numbered by (uploaded_at, id), with owner's name and upper-case extension.

    Numbers come from two levels, so that no task orders the whole table: within blocks of dates, plus the counts before.
    """
    block = F.date_trunc("month", "uploaded_at")
    counts = uploads.groupBy(block.alias("__block")).count()
    before = counts.withColumn("__before", F.sum("count").over(W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1))).select("__block", "__before")  # a row for each month
    number = F.row_number().over(W.partitionBy("__block").orderBy("uploaded_at", "upload_id"))
    rows = uploads.withColumn("__block", block).withColumn("__n", number).join(F.broadcast(before), "__block")
    rows = rows.join(users.select("user_id", "first_name", "last_name"), "user_id", "left")
    return rows.select((F.col("__n") + F.coalesce("__before", F.lit(0))).cast("string").alias("id"), "user_id", full_name("first_name", "last_name").alias("user_name"), "file_name", F.upper(F.substring_index("file_name", ".", -1)).alias("file_type"), "file_size", "status")


def page(df: DataFrame, order: list[Column], page: int = 1, limit: int = 10) -> DataFrame:
    """One page in ``order`` with total and number of pages."""
    total = df.agg(F.count("*").alias("total"))
    out = df.orderBy(*order).offset((page - 1) * limit).limit(limit).crossJoin(F.broadcast(total))  # one row
    return out.withColumn("total_pages", F.ceil(F.col("total") / limit))


def page_after(df: DataFrame, key: str, after: object, limit: int = 10) -> DataFrame:
    """The keyset form for deep pages: rows beyond the last key seen."""
    return df.filter(F.col(key) > after).orderBy(key).limit(limit)


def batch_job_summary(jobs: DataFrame) -> DataFrame:
    """Jobs of each batch by status, and whether all have ended."""
    done = F.col("status").isin("completed", "failed")
    states = ["queued", "processing", "completed", "failed"]
    return jobs.groupBy("batch_id").agg(F.count("*").alias("jobs"), *[F.count_if(F.col("status") == s).alias(s) for s in states], F.bool_and(done).alias("all_done"))


def latest_job_status(events: DataFrame) -> DataFrame:
    """The last status of each job: the batch form of the status stream."""
    return events.groupBy("job_id").agg(F.max_by(F.struct("batch_id", "status", "ts"), F.struct("ts", "event_id")).alias("e")).select("job_id", "e.*")


def stalled_jobs(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Events that left a job open for longer than ``gap``."""
    nxt = F.lead("ts").over(W.partitionBy("job_id").orderBy("ts", "event_id"))
    late = F.coalesce(F.col("ts") + F.expr(f"INTERVAL {gap}") < F.col("next_ts"), F.lit(True))
    return events.withColumn("next_ts", nxt).filter(~F.col("status").isin("completed", "failed") & late).select("event_id", "job_id", "status", "ts", "next_ts")


def batch_completion(events: DataFrame) -> DataFrame:
    """Batches by the last status of their jobs."""
    return batch_job_summary(latest_job_status(events))
