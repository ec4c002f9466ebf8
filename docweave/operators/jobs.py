"""The job lane: status rollups, keyset pages, leases, outbox, retries and limits, over ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import RETRY_LADDER, retry_delay

# States of items and batches.
STATES = ("pending", "running", "succeeded", "failed", "cancelled")
TERMINAL = ("completed", "partially_failed", "failed", "cancelled")


def status_counts(items: DataFrame, key: str = "batch_id") -> DataFrame:
    """Items of each batch by state, zero where there are none."""
    return items.groupBy(key).agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATES))


def batch_status(current: Column | None = None) -> Column:
    """A batch's status from its counts; a terminal one stays."""
    open_ = (F.col("pending") == 0) & (F.col("running") == 0)
    none_done = (F.col("succeeded") + F.col("failed") + F.col("cancelled")) == 0
    status = (
        F.when(open_ & none_done, "pending").when(open_ & (F.col("failed") == 0) & (F.col("cancelled") == 0), "completed").when(open_ & (F.col("succeeded") == 0) & (F.col("cancelled") == 0), "failed")
        .when(open_ & (F.col("succeeded") == 0), "cancelled").when(open_, "partially_failed").when(F.col("running") > 0, "running")
    )
    rest = F.lit("pending") if current is None else F.coalesce(current, F.lit("pending"))
    status = status.otherwise(rest)
    return status if current is None else F.when(current.isin(*TERMINAL), current).otherwise(status)


def keyset_page(rows: DataFrame, at: str, key: str, after: tuple | None, n: int, descending: bool = False) -> DataFrame:
    """The next n rows in order of (at, key) after a cursor's values; n + 1 tell whether more follow."""
    if after is not None:
        here, there = F.struct(F.col(at), F.col(key)), F.struct(F.lit(after[0]).cast(rows.schema[at].dataType).alias(at), F.lit(after[1]).cast(rows.schema[key].dataType).alias(key))
        rows = rows.where(here < there if descending else here > there)
    order = [F.desc(at), F.desc(key)] if descending else [F.asc(at), F.asc(key)]
    return rows.orderBy(*order).limit(n)


def claimable(items: DataFrame, now: Column) -> DataFrame:
    """Items that a worker may take: pending and due, or running on a lease that has run out."""
    return items.where(((F.col("status") == "pending") & (F.coalesce(F.col("run_after"), now) <= now)) | ((F.col("status") == "running") & (F.col("lease_expires_at") < now)))


def claim_order(items: DataFrame, now: Column, n: int) -> DataFrame:
    return claimable(items, now).orderBy("item_id").limit(n)


def oldest_due_age(deliveries: DataFrame, now: Column) -> DataFrame:
    """Seconds that the oldest due delivery has waited, 0 at least; null if none waits."""
    age = now.cast("timestamp").cast("long") - F.min("next_attempt_at").cast("timestamp").cast("long")
    return deliveries.where("status = 'pending'").agg(F.when(F.min("next_attempt_at").isNotNull(), F.greatest(age, F.lit(0))).alias("age_s"))


def outbox_events(batches: DataFrame, endpoints: DataFrame) -> DataFrame:
    """One event per finished batch and type, fanned out to the customer's enabled endpoints, or one direct delivery."""
    done = batches.where(F.col("status").isin(*TERMINAL) & F.col("webhook_mode").isin("registered", "direct")).select("batch_id", "customer_id", "webhook_mode", F.concat(F.lit("batch."), "status").alias("event_type")).dropDuplicates(["batch_id", "event_type"])
    live = endpoints.where("enabled and deleted_at is null").select("customer_id", "endpoint_id")
    sent = done.where("webhook_mode = 'registered'").join(live, "customer_id").select("batch_id", "event_type", "endpoint_id")
    return sent.union(done.where("webhook_mode = 'direct'").select("batch_id", "event_type", F.lit(None).cast(live.schema["endpoint_id"].dataType)))


def missing_events(batches: DataFrame, events: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """Batches that ended between a day and a quarter of an hour ago and have no event, oldest first."""
    due = batches.where(F.col("status").isin(*TERMINAL) & F.col("completed_at").between(now - F.expr("interval 24 hours"), now - F.expr("interval 15 minutes")))
    return due.join(events.select("batch_id").distinct(), "batch_id", "left_anti").orderBy("completed_at", "batch_id").limit(limit).select("batch_id")


def deliveries_with_context(deliveries: DataFrame, events: DataFrame, batches: DataFrame) -> DataFrame:
    return deliveries.join(events, "event_id").join(batches.select("batch_id", F.col("status").alias("batch_status")), "batch_id", "left")


def rate_limited(requests: DataFrame, who: str, at: str, key: str, per_second: int) -> DataFrame:
    """allowed: among the first requests of its second."""
    second = F.date_trunc("second", at)
    w = Window.partitionBy(who, second).orderBy(at, key)
    return requests.select(who, second.alias("window_start"), key, (F.row_number().over(w) <= per_second).alias("allowed"))


def retry_outcome(attempts: Column, retryable: Column, most: int = 3) -> Column:
    return F.when(~retryable | (attempts >= most), "failed").otherwise("retry")


def resend_outcome(status: Column, expired: Column) -> Column:
    return F.when(status.isNull(), "not_found").when(status == "delivering", "in_flight").when(expired, "results_expired").when(status == "pending", "nudged").otherwise("requeued")


def first_by_key(batches: DataFrame) -> DataFrame:
    """The first batch of each customer and idempotency key; batches without a key all stay."""
    w = Window.partitionBy("customer_id", "idempotency_key").orderBy("created_at", "batch_id")
    return batches.withColumn("_r", F.row_number().over(w)).where("_r = 1 or idempotency_key is null").drop("_r")


def delivery_delays(events: DataFrame) -> DataFrame:
    return events.select("*", retry_delay(F.col("attempts")).alias("delay_s"), F.when(F.col("attempts") > len(RETRY_LADDER), "exhausted").otherwise("scheduled").alias("outcome"))
