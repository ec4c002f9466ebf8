"""State changes of the job lane as set operations: a table of requests meets a table of states.

Each change returns all states, changed or not, with `applied`: whether a request changed the row. A
request has the row's key; requests that hold a lease name its token. Of several requests for one row
the caller sends one. Null tokens never match. Without requests nothing changes; requests for rows
that aren't there change nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import retry_delay
from docweave.operators.parsing import signature

# Error codes after which an item may run again; limits; headers of a signed delivery.
RETRYABLE = ("billing_unavailable", "ocr_provider_error", "internal_error")
METADATA_BYTES = 16_384
MOST_BACKOFF = 300
ERROR_CHARACTERS = 1000
ROTATION_HOURS = 24
HEADERS = ("svix-id", "svix-timestamp", "svix-signature", "webhook-id", "webhook-timestamp", "webhook-signature", "content-type")


def changed(rows: DataFrame, requests: DataFrame, key: str | list[str], when: Column, values: dict[str, Column]) -> DataFrame:
    """rows left joined to requests (columns named r_*): where `when` holds, columns take `values`."""
    keys = [key] if isinstance(key, str) else key
    named = requests.select(*(F.col(c) if c in keys else F.col(c).alias(f"r_{c}") for c in requests.columns)).withColumn("r_there", F.lit(True))
    met = rows.join(named, keys, "left").withColumn("applied", F.coalesce(F.col("r_there") & when, F.lit(False)))
    types = dict(rows.dtypes)
    return met.select(*(F.when(F.col("applied"), values[c].cast(types[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns), "applied")


def _leased(status: str) -> Column:
    return (F.col("status") == status) & (F.col("lease_token") == F.col("r_token"))


def _released() -> dict[str, Column]:
    return {"lease_token": F.lit(None), "lease_expires_at": F.lit(None)}


def _after(now: Column, seconds: Column) -> Column:
    return now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def heartbeat(items: DataFrame, requests: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """requests: item_id, token. The lease of a running item runs on from now."""
    return changed(items, requests, "item_id", _leased("running"), {"lease_expires_at": _after(now, F.lit(seconds))})


def reschedule(items: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """requests: item_id, token, backoff_s, error_code. A running item waits again, without a lease."""
    values = {"status": F.lit("pending"), "run_after": _after(now, F.col("r_backoff_s")), "error_code": F.col("r_error_code"), **_released()}
    return changed(items, requests, "item_id", _leased("running"), values)


def finish(items: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """requests: item_id, token, outcome (succeeded or failed), error_code. A running item ends."""
    values = {"status": F.col("r_outcome"), "error_code": F.col("r_error_code"), "completed_at": now, **_released()}
    return changed(items, requests, "item_id", _leased("running"), values)


def cancel(items: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """requests: batch_id, customer_id. Items that wait are cancelled; running ones end on their own."""
    mine = (F.col("customer_id") == F.col("r_customer_id")) & (F.col("status") == "pending")
    return changed(items, requests, "batch_id", mine, {"status": F.lit("cancelled"), "completed_at": F.coalesce(F.col("completed_at"), now)})


def attempt_failed(deliveries: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """requests: delivery_id, token, status_code, error. The next attempt by the ladder, or the end of it.

    Lost leases change nothing. Messages are cut to a fixed length; empty ones are null.
    """
    done = F.col("attempts") + 1
    delay = retry_delay(done)
    values = {
        "status": F.when(delay.isNull(), "failed").otherwise("pending"),
        "attempts": done,
        "next_attempt_at": _after(now, F.coalesce(delay, F.lit(0))),
        "last_status_code": F.col("r_status_code"),
        "last_error": F.nullif(F.left(F.col("r_error"), F.lit(ERROR_CHARACTERS)), F.lit("")),
        **_released(),
    }
    return changed(deliveries, requests, "delivery_id", _leased("delivering"), values)


def attempt_succeeded(deliveries: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """requests: delivery_id, token, status_code."""
    values = {"status": F.lit("succeeded"), "last_status_code": F.col("r_status_code"), "last_error": F.lit(None), "attempts": F.col("attempts") + 1, "succeeded_at": now, **_released()}
    return changed(deliveries, requests, "delivery_id", _leased("delivering"), values)


def delivery_cancelled(deliveries: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: delivery_id, token. For endpoints that were disabled by the time of sending."""
    return changed(deliveries, requests, "delivery_id", _leased("delivering"), {"status": F.lit("cancelled"), "last_error": F.lit("endpoint disabled"), **_released()})


def due_deliveries(deliveries: DataFrame, endpoints: DataFrame, now: Column, n: int) -> DataFrame:
    """The n oldest due deliveries, and whether their endpoint (null: a direct target) still takes them."""
    due = ((F.col("status") == "pending") & (F.col("next_attempt_at") <= now)) | ((F.col("status") == "delivering") & (F.col("lease_expires_at") < now))
    first = deliveries.where(due).orderBy("next_attempt_at", "delivery_id").limit(n)
    live = endpoints.select("endpoint_id", (F.col("enabled") & F.col("deleted_at").isNull()).alias("endpoint_enabled"))
    return first.join(live, "endpoint_id", "left")


def leased(due: DataFrame, now: Column, seconds: int, token: Column) -> DataFrame:
    """Claimed deliveries: delivering, with a token and the end of the lease."""
    return due.withColumn("status", F.lit("delivering")).withColumn("lease_token", token).withColumn("lease_expires_at", _after(now, F.lit(seconds)))


def create_batches(requests: DataFrame, now: Column, ttl_seconds: int) -> tuple[DataFrame, DataFrame]:
    """requests: batch_id, customer_id, files (array), idempotency_key, ... : new batches and their items in order.

    Requests without files make nothing. A key that a customer sends twice makes the batch of the smallest id.
    """
    w = Window.partitionBy("customer_id", "idempotency_key").orderBy("batch_id")
    fresh = requests.where(F.size("files") > 0).withColumn("_r", F.row_number().over(w)).where("_r = 1 or idempotency_key is null").drop("_r")
    batches = fresh.select(*(c for c in fresh.columns if c != "files"), F.lit("pending").alias("status"), F.size("files").alias("total_items"), now.alias("created_at"), _after(now, F.lit(ttl_seconds)).alias("expires_at"))
    items = fresh.select("batch_id", "customer_id", F.posexplode("files").alias("position", "file_id")).withColumn("status", F.lit("pending")).withColumn("attempts", F.lit(0))
    return batches, items


def create_files(requests: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """requests: file_id, customer_id, ...: upload slots that expire."""
    return requests.select("*", F.lit("pending_upload").alias("status"), F.lit(None).cast("string").alias("sha256"), now.alias("created_at"), _after(now, F.lit(ttl_seconds)).alias("expires_at"))


def mark_uploaded(files: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: file_id, customer_id, sha256. Only a pending slot changes; a null hash keeps the old one."""
    mine = (F.col("customer_id") == F.col("r_customer_id")) & (F.col("status") == "pending_upload")
    return changed(files, requests, "file_id", mine, {"status": F.lit("uploaded"), "sha256": F.coalesce(F.col("r_sha256"), F.col("sha256"))})


def heal_uploads(files: DataFrame, heads: DataFrame) -> DataFrame:
    """heads: file_id, found, etag, of a look at the store: slots whose object is there become uploaded."""
    return changed(files, heads, "file_id", (F.col("status") == "pending_upload") & F.col("r_found"), {"status": F.lit("uploaded"), "sha256": F.coalesce(F.col("r_etag"), F.col("sha256"))})


def owned(rows: DataFrame, **keys: object) -> DataFrame:
    """Point lookup: rows whose columns equal all of keys."""
    for name, value in keys.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows


def active_endpoints(endpoints: DataFrame) -> DataFrame:
    return endpoints.where("deleted_at is null")


def endpoint_counts(endpoints: DataFrame) -> DataFrame:
    """Active endpoints of each customer."""
    return active_endpoints(endpoints).groupBy("customer_id").agg(F.count("*").alias("n"))


def _own_endpoint() -> Column:
    return (F.col("customer_id") == F.col("r_customer_id")) & F.col("deleted_at").isNull()


def update_endpoints(endpoints: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """requests: endpoint_id, customer_id, url, enabled; null leaves a value as it is."""
    values = {"url": F.coalesce(F.col("r_url"), F.col("url")), "enabled": F.coalesce(F.col("r_enabled"), F.col("enabled")), "updated_at": now}
    return changed(endpoints, requests, "endpoint_id", _own_endpoint(), values)


def delete_endpoints(endpoints: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """requests: endpoint_id, customer_id. The row stays, with its secret, and takes nothing any more."""
    return changed(endpoints, requests, "endpoint_id", _own_endpoint(), {"deleted_at": now, "enabled": F.lit(False), "updated_at": now})


def rotate_secrets(endpoints: DataFrame, requests: DataFrame, now: Column, hours: int = ROTATION_HOURS) -> DataFrame:
    """requests: endpoint_id, customer_id, secret. The old secret signs as well until the overlap ends."""
    values = {"old_secret": F.col("secret"), "old_secret_expires_at": _after(now, F.lit(3600 * hours)), "secret": F.col("r_secret"), "updated_at": now}
    return changed(endpoints, requests, "endpoint_id", _own_endpoint(), values)


def pings(endpoints: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """requests: ping_id, endpoint_id, customer_id: synthetic events without a batch, and a delivery of each."""
    live = active_endpoints(endpoints).select("endpoint_id", "customer_id", "url")
    met = requests.join(live, ["endpoint_id", "customer_id"])
    events = met.select(F.concat(F.lit("msg_"), "ping_id").alias("event_id"), "customer_id", F.lit(None).cast("long").alias("batch_id"), F.lit("webhook.ping").alias("event_type"), ping_body(F.col("ping_id")).alias("body"))
    deliveries = met.select(F.concat(F.lit("msg_"), "ping_id").alias("event_id"), "endpoint_id", "customer_id", "url", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), now.alias("next_attempt_at"))
    return events, deliveries


def iso_z(at: Column) -> Column:
    """A UTC time as text with Z; a fraction only where there is one."""
    at = at.cast("timestamp")
    micros = F.pmod(F.unix_micros(at), F.lit(1_000_000))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit("Z"))


def ping_body(ping_id: Column) -> Column:
    return F.to_json(F.struct(F.lit("webhook.ping").alias("type"), F.concat(F.lit("ping_"), ping_id).alias("batch_id")))


def batch_update_body(batch_id: Column, status: Column, counts: Column, total: Column, metadata: Column, completed_at: Column, expires_at: Column) -> Column:
    """The event of a finished batch; absent values are written as null."""
    fields = F.struct(F.lit("batch.update").alias("type"), batch_id.alias("batch_id"), status.alias("status"), counts.alias("counts"), total.alias("total_items"), metadata.alias("metadata"), iso_z(completed_at).alias("completed_at"), iso_z(expires_at).alias("results_expires_at"))
    return F.to_json(fields, {"ignoreNullFields": "false"})


def mode(x: Column) -> Column:
    """The stored name of a delivery mode; none stays null."""
    return F.when(x == "registered", "svix").otherwise(x)


def metadata_error(body: Column) -> Column:
    """Why serialized metadata can't be taken, null if it can."""
    size = F.octet_length(body)
    return F.when(size > METADATA_BYTES, F.concat(F.lit("metadata is "), size.cast("string"), F.lit(f" bytes serialized; the maximum is {METADATA_BYTES} (it is echoed into every webhook delivery)")))


def backoff_range(attempts: Column) -> Column:
    """(base, most): seconds before an item runs again lie between; the base doubles up to a limit."""
    base = F.least(F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))), F.lit(float(MOST_BACKOFF))).cast("int")
    return F.struct(base.alias("base"), (2 * base).alias("most"))


def is_retryable(code: Column) -> Column:
    return F.coalesce(code.isin(*RETRYABLE), F.lit(False))


def projected_item(result_of: str = "/v1/batches/") -> Column:
    """An item as its API shows it: a result only if it succeeded, an error only if there is one."""
    url = F.regexp_replace("url", "[?#].*$", "")
    result = F.when(F.col("status") == "succeeded", F.concat(F.lit(result_of), F.col("batch_id").cast("string"), F.lit("/items/"), F.col("item_id").cast("string"), F.lit("/result")))
    error = F.when(F.coalesce(F.col("error_code"), F.lit("")) != "", F.struct(F.col("error_code").alias("code"), F.col("error_message").alias("message")))
    return F.struct(F.lit("batch_item").alias("object"), F.col("item_id").alias("id"), "batch_id", "position", url.alias("url"), "status", "attempts", result.alias("result_url"), error.alias("error"))


def projected_batch() -> Column:
    options = F.struct("extract_text", "chunking", F.coalesce("chunk_size", F.lit(1000)).alias("chunk_size"))
    return F.struct(F.lit("batch").alias("object"), F.col("batch_id").alias("id"), "status", "total_items", options.alias("options"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), F.date_format("completed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("completed_at"))


def signature_headers(attempts: DataFrame) -> DataFrame:
    """attempts: msg_id, at, body, secrets (array of text): the same with `headers`, each secret's signature in order."""
    @F.pandas_udf("array<string>")
    def signed(msg_id: pd.Series, at: pd.Series, body: pd.Series, secrets: pd.Series) -> pd.Series:
        return pd.Series([[signature(s.encode(), m, int(t), b) for s in ss] for m, t, b, ss in zip(msg_id, at, body, secrets, strict=True)])

    signatures = F.array_join("_signed", " ")
    values = (F.col("msg_id"), F.col("at").cast("string"), signatures, F.col("msg_id"), F.col("at").cast("string"), signatures, F.lit("application/json"))
    pairs = [x for name, value in zip(HEADERS, values, strict=True) for x in (F.lit(name), value)]
    return attempts.withColumn("_signed", signed("msg_id", "at", "body", "secrets")).withColumn("headers", F.create_map(*pairs)).drop("_signed")


def create_endpoints(requests: DataFrame, now: Column) -> DataFrame:
    """requests: endpoint_id, customer_id, url, secret: enabled endpoints."""
    none = F.lit(None)
    return requests.select("endpoint_id", "customer_id", "url", "secret", F.lit(True).alias("enabled"), none.cast("string").alias("old_secret"), none.cast("timestamp_ntz").alias("old_secret_expires_at"), none.cast("timestamp_ntz").alias("deleted_at"), now.alias("created_at"), now.alias("updated_at"))
