"""State changes of the job lane over tables derived from events, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import lane as L



def _now():
    return F.expr("timestamp_ntz '2024-06-01 00:00:00'")


_STATUS = "case event_type when 'view' then 'pending' when 'click' then 'running' when 'purchase' then 'succeeded' when 'error' then 'failed' else 'cancelled' end"
_DELIVERY = "case event_type when 'view' then 'pending' when 'click' then 'delivering' when 'purchase' then 'succeeded' when 'error' then 'failed' else 'cancelled' end"


def _events(s, d):
    return s.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _items(s, d):
    return _events(s, d).selectExpr(
        "event_id item_id", "user_id batch_id", "user_id % 5 customer_id", f"{_STATUS} status", "case when event_type = 'click' then concat('l', event_id % 4) end lease_token", "ts lease_expires_at",
        "cast(null as timestamp_ntz) run_after", "cast(null as string) error_code", "case when event_type = 'error' then ts end completed_at",
    )


def _deliveries(s, d):
    return _events(s, d).selectExpr(
        "event_id delivery_id", "user_id % 12 endpoint_id", f"{_DELIVERY} status", "case when event_type = 'click' then concat('l', event_id % 4) end lease_token", "ts lease_expires_at",
        "cast(event_id % 10 as int) attempts", "ts next_attempt_at", "cast(null as int) last_status_code", "'before' last_error", "cast(null as timestamp_ntz) succeeded_at",
    )


def _endpoints(s, d):
    return _events(s, d).where("event_type = 'signup'").selectExpr(
        "event_id endpoint_id", "user_id % 50 customer_id", "concat('https://hooks.example.org/', event_id) url", "concat('s', event_id) secret", "event_id % 4 <> 0 enabled", "cast(null as string) old_secret",
        "cast(null as timestamp_ntz) old_secret_expires_at", "case when event_id % 7 = 0 then ts end deleted_at", "ts created_at", "ts updated_at",
    )


def _files(s, d):
    return _events(s, d).selectExpr("event_id file_id", "user_id % 5 customer_id", "case when event_type = 'view' then 'uploaded' else 'pending_upload' end status", "case when event_id % 2 = 0 then 'old' end sha256")


def _asks(s, d, key, *more):
    return _events(s, d).where("event_id % 3 <> 0").selectExpr(f"event_id {key}", "concat('l', event_id % 5) token", *more)


def _when(column):
    return F.date_format(F.col(column).cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias(column)


def lease_heartbeats(s, d):
    return L.heartbeat(_items(s, d), _asks(s, d, "item_id"), _now(), 90).select("item_id", "status", _when("lease_expires_at"), "applied")


def item_reschedules(s, d):
    got = L.reschedule(_items(s, d), _asks(s, d, "item_id", "cast(event_id % 200 as int) backoff_s", "'internal_error' error_code"), _now())
    return got.select("item_id", "status", _when("run_after"), "error_code", "lease_token", "applied")


def item_endings(s, d):
    got = L.finish(_items(s, d), _asks(s, d, "item_id", "if(event_id % 2 = 0, 'succeeded', 'failed') outcome", "if(event_id % 2 = 0, null, 'page_limit_exceeded') error_code"), _now())
    return got.select("item_id", "status", "error_code", "lease_token", _when("completed_at"), "applied")


def batch_cancellations(s, d):
    asks = _events(s, d).selectExpr("user_id batch_id").distinct().where("batch_id % 2 = 0").selectExpr("batch_id", "batch_id % 4 customer_id")
    return L.cancel(_items(s, d), asks, _now()).select("item_id", "status", _when("completed_at"), "applied")


def delivery_failures(s, d):
    asks = _asks(s, d, "delivery_id", "if(event_id % 2 = 0, 503, null) status_code", "case event_id % 4 when 0 then repeat('x', 1500) when 1 then '' when 2 then 'timeout' end error")
    got = L.attempt_failed(_deliveries(s, d), asks, _now())
    return got.select("delivery_id", "status", "attempts", _when("next_attempt_at"), "last_status_code", F.length("last_error").alias("error_length"), "applied")


def delivery_successes(s, d):
    got = L.attempt_succeeded(_deliveries(s, d), _asks(s, d, "delivery_id", "200 status_code"), _now())
    return got.select("delivery_id", "status", "attempts", "last_status_code", "last_error", _when("succeeded_at"), "applied")


def delivery_cancellations(s, d):
    return L.delivery_cancelled(_deliveries(s, d), _asks(s, d, "delivery_id")).select("delivery_id", "status", "last_error", "lease_token", "applied")


def due_deliveries(s, d):
    ends = s.range(11).selectExpr("id endpoint_id", "id % 4 <> 0 enabled", "case when id = 7 then current_timestamp() end deleted_at")
    due = L.due_deliveries(_deliveries(s, d), ends, F.expr("timestamp_ntz '2024-01-20 00:00:00'"), 40)
    return L.leased(due, _now(), 60, F.concat(F.lit("t"), F.col("delivery_id").cast("string"))).select("delivery_id", "status", "lease_token", "endpoint_enabled", _when("lease_expires_at"))


def _requests(s, d):
    by = _events(s, d).groupBy((F.col("event_id") / 7).cast("long").alias("batch_id"))
    return by.agg(F.min(F.expr("user_id % 5")).alias("customer_id"), F.sort_array(F.collect_list(F.expr("case when event_type <> 'click' then event_id end"))).alias("files")).withColumn("idempotency_key", F.expr("case when batch_id % 3 = 0 then concat('k', batch_id % 40) end"))


def created_batches(s, d):
    return L.create_batches(_requests(s, d), _now(), 86400)[0].select("batch_id", "customer_id", "status", "total_items", _when("expires_at"))


def created_items(s, d):
    return L.create_batches(_requests(s, d), _now(), 86400)[1]


def created_files(s, d):
    asks = _events(s, d).selectExpr("event_id file_id", "user_id customer_id")
    return L.create_files(asks, _now(), 3600).select("file_id", "customer_id", "status", "sha256", _when("expires_at"))


def uploaded_files(s, d):
    asks = _events(s, d).where("event_id % 3 <> 0").selectExpr("event_id file_id", "user_id % 4 customer_id", "case when event_id % 5 = 0 then 'new' end sha256")
    return L.mark_uploaded(_files(s, d), asks)


def healed_uploads(s, d):
    heads = _events(s, d).where("event_id % 3 <> 0").selectExpr("event_id file_id", "event_id % 2 = 0 found", "case when event_id % 5 = 0 then 'etag' end etag")
    return L.heal_uploads(_files(s, d), heads)


def file_lookup(s, d):
    return L.owned(_files(s, d), file_id=7, customer_id=_files(s, d).where("file_id = 7").first()["customer_id"]).union(L.owned(_files(s, d), file_id=8, customer_id=-1))


def item_lookup(s, d):
    return L.owned(_items(s, d), batch_id=11, customer_id=1).select("item_id", "batch_id", "status")


def endpoint_counts(s, d):
    return L.endpoint_counts(_endpoints(s, d))


def endpoint_list(s, d):
    return L.owned(L.active_endpoints(_endpoints(s, d)), customer_id=3).orderBy("created_at", "endpoint_id").select("endpoint_id", "url", "enabled")


def endpoint_creations(s, d):
    asks = _events(s, d).where("event_type = 'signup'").selectExpr("event_id endpoint_id", "user_id customer_id", "concat('https://a.example.org/', event_id) url", "'s' secret")
    return L.create_endpoints(asks, _now()).select("endpoint_id", "customer_id", "url", "enabled", "old_secret", _when("created_at"))


def _owners(s, d, *more):
    return _events(s, d).where("event_type = 'signup' and event_id % 3 <> 0").selectExpr("event_id endpoint_id", "case when event_id % 5 = 0 then -1 else user_id % 50 end customer_id", *more)


def endpoint_updates(s, d):
    asks = _owners(s, d, "case when event_id % 2 = 0 then 'https://new.example.org/' end url", "case when event_id % 11 = 0 then false end enabled")
    return L.update_endpoints(_endpoints(s, d), asks, _now()).select("endpoint_id", "url", "enabled", _when("updated_at"), "applied")


def endpoint_deletions(s, d):
    return L.delete_endpoints(_endpoints(s, d), _owners(s, d), _now()).select("endpoint_id", "enabled", _when("deleted_at"), "applied")


def secret_rotations(s, d):
    return L.rotate_secrets(_endpoints(s, d), _owners(s, d, "'fresh' secret"), _now()).select("endpoint_id", "secret", "old_secret", _when("old_secret_expires_at"), "applied")


def ping_events(s, d):
    return L.pings(_endpoints(s, d), _owners(s, d, "concat('p', event_id) ping_id"), _now())[0]


def ping_deliveries(s, d):
    return L.pings(_endpoints(s, d), _owners(s, d, "concat('p', event_id) ping_id"), _now())[1].select("event_id", "endpoint_id", "url", "status", "attempts", _when("next_attempt_at"))


def iso_times(s, d):
    return _events(s, d).select("event_id", L.iso_z(F.expr("case event_id % 3 when 0 then null when 1 then date_trunc('second', ts) else ts end")).alias("z"))


def batch_bodies(s, d):
    x = _events(s, d).select("event_id", L.batch_update_body(F.concat(F.lit("b"), F.col("user_id").cast("string")), F.lit("completed"), F.struct(F.col("event_id").alias("succeeded"), F.lit(0).alias("failed")), F.col("event_id"), F.expr("from_json(case when event_id % 2 = 0 then props end, 'k int')"), F.col("ts"), F.lit(None).cast("timestamp")).alias("body"))
    return x


def metadata_errors(s, d):
    x = s.read.parquet(f"{d}/documents.parquet")
    return x.select("doc_id", L.metadata_error(F.col("text")).alias("error"))


def backoff_ranges(s, d):
    return _events(s, d).select("event_id", L.backoff_range(F.expr("cast(event_id % 14 as int)")).alias("r")).select("event_id", "r.base", "r.most")


def retryable_codes(s, d):
    code = F.expr("case event_id % 5 when 0 then 'internal_error' when 1 then 'upload_missing' when 2 then 'ocr_provider_error' when 3 then 'billing_unavailable' end")
    return _events(s, d).select("event_id", L.is_retryable(code).alias("retryable"))


def delivery_modes(s, d):
    return _events(s, d).select("event_id", L.mode(F.expr("case event_id % 4 when 0 then 'registered' when 1 then 'direct' when 2 then 'none' end")).alias("mode"))


def projected_items(s, d):
    x = _items(s, d).withColumns({"position": F.expr("item_id % 9"), "url": F.expr("if(item_id % 2 = 0, concat('https://a.example.org/f', item_id, '?sig=1#x'), null)"), "attempts": F.expr("item_id % 3"), "error_code": F.expr("if(status = 'failed', 'upload_missing', null)"), "error_message": F.lit("gone")})
    return x.select("item_id", F.to_json(L.projected_item()).alias("body"))


def projected_batches(s, d):
    x = _events(s, d).selectExpr("event_id batch_id", f"{_STATUS} status", "user_id total_items", "event_id % 2 = 0 extract_text", "'none' chunking", "cast(if(event_id % 3 = 0, 500, null) as int) chunk_size", "ts created_at", "if(event_type = 'error', ts, null) completed_at")
    return x.select("batch_id", F.to_json(L.projected_batch()).alias("body"))


def signed_headers(s, d):
    x = _events(s, d).selectExpr("concat('msg_', event_id) msg_id", "unix_seconds(cast(ts as timestamp)) at", "props body", "if(event_id % 2 = 0, array('new', 'old'), array('new')) secrets")
    return L.signature_headers(x).select("msg_id", F.to_json("headers").alias("headers"))


QUERIES = {f.__name__: f for f in (lease_heartbeats, item_reschedules, item_endings, batch_cancellations, delivery_failures, delivery_successes, delivery_cancellations, due_deliveries, created_batches, created_items, created_files, uploaded_files, healed_uploads, file_lookup, item_lookup, endpoint_counts, endpoint_list, endpoint_creations, endpoint_updates, endpoint_deletions, secret_rotations, ping_events, ping_deliveries, iso_times, batch_bodies, metadata_errors, backoff_ranges, retryable_codes, delivery_modes, projected_items, projected_batches, signed_headers)}

_N = "TIMESTAMP '2024-06-01 00:00:00'"
_F = "'%Y-%m-%d %H:%M:%S'"
_I = f"i AS (SELECT event_id item_id, user_id batch_id, user_id % 5 customer_id, {_STATUS} status, ts, CASE WHEN event_type = 'click' THEN 'l' || (event_id % 4) END tok, event_type, event_id, event_id % 3 <> 0 AND event_type = 'click' AND 'l' || (event_id % 4) = 'l' || (event_id % 5) ok FROM events)"
_D = f"d AS (SELECT event_id delivery_id, event_id % 10 attempts, {_DELIVERY} status, ts, event_id, CASE WHEN event_type = 'click' THEN 'l' || (event_id % 4) END tok, event_id % 3 <> 0 AND event_type = 'click' AND event_id % 4 = event_id % 5 ok FROM events)"
_E = "p AS (SELECT event_id endpoint_id, event_id, user_id % 50 customer_id, 'https://hooks.example.org/' || event_id url, 's' || event_id secret, event_id % 4 <> 0 enabled, CASE WHEN event_id % 7 = 0 THEN ts END deleted_at, ts, event_id % 3 <> 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0 ok FROM events WHERE event_type = 'signup')"
_R = "r AS (SELECT event_id // 7 batch_id, min(user_id % 5) customer_id, list(event_id ORDER BY event_id) FILTER (WHERE event_type <> 'click') files, CASE WHEN (event_id // 7) % 3 = 0 THEN 'k' || (event_id // 7) % 40 END idk FROM events GROUP BY event_id // 7), f AS (SELECT * FROM r WHERE len(files) > 0 QUALIFY idk IS NULL OR row_number() OVER (PARTITION BY customer_id, idk ORDER BY batch_id) = 1)"
_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({0}) % 1000000 <> 0 THEN '.' || lpad((epoch_us({0}) % 1000000)::VARCHAR, 6, '0') ELSE '' END || 'Z'"
ORACLE_SQL = {
    "lease_heartbeats": f"WITH {_I} SELECT item_id, status, strftime(CASE WHEN ok THEN {_N} + INTERVAL 90 SECOND ELSE ts END, {_F}) lease_expires_at, ok applied FROM i",
    "item_reschedules": f"WITH {_I} SELECT item_id, CASE WHEN ok THEN 'pending' ELSE status END status, CASE WHEN ok THEN strftime({_N} + to_seconds(event_id % 200), {_F}) END run_after, CASE WHEN ok THEN 'internal_error' END error_code, CASE WHEN NOT ok THEN tok END lease_token, ok applied FROM (SELECT * REPLACE (coalesce(ok, false) AS ok) FROM i)",
    "item_endings": f"WITH {_I} SELECT item_id, CASE WHEN ok AND event_id % 2 = 0 THEN 'succeeded' WHEN ok THEN 'failed' ELSE status END status, CASE WHEN ok AND event_id % 2 = 1 THEN 'page_limit_exceeded' END error_code, CASE WHEN NOT ok THEN tok END lease_token, strftime(CASE WHEN ok THEN {_N} WHEN event_type = 'error' THEN ts END, {_F}) completed_at, ok applied FROM (SELECT * REPLACE (coalesce(ok, false) AS ok) FROM i)",
    "batch_cancellations": f"WITH {_I}, c AS (SELECT *, batch_id % 2 = 0 AND customer_id = batch_id % 4 AND status = 'pending' done FROM i) SELECT item_id, CASE WHEN done THEN 'cancelled' ELSE status END status, strftime(CASE WHEN event_type = 'error' THEN ts WHEN done THEN {_N} END, {_F}) completed_at, done applied FROM c",
    "delivery_failures": f"WITH {_D}, w AS (SELECT [5, 300, 1800, 7200, 18000, 36000, 36000] ladder), x AS (SELECT *, attempts + 1 n, CASE WHEN attempts + 1 <= 7 THEN (SELECT ladder FROM w)[attempts + 1] END delay FROM d) SELECT delivery_id, CASE WHEN NOT ok THEN status WHEN delay IS NULL THEN 'failed' ELSE 'pending' END status, (CASE WHEN ok THEN n ELSE attempts END)::INT attempts, strftime(CASE WHEN ok THEN {_N} + to_seconds(coalesce(delay, 0)) ELSE ts END, {_F}) next_attempt_at, CASE WHEN ok AND event_id % 2 = 0 THEN 503 END last_status_code, (CASE WHEN NOT ok THEN 6 ELSE CASE event_id % 4 WHEN 0 THEN 1000 WHEN 2 THEN 7 END END)::INT error_length, ok applied FROM (SELECT * REPLACE (coalesce(ok, false) AS ok) FROM x)",
    "delivery_successes": f"WITH {_D} SELECT delivery_id, CASE WHEN ok THEN 'succeeded' ELSE status END status, (attempts + ok::INT)::INT attempts, CASE WHEN ok THEN 200 END last_status_code, CASE WHEN NOT ok THEN 'before' END last_error, CASE WHEN ok THEN strftime({_N}, {_F}) END succeeded_at, ok applied FROM (SELECT * REPLACE (coalesce(ok, false) AS ok) FROM d)",
    "delivery_cancellations": f"WITH {_D} SELECT delivery_id, CASE WHEN ok THEN 'cancelled' ELSE status END status, CASE WHEN ok THEN 'endpoint disabled' ELSE 'before' END last_error, CASE WHEN NOT ok THEN tok END lease_token, ok applied FROM (SELECT * REPLACE (coalesce(ok, false) AS ok) FROM d)",
    "due_deliveries": f"SELECT event_id delivery_id, 'delivering' status, 't' || event_id lease_token, CASE WHEN user_id % 12 < 11 THEN user_id % 12 % 4 <> 0 AND user_id % 12 <> 7 END endpoint_enabled, strftime({_N} + INTERVAL 60 SECOND, {_F}) lease_expires_at FROM events WHERE (event_type = 'view' AND ts <= TIMESTAMP '2024-01-20 00:00:00') OR (event_type = 'click' AND ts < TIMESTAMP '2024-01-20 00:00:00') ORDER BY ts, event_id LIMIT 40",
    "created_batches": f"WITH {_R} SELECT batch_id, customer_id, 'pending' status, len(files)::INT total_items, strftime({_N} + INTERVAL 1 DAY, {_F}) expires_at FROM f",
    "created_items": f"WITH {_R} SELECT batch_id, customer_id, unnest(range(len(files)))::INT AS position, unnest(files) file_id, 'pending' status, 0 attempts FROM f",
    "created_files": f"SELECT event_id file_id, user_id customer_id, 'pending_upload' status, NULL sha256, strftime({_N} + INTERVAL 1 HOUR, {_F}) expires_at FROM events",
    "uploaded_files": "WITH x AS (SELECT *, event_id % 3 <> 0 AND user_id % 5 = user_id % 4 AND event_type <> 'view' ok, CASE WHEN event_id % 2 = 0 THEN 'old' END old FROM events) SELECT event_id file_id, user_id % 5 customer_id, CASE WHEN ok OR event_type = 'view' THEN 'uploaded' ELSE 'pending_upload' END status, CASE WHEN ok AND event_id % 5 = 0 THEN 'new' ELSE old END sha256, ok applied FROM x",
    "healed_uploads": "WITH x AS (SELECT *, event_id % 3 <> 0 AND event_id % 2 = 0 AND event_type <> 'view' ok, CASE WHEN event_id % 2 = 0 THEN 'old' END old FROM events) SELECT event_id file_id, user_id % 5 customer_id, CASE WHEN ok OR event_type = 'view' THEN 'uploaded' ELSE 'pending_upload' END status, CASE WHEN ok AND event_id % 5 = 0 THEN 'etag' ELSE old END sha256, ok applied FROM x",
    "file_lookup": "SELECT event_id file_id, user_id % 5 customer_id, CASE WHEN event_type = 'view' THEN 'uploaded' ELSE 'pending_upload' END status, CASE WHEN event_id % 2 = 0 THEN 'old' END sha256 FROM events WHERE event_id = 7",
    "item_lookup": f"WITH {_I} SELECT item_id, batch_id, status FROM i WHERE batch_id = 11 AND customer_id = 1",
    "endpoint_counts": f"WITH {_E} SELECT customer_id, count(*) n FROM p WHERE deleted_at IS NULL GROUP BY 1",
    "endpoint_list": f"WITH {_E} SELECT endpoint_id, url, enabled FROM p WHERE deleted_at IS NULL AND customer_id = 3 ORDER BY ts",
    "endpoint_creations": f"SELECT event_id endpoint_id, user_id customer_id, 'https://a.example.org/' || event_id url, true enabled, NULL old_secret, strftime({_N}, {_F}) created_at FROM events WHERE event_type = 'signup'",
    "endpoint_updates": f"WITH {_E} SELECT endpoint_id, CASE WHEN ok AND event_id % 2 = 0 THEN 'https://new.example.org/' ELSE url END url, CASE WHEN ok AND event_id % 11 = 0 THEN false ELSE enabled END enabled, strftime(CASE WHEN ok THEN {_N} ELSE ts END, {_F}) updated_at, ok applied FROM p",
    "endpoint_deletions": f"WITH {_E} SELECT endpoint_id, enabled AND NOT ok enabled, strftime(CASE WHEN ok THEN {_N} ELSE deleted_at END, {_F}) deleted_at, ok applied FROM p",
    "secret_rotations": f"WITH {_E} SELECT endpoint_id, CASE WHEN ok THEN 'fresh' ELSE secret END secret, CASE WHEN ok THEN secret END old_secret, CASE WHEN ok THEN '2024-06-02 00:00:00' END old_secret_expires_at, ok applied FROM p",
    "ping_events": f"""WITH {_E} SELECT 'msg_p' || endpoint_id event_id, customer_id, NULL::BIGINT batch_id, 'webhook.ping' event_type, '{{"type":"webhook.ping","batch_id":"ping_p' || endpoint_id || '"}}' body FROM p WHERE ok""",
    "ping_deliveries": f"WITH {_E} SELECT 'msg_p' || endpoint_id event_id, endpoint_id, url, 'pending' status, 0 attempts, strftime({_N}, {_F}) next_attempt_at FROM p WHERE ok",
    "iso_times": "WITH x AS (SELECT event_id, CASE event_id % 3 WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN ts END t FROM events) SELECT event_id, " + _ISO.format("t") + " z FROM x",
    "batch_bodies": """SELECT event_id, '{"type":"batch.update","batch_id":"b' || user_id || '","status":"completed","counts":{"succeeded":' || event_id || ',"failed":0},"total_items":' || event_id || ',"metadata":' || CASE WHEN event_id % 2 = 0 THEN replace(props, ' ', '') ELSE 'null' END || ',"completed_at":"' || """ + _ISO.format("ts") + """ || '","results_expires_at":null}' body FROM events""",
    "metadata_errors": "SELECT doc_id, CASE WHEN octet_length(encode(text)) > 16384 THEN 'metadata is ' || octet_length(encode(text)) || ' bytes serialized; the maximum is 16384 (it is echoed into every webhook delivery)' END error FROM documents",
    "backoff_ranges": "SELECT event_id, least(CASE WHEN event_id % 14 = 0 THEN 1 ELSE 1 << (event_id % 14 - 1)::INT END, 300)::INT base, (2 * least(CASE WHEN event_id % 14 = 0 THEN 1 ELSE 1 << (event_id % 14 - 1)::INT END, 300))::INT most FROM events",
    "retryable_codes": "SELECT event_id, event_id % 5 IN (0, 2, 3) retryable FROM events",
    "delivery_modes": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'svix' WHEN 1 THEN 'direct' WHEN 2 THEN 'none' END AS mode FROM events",
    "projected_items": f"""WITH {_I} SELECT item_id, '{{"object":"batch_item","id":' || item_id || ',"batch_id":' || batch_id || ',"position":' || item_id % 9 || CASE WHEN item_id % 2 = 0 THEN ',"url":"https://a.example.org/f' || item_id || '"' ELSE '' END || ',"status":"' || status || '","attempts":' || item_id % 3 || CASE WHEN status = 'succeeded' THEN ',"result_url":"/v1/batches/' || batch_id || '/items/' || item_id || '/result"' ELSE '' END || CASE WHEN status = 'failed' THEN ',"error":{{"code":"upload_missing","message":"gone"}}' ELSE '' END || '}}' body FROM i""",
    "projected_batches": f"""SELECT event_id batch_id, '{{"object":"batch","id":' || event_id || ',"status":"' || ({_STATUS}) || '","total_items":' || user_id || ',"options":{{"extract_text":' || (event_id % 2 = 0) || ',"chunking":"none","chunk_size":' || CASE WHEN event_id % 3 = 0 THEN 500 ELSE 1000 END || '}},"created_at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '"' || CASE WHEN event_type = 'error' THEN ',"completed_at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '"' ELSE '' END || '}}' body FROM events""",
}
