"""Job lane, agreement, join and record queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.operators import agree as A
from docweave.operators import jobs as J
from docweave.operators import records as R
from docweave.operators.grouped import small_batches
from docweave.plans.elements import SQL as E
from docweave.plans.elements import elements

_STATUS = "case event_type when 'view' then 'pending' when 'click' then 'running' when 'purchase' then 'succeeded' when 'error' then 'failed' else 'cancelled' end"
NOW = "timestamp '2024-06-01 00:00:00'"


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _items(s, d):
    return _t(s, d, "events").selectExpr("user_id batch_id", "event_id item_id", f"{_STATUS} status", "ts", "case when event_id % 3 = 0 then ts + interval 200 days end run_after", "ts + interval 5 minutes lease_expires_at")


def _batches(s, d):
    counts = J.status_counts(_items(s, d)).withColumn("status", J.batch_status())
    ends = _items(s, d).groupBy("batch_id").agg(F.max("ts").alias("completed_at"), F.min("ts").alias("created_at"))
    return counts.join(ends, "batch_id").selectExpr("batch_id", "batch_id % 5 customer_id", "case when batch_id % 2 = 0 then 'completed' else 'failed' end status", "case batch_id % 3 when 0 then 'registered' when 1 then 'direct' else 'none' end webhook_mode", "completed_at", "created_at", "case when batch_id % 4 = 0 then null else cast(batch_id % 7 as string) end idempotency_key")


def _endpoints(s):
    return s.range(12).selectExpr("id % 5 customer_id", "id endpoint_id", "id % 4 <> 0 enabled", "case when id = 7 then current_timestamp() end deleted_at")


def batch_counts(s, d):
    return J.status_counts(_items(s, d))


def batch_status(s, d):
    c = J.status_counts(_items(s, d)).withColumn("current", F.expr("case when batch_id % 11 = 0 then 'cancelled' end"))
    return c.select("batch_id", J.batch_status(F.col("current")).alias("status"))


def keyset_page(s, d):
    import datetime

    return J.keyset_page(_t(s, d, "events").select("event_id", "ts"), "ts", "event_id", (datetime.datetime(2024, 1, 5, tzinfo=datetime.timezone.utc), 100), 50).select("event_id")


def keyset_page_desc(s, d):
    import datetime

    return J.keyset_page(_t(s, d, "events").select("event_id", "ts"), "ts", "event_id", (datetime.datetime(2024, 1, 20, tzinfo=datetime.timezone.utc), 100), 51, True).select("event_id")


def cursor_roundtrip(s, d):
    c = _t(s, d, "events").select("event_id", T.cursor(F.col("ts"), F.col("event_id")).alias("cursor"))
    return c.select("event_id", "cursor", F.get(T.cursor_parts(F.col("cursor")), F.lit(1)).cast("bigint").alias("back"))


def claimable_backlog(s, d):
    return J.claimable(_items(s, d), F.expr(NOW)).agg(F.count("*").alias("n"))


def claim_order(s, d):
    return J.claim_order(_items(s, d), F.expr(NOW), 20).select("item_id")


def oldest_due(s, d):
    return J.oldest_due_age(_items(s, d).withColumnRenamed("ts", "next_attempt_at"), F.expr(NOW))


def outbox_fanout(s, d):
    return J.outbox_events(_batches(s, d), _endpoints(s))


def missing_events(s, d):
    b = _batches(s, d).withColumn("completed_at", F.expr(f"{NOW} - make_interval(0, 0, 0, 0, 0, cast(batch_id % 3000 as int), 0)"))
    return J.missing_events(b, b.where("batch_id % 3 = 1").selectExpr("batch_id"), F.expr(NOW))


def deliveries_join(s, d):
    e = _t(s, d, "events")
    deliveries = e.where("event_type = 'error'").selectExpr("event_id + 1 as event_id", "value")
    return J.deliveries_with_context(deliveries, e.selectExpr("event_id", "user_id batch_id", "event_type"), _batches(s, d)).select("event_id", "batch_id", "event_type", "batch_status", "value")


def rate_limit_windows(s, d):
    e = _t(s, d, "events").withColumn("ts", F.date_trunc("hour", "ts"))
    return J.rate_limited(e, "user_id", "ts", "event_id", 2)


def retry_ladder(s, d):
    e = _t(s, d, "events").selectExpr("event_id", "cast(event_id % 10 as int) attempts", "event_type = 'error' retryable")
    return J.delivery_delays(e).select("event_id", "delay_s", "outcome", J.retry_outcome(F.col("attempts"), F.col("retryable")).alias("job"))


def resend_outcomes(s, d):
    e = _t(s, d, "events").selectExpr("event_id", "case event_id % 4 when 0 then null when 1 then 'delivering' when 2 then 'pending' else 'succeeded' end st", "event_id % 5 = 0 ex")
    return e.select("event_id", J.resend_outcome(F.col("st"), F.col("ex")).alias("outcome"))


def idempotent_batches(s, d):
    return J.first_by_key(_batches(s, d)).select("batch_id")


def token_f1_pairs(s, d):
    x = _t(s, d, "documents")
    pairs = x.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    small_batches(s)
    return A.text_f1(x.selectExpr("doc_id id", "text"), x.selectExpr("doc_id + 1 id", "text"), pairs)


def majority_read(s, d):
    # three turns in a row are the reads of a page
    three = _t(s, d, "conversations").selectExpr("struct(conv_id, turn div 3 as page) page", "turn % 3 r", "text")
    reads = three.select(F.struct("page", "r").alias("id"), F.explode(F.split("text", " ")).alias("token"))
    three = three.select("page", "r")
    pairs = three.alias("x").join(three.alias("y"), "page").where("x.r < y.r").selectExpr("struct(page, x.r as r) a", "struct(page, y.r as r) b")
    f1 = A.multiset_f1(reads, reads, pairs).selectExpr("a.page page", "a.r a", "b.r b", "f1")
    return A.majority_read(f1, 0.2).selectExpr("page.conv_id", "page.page", "served_read")


def currency_recovery(s, d):
    l = _t(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "cast(round(l_quantity * 100) as bigint) cents")
    return A.multiset_minus(l, l.where("l_linenumber <> 2"), ["l_orderkey", "cents"], ["l_linenumber"]).select("l_orderkey", "cents")


def words_in_box(s, d):
    e = elements(_t(s, d, "documents").select("doc_id", "text"))
    words = e.select("doc_id", "page_no", F.col("idx").alias("line_no"), "x0", "y0", F.posexplode(F.split("text", " ")).alias("word_no", "word")).selectExpr("doc_id", "page_no", "line_no", "word_no", "word", "x0 + 30 * word_no x0", "y0", "x0 + 30 * word_no + 25 x1", "y0 + 12 y1")
    boxes = e.where("idx % 5 = 0").selectExpr("doc_id", "page_no", "idx box_id", "x0", "y0", "x0 + 150 x1", "y0 + 40 y1")
    return A.words_in_boxes(words, boxes)


def nearest_row(s, d):
    l = _t(s, d, "lineitem").selectExpr("l_orderkey % 50 page", "l_orderkey * 10 + l_linenumber word_id", "l_quantity * 12.7 y")
    rows = s.range(50).selectExpr("id page", "explode(sequence(1, 28)) row").selectExpr("page", "row", "row * 22.0D row_y")
    return A.nearest_row(l, rows, 22.0)


def rect_iou(s, d):
    e = elements(_t(s, d, "documents").select("doc_id", "text"))
    n = e.selectExpr("doc_id", "idx - 7 idx", "x0 bx0", "y0 - 100 by0", "x1 bx1", "y1 bx9", "y1 + 40 by1")
    return e.selectExpr("doc_id", "idx", "x0 ax0", "y0 ay0", "x1 ax1", "y1 ay1").join(n, ["doc_id", "idx"]).select("doc_id", "idx", A.box_iou().alias("iou"))


def value_occurrences(s, d):
    b = _t(s, d, "benchmark").select(F.col("item_id").alias("value_id"), F.col("text").alias("value"))
    return R.value_occurrences(b, _t(s, d, "documents").select(F.col("doc_id").alias("text_id"), "text")).selectExpr("value_id item_id", "text_id doc_id")


def grounding_first_match(s, d):
    e = elements(_t(s, d, "documents").select("doc_id", "text"), decorate=False).selectExpr("doc_id", "cast((idx - 7) div 8 as int) idx", "text")
    v = e.where("idx = 1 and text <> ''").selectExpr("doc_id value_id", "doc_id", "left(text, 6) value")
    return R.first_match(v, e, e.where("idx = 2").selectExpr("doc_id value_id", "idx", "0 pos")).select("value_id", "idx")


def record_dedup(s, d):
    c = _t(s, d, "customer").selectExpr("c_nationkey g", "c_custkey o", "c_name n", "c_mktsegment m")
    v = c.union(c.selectExpr("g", "o + 1000000 o", "upper(n) n", "cast(null as string) m")).union(c.where("o % 3 = 0").selectExpr("g", "o + 2000000 o", "concat(n, ' x') n", "m"))
    return R.dedup_records(v, "g", "o", ["n", "m"]).select("o")


def identity_cells(s, d):
    p = _t(s, d, "part").selectExpr("p_partkey row_id", "stack(4, 'name', concat(p_name, p_size), 'brand', p_brand, 'type', p_type, 'price', cast(cast(round(p_retailprice * 100) as bigint) as string)) as (path, value)")
    return R.identity_cells(p)


def first_nonnull_merge(s, d):
    o = _t(s, d, "orders").selectExpr("o_custkey", "o_orderkey", "case when o_orderkey % 3 = 0 then o_orderpriority end p", "case when o_orderkey % 2 = 0 then o_orderstatus end st")
    return R.first_non_null(o, ["o_custkey"], "o_orderkey", ["p", "st"])


def evidence_merge(s, d):
    e = elements(_t(s, d, "documents").select("doc_id", "text")).selectExpr("doc_id", "idx", "y0 box")
    loc = e.where("idx % 2 = 0").selectExpr("doc_id", "idx", "box + 1 box", "idx % 3 = 0 valid")
    return R.merge_evidence(e, loc, ["doc_id", "idx"])


QUERIES = {f.__name__: f for f in (batch_counts, batch_status, keyset_page, keyset_page_desc, cursor_roundtrip, claimable_backlog, claim_order, oldest_due, outbox_fanout, missing_events, deliveries_join, rate_limit_windows, retry_ladder, resend_outcomes, idempotent_batches, token_f1_pairs, majority_read, currency_recovery, words_in_box, nearest_row, rect_iou, value_occurrences, grounding_first_match, record_dedup, identity_cells, first_nonnull_merge, evidence_merge)}

_I = f"i AS (SELECT user_id batch_id, event_id item_id, {_STATUS} status, ts, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 200 DAYS END run_after, ts + INTERVAL 5 MINUTES lease_expires_at FROM events)"
_C = _I + ", c AS (SELECT batch_id, " + ", ".join(f"count(*) FILTER (status = '{x}') {x}" for x in J.STATES) + " FROM i GROUP BY batch_id)"
_B = _I + ", b AS (SELECT batch_id, batch_id % 5 customer_id, CASE WHEN batch_id % 2 = 0 THEN 'completed' ELSE 'failed' END status, CASE batch_id % 3 WHEN 0 THEN 'registered' WHEN 1 THEN 'direct' ELSE 'none' END webhook_mode, max(ts) completed_at, min(ts) created_at, CASE WHEN batch_id % 4 = 0 THEN NULL ELSE (batch_id % 7)::VARCHAR END idempotency_key FROM i GROUP BY batch_id)"
_ELIG = f"(status = 'pending' AND coalesce(run_after, {NOW}) <= {NOW}) OR (status = 'running' AND lease_expires_at < {NOW})"
_DELAY = "[5, 300, 1800, 7200, 18000, 36000, 36000]"
ORACLE_SQL = {
    "batch_counts": f"WITH {_C} SELECT * FROM c",
    "batch_status": f"""WITH {_C} SELECT batch_id, CASE WHEN batch_id % 11 = 0 THEN 'cancelled' WHEN pending + running = 0 THEN CASE WHEN succeeded + failed + cancelled = 0 THEN 'pending' WHEN failed + cancelled = 0 THEN 'completed' WHEN succeeded = 0 AND cancelled = 0 THEN 'failed' WHEN succeeded = 0 THEN 'cancelled' ELSE 'partially_failed' END WHEN running > 0 THEN 'running' ELSE 'pending' END status FROM c""",
    "keyset_page": "SELECT event_id FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-05', 100) ORDER BY ts, event_id LIMIT 50",
    "keyset_page_desc": "SELECT event_id FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-20', 100) ORDER BY ts DESC, event_id DESC LIMIT 51",
    "cursor_roundtrip": "SELECT event_id, rtrim(translate(to_base64((strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '|' || event_id)::BLOB), '+/', '-_'), '=') AS cursor, event_id back FROM events",
    "claimable_backlog": f"WITH {_I} SELECT count(*) n FROM i WHERE {_ELIG}",
    "claim_order": f"WITH {_I} SELECT item_id FROM i WHERE {_ELIG} ORDER BY item_id LIMIT 20",
    "oldest_due": f"WITH {_I} SELECT greatest(epoch({NOW})::BIGINT - floor(epoch(min(ts)))::BIGINT, 0) age_s FROM i WHERE status = 'pending'",
    "outbox_fanout": f"WITH {_B}, ep AS (SELECT range % 5 customer_id, range endpoint_id FROM range(12) WHERE range % 4 <> 0 AND range <> 7) SELECT batch_id, 'batch.' || status event_type, endpoint_id FROM b JOIN ep USING (customer_id) WHERE webhook_mode = 'registered' UNION ALL SELECT batch_id, 'batch.' || status, NULL FROM b WHERE webhook_mode = 'direct'",
    "missing_events": f"WITH {_I}, b AS (SELECT DISTINCT batch_id, {NOW} - to_minutes(batch_id % 3000) completed_at FROM i) SELECT batch_id FROM b WHERE completed_at BETWEEN {NOW} - INTERVAL 24 HOURS AND {NOW} - INTERVAL 15 MINUTES AND batch_id % 3 <> 1 ORDER BY completed_at, batch_id LIMIT 100",
    "deliveries_join": f"WITH {_B} SELECT e.event_id, e.user_id batch_id, e.event_type, b.status batch_status, d.value FROM (SELECT event_id + 1 event_id, value FROM events WHERE event_type = 'error') d JOIN events e USING (event_id) LEFT JOIN b ON b.batch_id = e.user_id",
    "rate_limit_windows": "WITH t AS (SELECT user_id, date_trunc('hour', ts) window_start, event_id FROM events) SELECT user_id, window_start, event_id, row_number() OVER (PARTITION BY user_id, window_start ORDER BY event_id) <= 2 allowed FROM t",
    "retry_ladder": f"SELECT event_id, {_DELAY}[CASE WHEN event_id % 10 BETWEEN 1 AND 7 THEN event_id % 10 END] delay_s, CASE WHEN event_id % 10 > 7 THEN 'exhausted' ELSE 'scheduled' END outcome, CASE WHEN event_type <> 'error' OR event_id % 10 >= 3 THEN 'failed' ELSE 'retry' END job FROM events",
    "resend_outcomes": "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'not_found' WHEN event_id % 4 = 1 THEN 'in_flight' WHEN event_id % 5 = 0 THEN 'results_expired' WHEN event_id % 4 = 2 THEN 'nudged' ELSE 'requeued' END outcome FROM events",
    "idempotent_batches": f"WITH {_B}, r AS (SELECT *, row_number() OVER (PARTITION BY customer_id, idempotency_key ORDER BY created_at, batch_id) n FROM b) SELECT batch_id FROM r WHERE n = 1 OR idempotency_key IS NULL",
    "token_f1_pairs": "WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents), a AS (SELECT doc_id a, token, count(*) na FROM t GROUP BY ALL), b AS (SELECT doc_id + 1 b, token, count(*) nb FROM t GROUP BY ALL), m AS (SELECT a, sum(least(na, nb)) m FROM a JOIN b ON a.a = b.b AND a.token = b.token GROUP BY a), x AS (SELECT d.doc_id a, d.doc_id b, coalesce(m.m, 0) m, coalesce((SELECT sum(na) FROM a WHERE a.a = d.doc_id), 0) ta, coalesce((SELECT sum(nb) FROM b WHERE b.b = d.doc_id), 0) tb FROM documents d LEFT JOIN m ON m.a = d.doc_id) SELECT a, b, CASE WHEN ta = 0 AND tb = 0 THEN NULL WHEN m = 0 THEN 0 ELSE 2.0::DOUBLE * m / (ta + tb) END f1 FROM x",
    "majority_read": "WITH t AS (SELECT {'c': conv_id, 'p': turn // 3} conv_id, turn % 3 r, unnest(string_split(text, ' ')) AS token FROM conversations), c AS (SELECT conv_id, r, token, count(*) n FROM t GROUP BY ALL), z AS (SELECT conv_id, r, sum(n) s FROM c GROUP BY ALL), p AS (SELECT x.conv_id, x.r a, y.r b, x.s sa, y.s sb FROM z x JOIN z y ON x.conv_id = y.conv_id AND x.r < y.r), f AS (SELECT p.*, coalesce((SELECT sum(least(u.n, v.n)) FROM c u JOIN c v ON u.conv_id = v.conv_id AND u.token = v.token WHERE u.conv_id = p.conv_id AND u.r = p.a AND v.r = p.b), 0) m FROM p), g AS (SELECT *, 2.0::DOUBLE * m / (sa + sb) f1, row_number() OVER (PARTITION BY conv_id ORDER BY 2.0::DOUBLE * m / (sa + sb) DESC, a, b) k FROM f) SELECT conv_id.c conv_id, conv_id.p page, CASE WHEN f1 >= 0.2 THEN a END served_read FROM g WHERE k = 1",
    "currency_recovery": "WITH l AS (SELECT l_orderkey, l_linenumber, round(l_quantity * 100)::BIGINT cents FROM lineitem) SELECT l_orderkey, cents FROM (SELECT l_orderkey, cents FROM l EXCEPT ALL SELECT l_orderkey, cents FROM l WHERE l_linenumber <> 2)",
    "words_in_box": f"WITH {E}, s AS (SELECT *, string_split(text, ' ') ws FROM e), w AS (SELECT doc_id, page_no, idx line_no, unnest(range(len(ws))) word_no, unnest(ws) word, x0, y0 FROM s), c AS (SELECT *, x0 + 30 * word_no + 12.5 cx, y0 + 6 cy FROM w), b AS (SELECT doc_id, page_no, idx box_id, x0, y0, x0 + 150 x1, y0 + 40 y1 FROM e WHERE idx % 5 = 0) SELECT b.doc_id, box_id, string_agg(word, ' ' ORDER BY line_no, word_no) AS text FROM b JOIN c ON c.doc_id = b.doc_id AND c.page_no = b.page_no AND cx BETWEEN b.x0 - 0.5 AND x1 + 0.5 AND cy BETWEEN b.y0 - 0.5 AND y1 + 0.5 GROUP BY ALL",
    "nearest_row": "WITH w AS (SELECT l_orderkey % 50 page, l_orderkey * 10 + l_linenumber word_id, l_quantity * 12.7::DOUBLE y FROM lineitem), r AS (SELECT (range + 1)::INT AS row, (range + 1) * 22.0::DOUBLE ry FROM range(28)), p AS (SELECT *, row_number() OVER (PARTITION BY page, word_id ORDER BY abs(y - ry), row) k FROM w JOIN r ON abs(y - ry) <= 0.55::DOUBLE * 22) SELECT page, word_id, row FROM p WHERE k = 1",
    "rect_iou": f"WITH {E}, p AS (SELECT a.doc_id, a.idx, a.x0 ax0, a.y0 ay0, a.x1 ax1, a.y1 ay1, b.x0 bx0, b.y0 - 100 by0, b.x1 bx1, b.y1 + 40 by1 FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.idx = b.idx - 7), q AS (SELECT *, greatest(least(ax1, bx1) - greatest(ax0, bx0), 0) * greatest(least(ay1, by1) - greatest(ay0, by0), 0) i FROM p) SELECT doc_id, idx, CASE WHEN i = 0 THEN 0 ELSE i / ((ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - i) END iou FROM q",
    "value_occurrences": "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "grounding_first_match": f"WITH {E}, r AS (SELECT doc_id, idx, line FROM lines), v AS (SELECT doc_id, left(line, 6) v FROM r WHERE idx = 1 AND line <> ''), h AS (SELECT v.doc_id value_id, r.idx, row_number() OVER (PARTITION BY v.doc_id ORDER BY r.idx <> 2, r.idx) k FROM v JOIN r ON r.doc_id = v.doc_id AND contains(r.line, v.v)) SELECT value_id, idx FROM h WHERE k = 1",
    "record_dedup": "WITH c AS (SELECT c_nationkey g, c_custkey o, c_name n, c_mktsegment m FROM customer), v AS (SELECT * FROM c UNION ALL SELECT g, o + 1000000, upper(n), NULL FROM c UNION ALL SELECT g, o + 2000000, n || ' x', m FROM c WHERE o % 3 = 0), s AS (SELECT g, o, nullif(regexp_replace(lower(n), '[^a-z0-9]', '', 'g'), '') n, nullif(regexp_replace(lower(m), '[^a-z0-9]', '', 'g'), '') m FROM v), t AS (SELECT *, (n IS NOT NULL)::INT + (m IS NOT NULL)::INT f FROM s) SELECT o FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE a.g = b.g AND a.o <> b.o AND (a.n IS NULL OR coalesce(b.n = a.n OR (length(a.n) >= 6 AND (starts_with(b.n, a.n) OR ends_with(b.n, a.n))), false)) AND (a.m IS NULL OR coalesce(b.m = a.m OR (length(a.m) >= 6 AND (starts_with(b.m, a.m) OR ends_with(b.m, a.m))), false)) AND (b.f > a.f OR (b.f = a.f AND b.o < a.o)))",
    "identity_cells": "WITH p AS (SELECT p_partkey row_id, 'brand' AS path, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'name', p_name || p_size FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part UNION ALL SELECT p_partkey, 'price', (round(p_retailprice * 100)::BIGINT)::VARCHAR FROM part) SELECT row_id, path, value FROM (SELECT *, count(*) OVER (PARTITION BY path, value) n FROM p WHERE value IS NOT NULL) WHERE n = 1",
    "first_nonnull_merge": "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderkey % 3 = 0) p, arg_min(o_orderstatus, o_orderkey) FILTER (o_orderkey % 2 = 0) st FROM orders GROUP BY o_custkey",
    "evidence_merge": f"WITH {E} SELECT doc_id, idx, CASE WHEN idx % 6 = 0 THEN y0 + 1 ELSE y0 END box, idx % 6 = 0 localized FROM e",
}
