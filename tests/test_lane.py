"""Signed headers against the standard library, and lane changes with odd requests."""

import base64
import hashlib
import hmac

from docweave.operators import lane as L
from pyspark.sql import functions as F


def test_signature_headers(spark):
    rows = [("m1", 17, '{"a": 1}', ["new", "old"]), ("m2", 18, "", ["é"])]
    got = {r.msg_id: r.headers for r in L.signature_headers(spark.createDataFrame(rows, "msg_id string, at long, body string, secrets array<string>")).collect()}
    for m, at, body, secrets in rows:
        want = " ".join("v1," + base64.b64encode(hmac.new(s.encode(), f"{m}.{at}.{body}".encode(), hashlib.sha256).digest()).decode() for s in secrets)
        assert got[m]["svix-signature"] == got[m]["webhook-signature"] == want and got[m]["svix-id"] == m and got[m]["webhook-timestamp"] == str(at) and len(got[m]) == 7


def test_odd_requests(spark):
    items = spark.createDataFrame([(1, "running", "a", None), (2, "running", None, None), (3, "pending", "a", None)], "item_id int, status string, lease_token string, lease_expires_at timestamp_ntz")
    now = F.expr("timestamp_ntz '2024-06-01 00:00:00'")
    asks = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (9, "a")], "item_id int, token string")
    assert [r.applied for r in L.heartbeat(items, asks, now).orderBy("item_id").collect()] == [False] * 3
    assert [r.applied for r in L.heartbeat(items, asks.limit(0), now).collect()] == [False] * 3
    assert L.heartbeat(items.limit(0), asks, now).count() == 0
    right = spark.createDataFrame([(1, "a")], "item_id int, token string")
    got = {r.item_id: r for r in L.heartbeat(items, right, now, 60).collect()}
    assert got[1].applied and got[1].lease_expires_at.minute == 1 and not got[2].applied


def test_batches_without_files_or_with_a_used_key(spark):
    asks = spark.createDataFrame([(1, 7, ["x", "y"], "k"), (2, 7, ["z"], "k"), (3, 7, [], None), (4, 8, ["z"], None), (5, 8, None, None)], "batch_id int, customer_id int, files array<string>, idempotency_key string")
    batches, items = L.create_batches(asks, F.expr("timestamp_ntz '2024-06-01 00:00:00'"), 60)
    assert sorted((r.batch_id, r.total_items) for r in batches.collect()) == [(1, 2), (4, 1)]
    assert sorted((r.batch_id, r.position, r.file_id) for r in items.collect()) == [(1, 0, "x"), (1, 1, "y"), (4, 0, "z")]
