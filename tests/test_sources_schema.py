import io
import json
import zipfile

import pytest

from docweave.functions import schema as S
from docweave.sources import documents as D
from pyspark.sql import functions as F


def _zip(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, "x")
    return out.getvalue()


def test_kinds(spark, tmp_path):
    cases = [("a.png", b"%PDF-1.7", "pdf"), ("a", _zip("word/a"), "docx"), ("a.pptx", _zip("ppt/a"), "pptx"), ("b.docx", _zip("word/a", "ppt/a"), "docx"), ("x", b"\x89PNG\r\n\x1a\n", "image"), ("x", b"\xff\xd8\xff\xe0", "image"), ("x", b"RIFF0000WEBP", "image"), ("x", b"BM", None), ("x", b"BM" + b"0" * 30, "image"), ("x", b"\x00\x00\x00\x18ftypabcd0000heic1234", "image"), ("x", b"\x00\x00\x00\x14ftypabcd0000mp42heic", None), ("http://h/a.PDF?x=1", b"zz", "pdf"), ("x", None, None)]
    df = spark.createDataFrame([(n, d) for n, d, _ in cases], "path string, content binary")
    assert [r.kind for r in D.with_kinds(df).collect()] == [k for _, _, k in cases]
    (tmp_path / "f.pdf").write_bytes(b"%PDF-")
    (tmp_path / "g.pdf").write_bytes(b"%PDF-" + b"0" * 100)
    assert D.load_files(spark, str(tmp_path), 50).count() == 1
    assert D.is_blocked_address("10.0.0.1") and D.is_blocked_address("100.64.1.1") and D.is_blocked_address("::ffff:127.0.0.1") and D.is_blocked_address("x") and not D.is_blocked_address("93.184.216.34")


def test_results(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None, None)], "batch_id long, id string, usage string, error string")
    assert json.loads(df.select(D.as_response(["id", "usage", "error"], ["usage"]).alias("j")).first().j) == {"id": "a", "error": None}
    D.write_results(df, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 1
    images = spark.createDataFrame([(1, b"a"), (2, b"a"), (3, b"b")], "page long, image binary")
    got = D.read_once(images, lambda x: x.select("sha", F.length("image").alias("n")))
    assert got.count() == 3


def test_schema():
    schema = {"$defs": {"T": {"type": "object", "properties": {"q": {"type": "number"}, "u": {"anyOf": [{"type": "string"}, {"type": "null"}]}}}}, "type": "object", "properties": {"a": {"type": ["string", "null"]}, "l": {"type": "array", "items": {"$ref": "#/$defs/T"}}, "z": {"type": "object", "properties": {"k": {"type": "integer"}}}}}
    assert S.leaves(schema) == [("a", "string", False), ("l[].q", "number", True), ("l[].u", "string", True), ("z.k", "integer", False)]
    assert S.groups(schema, 2) == [["a"], ["l"], ["z"]] and S.groups(schema, 3) == [["a", "l"], ["z"]]
    with pytest.raises(ValueError):
        S.resolved({"$ref": "#/a"}, {"a": {"$ref": "#/a"}})
    assert S.leaves({"type": "object", "properties": {"a": {"allOf": [{"type": "object", "properties": {"x": {"type": "string"}}}, {"properties": {"y": {"type": "integer"}}}]}}}) == [("a.x", "string", False), ("a.y", "integer", False)]
    assert S.union_records([{"n": 1}, {"n": "abcd"}], [{"n": None}, {"n": 2}]) == [{"n": 1}, {"n": "abcd"}, {"n": 2}]
    assert S.merged({"a": None, "b": [1]}, {"a": 2, "b": [1, 3], "c": 4}) == {"a": 2, "b": [1, 3], "c": 4}
    assert S.leaf_values({"a": [{"b": 1}]}) == [("a[0].b", 1)]
    got = S.union_records([{"id": "abc1", "x": None}, {"id": "zzz9", "x": 2}], [{"id": "ZZZ-9", "x": 5}, {"id": "abc1", "x": 7}, {"id": "new4"}])
    assert got == [{"id": "abc1", "x": 7}, {"id": "zzz9", "x": 2}, {"id": "new4"}]
