"""Widths of texts that the small tables don't have: very long, empty, null, of one id."""

import duckdb
from docweave.queries import collect


def test_char_widths(spark, tmp_path):
    rows = [(k, "Some words of a text, with 12 numbers. " * k * 1000) for k in (7, 8, 9, 10, 13)] + [(20, ""), (21, None), (22, "mI"), (22, "x"), (23, None), (23, "@"), (24, "𝔸é\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    queries, sql = collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(con.execute(sql["char_widths"]).fetchall())
    assert {r.doc_id: r.width for r in queries["char_widths"](spark, str(tmp_path)).collect()} == want
    assert want[20] == 0.6 and 21 not in want and want[22] == 2.2 and len(want) == 9
