"""packets_all returns a row for each text, as its SQL does, also where texts or sources would be rejected."""

import duckdb

import __spark_entry__ as entry


def test_rejected_texts_do_not_stop_the_others(spark, tmp_path):
    rows = [(1, " a\r\nb ", "s"), (2, "", "s"), (3, " \n\t ", "s"), (4, None, "s"), (5, "text", " "), (6, "text", None), (7, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, entry.queries()["packets_all"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(entry.oracle_sql()["packets_all"]).fetchall()) and len(got) == len(rows)
