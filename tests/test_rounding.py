"""Decimal halves, which no double holds exactly, against DuckDB."""

import duckdb

from corpusmill.functions import text as T


def test_rounded_as_duckdb(spark):
    rows = [(i, (i * 100 + 50) / 1e6) for i in range(10_000)] + [(-1, None), (-2, -0.73135), (-3, 0.0), (-4, 4_503_599_627.37), (-5, 0.49999999999999994)]
    df = spark.createDataFrame(rows, "i long, x double")
    got = df.select("i", T.rounded(df.x, 4).alias("r")).collect()
    con = duckdb.connect()
    con.register("t", df.toArrow())
    assert sorted(map(tuple, got)) == sorted(con.execute("SELECT i, round(x, 4) FROM t").fetchall())
    assert dict(map(tuple, got))[7313] == 0.7313
