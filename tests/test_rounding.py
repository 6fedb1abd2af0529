import duckdb
from pyspark.sql import functions as F

from worktrail.functions.ids import exact_round
from worktrail_queries.sqlkit import rnd


def test_exact_round_equals_python(spark):
    values = [n / d for d in (16, 32, 64, 80, 96, 125, 160, 168, 320, 640, 4000, 6400) for n in range(d + 1)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", exact_round(F.col("v"), 4).alias("r4"), exact_round(F.col("v"), 3).alias("r3")).collect()
    assert all(r.r4 == round(r.v, 4) and r.r3 == round(r.v, 3) for r in rows)


def test_check_sql_rounds_alike():
    values = [n / 160 for n in range(161)]
    con = duckdb.connect()
    for v in values:
        assert con.execute(f"SELECT {rnd(repr(v) + '::DOUBLE', 4)}").fetchall()[0][0] == round(v, 4)
