"""Which tables reach the driver."""

from pyspark.sql import functions as F

from worktrail.session import pinned, prepare_tables


def test_tables_of_few_values_are_not_taken_for_small(spark):
    keep = {c: spark.conf.get(c) for c in ("spark.sql.sources.fileCompressionFactor", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", "1.0")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
        same = [F.lit(c * 200).alias(c) for c in "abcdefgh"]
        wide = pinned(spark.range(20000).select("id", *same).coalesce(1))
        small = pinned(spark.range(50).coalesce(1))
        way = lambda a, b: a.join(b, "id")._jdf.queryExecution().executedPlan().toString()
        joined = spark.range(10**7).withColumn("x", F.rand())
        assert "BroadcastHashJoin" in way(joined, wide)
        prepare_tables(spark)
        assert "BroadcastHashJoin" not in way(joined, wide)
        assert "BroadcastHashJoin" in way(joined, small)
        spark.conf.set("spark.sql.sources.fileCompressionFactor", "100.0")
        prepare_tables(spark)
        assert spark.conf.get("spark.sql.sources.fileCompressionFactor") == "100.0"
    finally:
        for name, value in keep.items():
            spark.conf.set(name, value)
