"""Tables are written in methods that HotSpot compiles, whatever the session's own limit."""

from pyspark.sql import functions as F

from matchspark.session import METHOD_BYTES, METHOD_LIMIT, cut


def test_cut_limits_methods_and_restores_the_session(spark, monkeypatch):
    own, seen = spark.conf.get(METHOD_LIMIT), []
    writer = type(spark.range(1).write)
    parquet = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, *a, **k: (seen.append(spark.conf.get(METHOD_LIMIT)), parquet(self, *a, **k))[1])
    try:
        for limit in ("65535", "4000"):
            spark.conf.set(METHOD_LIMIT, limit)
            assert cut(spark.range(5).withColumn("x", F.col("id") * 2), "limits").count() == 5
            assert spark.conf.get(METHOD_LIMIT) == limit
    finally:
        spark.conf.set(METHOD_LIMIT, own)
    assert seen == [str(METHOD_BYTES), "4000"]
