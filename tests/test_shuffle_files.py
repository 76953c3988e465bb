"""What is left on disk when an intermediate table has been written."""

import time

from pyspark.sql import functions as F

from trackgrid import scale


def test_shuffles_of_a_written_table_are_deleted(spark):
    """They used to stay until the driver happened to collect garbage."""
    def files():
        return [f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
            spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")]

    before, switch = set(files()), spark.conf.get(scale.SHUFFLE_CLEANUP, None)
    table = scale.materialize(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.count("*").alias("n")).join(spark.range(600).withColumnRenamed("id", "k").hint("merge"), "k"), "clean")
    until = time.time() + 20
    while set(files()) - before and time.time() < until:
        time.sleep(0.2)
    assert set(files()) <= before
    assert table.count() == 600 and table.agg(F.sum("n")).first()[0] == sum(8 if k < 100 else 7 for k in range(600))
    assert spark.conf.get(scale.SHUFFLE_CLEANUP, None) == switch
