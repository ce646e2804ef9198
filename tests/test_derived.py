"""Log lines out of ``events``."""

from pyspark.sql import functions as F

from logwarden.catalog import derived as D


def test_lines_of_a_file_of_one_row_group_are_rendered_by_many_tasks(spark, tmp_path):
    spark.range(4000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 3}').alias("props"),
    ).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert spark.read.parquet(f"{tmp_path}/events.parquet").rdd.getNumPartitions() == 1
    for lines in (D.access_lines, D.auth_lines, D.replies, D.deep_replies):
        sizes = [r["count"] for r in lines(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 4000 and max(sizes) <= 4000 / spark.sparkContext.defaultParallelism
