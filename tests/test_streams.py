import pytest
from pyspark.sql import functions as F

from lumigrid.session import new_folder
from lumigrid.streaming import video

DATA = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def folder(spark):
    path = new_folder(spark, "events")
    spark.read.parquet(DATA).orderBy("ts", "event_id").coalesce(1).write.parquet(path)
    return path


def run(query, name, mode):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_rates_match_the_batch(spark, folder):
    run(video.rates(video.event_stream(spark, folder)), "rates", "complete")
    batch = video.rates(spark.read.parquet(DATA).withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, batch.collect()))


def test_decimation_matches_the_batch(spark, folder):
    run(video.decimate_stream(video.event_stream(spark, folder)), "decimated", "append")
    assert sorted(map(repr, map(tuple, spark.table("decimated").collect()))) == sorted(map(repr, map(tuple, video.decimate(spark.read.parquet(DATA)).collect())))


def test_detect_stream(spark, folder):
    seen = []
    q = video.detect_stream(video.event_stream(spark, folder), lambda df, least: df.where(F.col("value") > least), lambda df, k: seen.append(df.count()), new_folder(spark, "progress"), lambda: {"least": 10})
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == spark.read.parquet(DATA).where("value > 10").count()
