"""The streaming forms give the batch form's closed windows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenspan.streaming import windows as S

SCHEMA = "event_id long, platform string, user_id long, ts timestamp, value double"


@pytest.fixture
def source(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    rows = [(i % 90, "twitch", i % 3, start + dt.timedelta(seconds=7 * i), float(i)) for i in range(100)]
    rows.append((999, "twitch", 0, start + dt.timedelta(days=1), 0.0))  # moves the watermark past all windows
    path = f"file://{tmp_path}/in"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path), spark.readStream.schema(SCHEMA).parquet(path)


def drained(spark, df, tmp_path, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return spark.table(name)


@pytest.mark.parametrize("form", ["tumbling", "hopping", "sessions"])
def test_closed_windows_equal_batch(spark, source, tmp_path, form):
    batch, stream = source
    shape = {"tumbling": lambda x: S.tumbling(x, "60 seconds"), "hopping": lambda x: S.hopping(x, "60 seconds", "20 seconds"), "sessions": lambda x: S.sessions(x, "30 seconds")}[form]
    flat = lambda x: sorted(tuple(r) for r in x.select("window.start", "n", "total").collect())
    closed = shape(batch).where(F.col("window.end") < "2024-01-01 12:00:00")
    assert flat(drained(spark, shape(S.watermarked(stream, "10 seconds")), tmp_path, f"out_{form}")) == flat(closed)


def test_intake_once(spark, source, tmp_path):
    batch, stream = source
    assert S.once(batch).count() == 91
    assert drained(spark, S.once(stream, streaming_delay="1 hour"), tmp_path, "out_once").count() == 91
