"""Tables written to the folder that driver and executors share, to cut lineage between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What this session has written and not removed yet.
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder, which is
    then remembered in the setting.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumenspan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/lumenspan/{uuid.uuid4().hex}-{name}"
    _WRITTEN.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs its own tasks only, and fixes
    values that a second evaluation might give differently.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> int:
    """Remove what this session wrote in the shared folder; results still read from it must have been saved elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    removed = 0
    while _WRITTEN:
        place = path(_WRITTEN.pop())
        removed += place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return removed
