"""Queries over events repeated with shifted keys: many rows at one time, where equal numbers must stay equal."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenspan.operators import fusion as U
from lumenspan.plans import registry
from lumenspan.plans.q_selection import _BOOST

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def repeated_tables(folder, source, times):
    """The tables of ``source`` as views, with each event ``times`` times under other numbers."""
    os.makedirs(folder, exist_ok=True)
    connection = duckdb.connect()
    for path in glob.glob(f"{source}/*.parquet"):
        name = os.path.basename(path)[:-8]
        if name == "events":
            connection.sql(f"COPY (SELECT event_id + 1000000 * i AS event_id, ts, user_id, event_type, value, props FROM '{path}' CROSS JOIN (SELECT UNNEST(range({times})) AS i)) TO '{folder}/events.parquet'")
        else:
            os.symlink(path, f"{folder}/{name}.parquet")
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("repeated"))
    return folder, repeated_tables(folder, "/root/testdata/sf0.01", 9)


def by_key(records, columns, keys):
    places = [columns.index(k) for k in keys]
    rest = sorted((c, i) for i, c in enumerate(columns) if c not in keys)
    return {tuple(r[p] for p in places): tuple(r[i] for _, i in rest) for r in records}


def differences(spark, repeated, name, keys):
    """Keys whose rows are not the same to the last digit."""
    folder, duck = repeated
    found = QUERIES[name](spark, folder)
    expected = duck.sql(SQL[name])
    ours, theirs = by_key(found.collect(), found.columns, keys), by_key(expected.fetchall(), expected.columns, keys)
    assert len(theirs) > 100
    return sorted(k for k in {*ours, *theirs} if ours.get(k) != theirs.get(k))


def test_post_processed_to_the_last_digit(spark, repeated):
    assert differences(spark, repeated, "g24_post_processed", ["id"]) == []


def test_boosted_confidence_has_the_bits_of_its_sql(spark):
    """with 1.1 - 1 for 0.1 and squares summed in another way, some ninth digits of g24 went the other way."""
    table = "SELECT a / 50::DOUBLE AS score, 0.5::DOUBLE + b / 200::DOUBLE AS confidence FROM range(50) x(a) CROSS JOIN range(100) y(b)"
    rows = duckdb.sql(table)
    expected = duckdb.sql(f"SELECT score, confidence, {_BOOST} FROM ({table})").fetchall()
    df = spark.createDataFrame(rows.fetchall(), "score double, confidence double")
    boosted = U.boosted_confidence(F.col("confidence"), F.array("score", "confidence", F.lit(0.5)))
    found = df.select("score", "confidence", boosted).collect()
    assert sorted(map(tuple, found)) == sorted(expected)


def test_equal_scores_are_no_improvement(spark, repeated):
    """where all scores around are equal, noise decided whether a score had improved."""
    assert differences(spark, repeated, "k09_processing_metrics", ["stream_id"]) == []
