import zlib

from lumenspan.llm import sharding


def test_contiguous_balanced_and_gapless(spark, docs):
    df = docs(*[(i, "x" * (i * 37 % 101), "en", "s") for i in range(400)])
    rows = sorted(sharding.shard_documents(df).collect(), key=lambda r: r["doc_id"])
    shards = [r["shard"] for r in rows]
    assert shards == sorted(shards) and set(shards) == set(range(8))
    sizes = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 2 * 101
    for k in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(shards.count(k)))
    assert all(r["text_crc32"] == zlib.crc32(b"x" * (r["size"] - 1)) for r in rows)


def test_null_empty_repeated_and_empty_table(spark, docs):
    df = docs((None, None), (1, ""), (1, ""), (2, "é" * 3), extra=True)
    rows = sharding.shard_documents(df).collect()
    assert sorted(r["size"] for r in rows) == [1, 1, 1, 7]
    assert len({(r["shard"], r["slot"]) for r in rows}) == 4
    assert sharding.shard_documents(df.limit(0)).count() == 0


def test_one_document_longer_than_all_targets(spark, docs):
    rows = sharding.shard_documents(docs((1, "a"), (2, "b" * 1_000_000), (3, "c"))).collect()
    assert len(rows) == 3 and all(r["slot"] >= 0 for r in rows)


def test_written_shards_hold_everything_in_order(spark, docs, tmp_path):
    df = docs(*[(i, "y" * i) for i in range(50)])
    sharding.write_shards(df, f"file://{tmp_path}/out", 4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == 50 and set(r["shard"] for r in back.select("shard").distinct().collect()) <= {0, 1, 2, 3}
