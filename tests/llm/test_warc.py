import gzip
import hashlib
import io
import zipfile

import pytest

from lumenspan.llm import warc

SCHEMA = "page_id long, url string, html string, text string"


def pages(spark, *rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def test_round_trip(spark, tmp_path):
    big = "ü<p>" * 300_000
    df = pages(spark, (5, "http://a/é\r\nx", "<p>hi</p>"), (2, "http://b", "<p>hi</p>"), (9, None, None), (8, "u", ""), (1, "v", big), (None, "n", "<p>hi</p>"), (2, "http://b", "<p>hi</p>"))
    manifest = warc.write_archives(df, f"file://{tmp_path}/w")
    assert sum(r["records"] for r in manifest.collect()) == 7
    rows = warc.read_archives(manifest).collect()
    by = {}
    for r in rows:
        by.setdefault(r["page_id"], []).append(r)
    assert len(by[2]) == 2 and all(r["record_type"] == "response" for r in by[2])
    assert (by[5][0]["record_type"], by[5][0]["refers_to"], by[5][0]["payload_bytes"], by[5][0]["payload"]) == ("revisit", 2, 9, None)
    assert by[None][0]["refers_to"] == 2
    assert by[9][0]["refers_to"] == 8 and by[8][0]["payload"] == b"" and by[9][0]["url"] is None
    assert by[1][0]["payload"].decode() == big and by[5][0]["url"] == "http://a/é%0D%0Ax"
    assert all(r["payload_digest"] == warc.digest(r["payload"]) for r in rows if r["payload"] is not None)


def test_least_size_for_revisits(spark, tmp_path):
    df = pages(spark, (1, "a", "x"), (2, "b", "x"), (3, "c", "long enough"), (4, "d", "long enough"))
    rows = warc.read_archives(warc.write_archives(df, f"file://{tmp_path}/w", least=5)).collect()
    assert {r["page_id"]: r["record_type"] for r in rows} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty_table(spark, tmp_path):
    manifest = warc.write_archives(pages(spark, (1, "a", "b")).limit(0), f"file://{tmp_path}/w")
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("members", [3, 70_000])
def test_directories_also_zip64(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(members):
            z.writestr(zipfile.ZipInfo(f"m{i}"), f"content {i}")
        with z.open("wide", "w", force_zip64=True) as f:
            f.write(b"zip64 sizes")
        z.comment = b"a comment PK"
    data = out.getvalue()
    found = warc.read_directory(Bytes(data), len(data))
    assert len(found) == members + 1
    method, local, size = found[f"m{members - 1}"]
    start = warc._content_at(Bytes(data), local)
    assert method == 0 and data[start : start + size] == f"content {members - 1}".encode()
    assert found["wide"][2] == 11


def test_archive_without_index(tmp_path):
    records = [gzip.compress(warc.record(i, None, b"p" * i, None)) for i in range(5)]
    with zipfile.ZipFile(tmp_path / "x.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr(warc.DATA, b"".join(records))
    path = f"file://{tmp_path}/x.wacz"
    places = list(warc.record_places(path))
    data = (tmp_path / "x.wacz").read_bytes()
    parsed = [warc.parse_record(gzip.decompress(data[o : o + n])) for _, o, n in places]
    assert [p["page_id"] for p in parsed] == [0, 1, 2, 3, 4] and parsed[3]["payload"] == b"ppp"


def test_broken_payload_raises():
    raw = warc.record(1, "u", b"payload", None).replace(b"payload\r\n", b"pAyload\r\n")
    with pytest.raises(ValueError):
        warc.parse_record(raw)
    assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest().startswith("da39")


def test_a_hot_payload_is_spread_over_archives(spark, tmp_path):
    options = {
        "autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "16k", "adaptive.coalescePartitions.enabled": "false", "shuffle.partitions": "16",
        "adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(f"spark.sql.{k}", None) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(f"spark.sql.{k}", v)
        df = spark.range(1800, numPartitions=12).selectExpr("id AS page_id", "'u' AS url", "IF(id % 3 = 0, repeat(sha2('hot', 512), 8), repeat(sha2(string(id - id % 3), 512), 8)) AS html")
        manifest = warc.write_archives(df, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v) if v is not None else spark.conf.unset(f"spark.sql.{k}")
    assert sum(r["records"] for r in manifest) == 1800
    assert max(r["records"] for r in manifest) < 600  # the hot payload's copies


def test_folders_are_qualified(spark, tmp_path):
    assert warc.qualified(spark, f"{tmp_path}/a") == f"file://{tmp_path}/a"
    assert warc.qualified(spark, f"file:{tmp_path}/a") == f"file://{tmp_path}/a"
    assert warc.qualified(spark, f"file://{tmp_path}/a") == f"file://{tmp_path}/a"
    with pytest.raises(ValueError, match="can't be written"):
        warc.qualified(spark, "webhdfs://localhost/a")


def test_stores_have_the_reader_s_names(monkeypatch):
    asked = []
    monkeypatch.setattr(warc, "pafs", type("fs", (), {"FileSystem": type("FileSystem", (), {"from_uri": staticmethod(asked.append)})}))
    for uri in ("s3a://bucket/a", "s3n://bucket/a", "s3://bucket/a", "file:///a", "hdfs://host/a"):
        warc.open_system(uri)
    assert asked == ["s3://bucket/a"] * 3 + ["file:///a", "hdfs://host/a"]


def test_an_unqualified_folder_and_clashing_columns(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "x" * 50, "s", 7), (2, "http://b", "x" * 50, "t", 8), (None, None, None, None, None)], "page_id long, url string, html string, sha_ string, first_ int")
    manifest = warc.write_archives(pages, f"{tmp_path}/out")
    assert all(r["path"].startswith(f"file://{tmp_path}/out/") for r in manifest.collect())
    found = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.read_archives(manifest).collect())
    assert found == [(0, "response", None), (1, "response", None), (2, "revisit", 1)]
