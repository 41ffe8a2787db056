"""WARC records in ZIP-packaged archives: write, locate and range-read.

An archive is one ZIP file with stored (uncompressed) members: ``archive/data.warc.gz``,
in which every record is a gzip member of its own, and ``indexes/index.cdxj``, one JSON
line a record with offset and length. The reader parses the end records, the central
directory (ZIP64 included) and the index, and then reads single records by their byte
ranges; nothing is extracted. Archives without an index are walked record by record.

Files are opened through Arrow's file systems, so the folder may be local, S3, GCS or
HDFS, as long as all executors reach it. Each attempt of a task writes a file of its
own and only files of finished tasks enter the manifest, so lost executors do no harm.

Defined results: a null html is an empty payload; of equal payloads of at least
``least`` bytes the one with the smallest page id is the response and the others
revisit it; rows without a page id are revisits of it too, or responses if no row of
their payload has an id; repeated rows of the smallest id are responses all; a null
url is left out of the record; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm.common import fresh_path, materialize

#: Packed bytes of the records that one task reads.
READ_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


#: Names that Hadoop and Arrow give to the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def open_system(uri: str) -> tuple[pafs.FileSystem, str]:
    scheme, mark, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + mark + rest)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme and store that Spark takes it to be in, so that tasks open the same one.

    Without a scheme it lies in Spark's default file system, not in a task's own. A store
    that the archives' reader doesn't know raises ``ValueError`` here rather than in a task.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    full = "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full
    try:
        open_system(full)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as error:
        raise ValueError(f"archives can't be written to {full}") from error
    return full


# ---- records ------------------------------------------------------------------------


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit (``refers_to`` given) holds the response's headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head += [f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    head += [] if url is None else [f"WARC-Target-URI: {_clean(url)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] * (refers_to is not None)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(urn: str) -> int | None:
    value = urn.strip("<>").removeprefix("urn:page:")
    return int(value) if value else None


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in lines.decode("utf-8").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def parse_record(raw: bytes) -> dict:
    """A record's columns and its payload (None for a revisit). Wrong lengths and digests raise ValueError."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    named = _headers(head)
    block = rest[: int(named["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, revisit = int(_headers(http)["content-length"]), named["warc-type"] == "revisit"
    stated = named["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != size or digest(payload) != stated):
        raise ValueError(f"payload of {named['warc-record-id']} doesn't match its length or digest")
    return {
        "page_id": _page(named["warc-record-id"]), "url": named.get("warc-target-uri"), "record_type": named["warc-type"],
        "refers_to": _page(named["warc-refers-to"]) if revisit else None, "payload_bytes": size, "payload_digest": stated,
        "payload": None if revisit else payload,
    }


# ---- writing ------------------------------------------------------------------------


def with_first(pages: DataFrame, least: int = 0) -> DataFrame:
    """Rows (page_id, url, html, first_): the page to refer to, null for responses."""
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.when(F.octet_length(html) >= least, F.sha1(html.cast("binary"))).alias("sha_"))
    # Written first, so that the join on a hot payload is dealt anew and Spark can split it over tasks, and so over archives.
    groups = materialize(keyed.where("sha_ IS NOT NULL").groupBy("sha_").agg(F.min("page_id").alias("first_"), F.count("*").alias("n_")).where("n_ > 1").drop("n_"), "warc-groups")
    same = F.col("page_id").eqNullSafe(F.col("first_"))
    return keyed.join(groups, "sha_", "left").select("page_id", "url", "html", F.when(~same, F.col("first_")).alias("first_"))


def _write_part(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    system, base = open_system(folder)
    system.create_dir(base, recursive=True)
    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.wacz"
    index, n, place = io.BytesIO(), 0, 0
    batches = (b for b in batches if b.num_rows)
    first = next(batches, None)
    if first is None:
        return
    with system.open_output_stream(f"{base}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        with archive.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as data:
            batch = first
            while batch is not None:
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    packed = gzip.compress(record(page_id, url, html.encode("utf-8"), refers_to), 6, mtime=0)
                    data.write(packed)
                    index.write(json.dumps({"page": page_id, "filename": DATA, "offset": place, "length": len(packed)}).encode() + b"\n")
                    place, n = place + len(packed), n + 1
                batch = next(batches, None)
        archive.writestr(zipfile.ZipInfo(INDEX), index.getvalue())
    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n]})


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write one archive a task into ``folder`` (by default in the shared folder); the manifest (path, records)."""
    folder = qualified(pages.sparkSession, folder or fresh_path(pages.sparkSession, "warc"))
    return materialize(with_first(pages, least).mapInArrow(partial(_write_part, folder), "path string, records long"), "warc-manifest")


# ---- reading ------------------------------------------------------------------------


def read_directory(file, size: int) -> dict[str, tuple[int, int, int]]:
    """The members of a ZIP file: name -> (method, offset of the local header, stored size)."""
    tail_at = max(0, size - 65_557)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    located = end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07"
    if located and (count == 0xFFFF or 0xFFFFFFFF in (length, start)):
        (at,) = struct.unpack_from("<Q", tail, end - 12)
        count, length, start = struct.unpack_from("<QQQ", file.read_at(56, at), 32)
    directory, at, found = file.read_at(length, start), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        (method,) = struct.unpack_from("<H", directory, at + 10)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        (local,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:  # ZIP64: 8 bytes for each field that is full, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + n :]
        found[name] = (method, local, packed)
        at += 46 + n_name + n_extra + n_comment
    return found


def _content_at(file, local: int) -> int:
    head = file.read_at(30, local)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    return local + 30 + sum(struct.unpack_from("<HH", head, 26))


def _walk(file, start: int, size: int) -> Iterator[tuple[int, int]]:
    """Places of the gzip members in a stored member without index, as (offset, length)."""
    inflate, began, at = zlib.decompressobj(31), start, start
    while at < start + size:
        chunk = file.read_at(min(1 << 20, start + size - at), at)
        at += len(chunk)
        while chunk:
            inflate.decompress(chunk)
            if not inflate.eof:
                break
            chunk = inflate.unused_data
            yield began, at - len(chunk) - began
            began, inflate = at - len(chunk), zlib.decompressobj(31)


def _lines(file, start: int, size: int) -> Iterator[bytes]:
    """The lines of a stored member, read in chunks."""
    rest, at = b"", start
    while at < start + size:
        chunk = file.read_at(min(1 << 20, start + size - at), at)
        at += len(chunk)
        *lines, rest = (rest + chunk).split(b"\n")
        yield from (x for x in lines if x)
    if rest:
        yield rest


def record_places(path: str) -> Iterator[tuple[str, int, int]]:
    """(path, offset, length) of every record of an archive."""
    system, name = open_system(path)
    with system.open_input_file(name) as file:
        members = read_directory(file, file.size())
        starts = {k: _content_at(file, local) for k, (method, local, _) in members.items() if method == 0}
        indexed = set()
        for member in sorted(k for k in starts if k.startswith("indexes/")):
            for line in _lines(file, starts[member], members[member][2]):
                entry = json.loads(line)
                indexed.add(entry["filename"])
                yield path, starts[entry["filename"]] + entry["offset"], entry["length"]
        for member in sorted(k for k in starts if k.startswith("archive/") and k not in indexed):
            yield from ((path, a, n) for a, n in _walk(file, starts[member], members[member][2]))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows = record_places(path)
            while some := list(islice(rows, 50_000)):
                p, o, n = zip(*some, strict=True)
                yield pa.RecordBatch.from_pydict({"path": p, "offset": o, "length": n})


def _records(with_payload: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")] + ["payload"] * with_payload
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_payload
    held, file = None, None

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types, strict=True)], names=names)

    for batch in batches:
        rows, size = [], 0
        for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if path != held:
                system, name = open_system(path)
                held, file = path, system.open_input_file(name)
            rows.append(parse_record(gzip.decompress(file.read_at(length, offset))))
            size += rows[-1]["payload_bytes"]
            if with_payload and size > 1 << 24:
                yield packed(rows)
                rows, size = [], 0
            elif not with_payload:
                rows[-1]["payload"] = None
        yield packed(rows)


def read_archives(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives named in column ``path``.

    Indexes are read first; their entries are then dealt out by file and offset, so one
    large archive is read by many tasks, each of about READ_BYTES.
    """
    spark = paths.sparkSession
    places = paths.select("path").repartition("path").mapInArrow(_places, "path string, offset long, length long")
    places = materialize(places, "warc-places")
    packed = places.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, packed // READ_BYTES)
    dealt = places.repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(partial(_records, with_payload), RECORD_SCHEMA + ", payload binary" * with_payload)
