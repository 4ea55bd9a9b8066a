"""Sharded WARC archives: written in key order, rolled by compressed size, committed by manifest.

``write_archive`` deals records into shards by ranges of their key. The bounds are quantiles of a
sample that a hash of the key picks, so they, the order of records, their headers and
the files depend on the rows alone. A shard's task writes its files, one gzip member per
record, to a folder of its own attempt, and reports them. Only when the report of one attempt of
every shard has been stored are these files renamed into place, and the manifest is
written last. Whatever is lost on the way is repeated; an archive without a manifest does not
exist, and files of lost attempts stay under ``_temporary``, which goes at the end.

Records get new headers and digests. Of equal payloads of ``least_bytes`` or more, the record with
the smallest key holds the payload, the others are revisits that point to it and
carry no payload. To find them only keys and digests are grouped; the rows with payloads move once.

Defined results: a null payload is empty; a null address has no target header, and control
characters in one are percent-encoded; rows without a key come first, are revisits if a record with a
key has their payload, and are never referred to; of rows with equal key and
payload the first is the response. An empty table is an archive without files. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from socialspark.session import cut

SHARD_BYTES = 32 << 20
ROLL_BYTES = 64 << 20
LEAST_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
KEYS_PER_SHARD = 64
_NAMESPACE = uuid.UUID("7c9f2f0e-52a4-5d0b-9a43-1a1c5b0f6f11")


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """Any file system that executors reach by its address."""
    if "://" not in folder and folder.startswith("file:"):
        folder = folder[5:]
    return fs.FileSystem.from_uri(folder)


def record_id(key, digest: str, turn: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{key}:{digest}:{turn}')}>"


def make_record(key, url: str | None, digest: str, payload: bytes, date: str, turn: int, first=None) -> bytes:
    """A response, or with ``first`` a revisit of the response with that key."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", record_id(key, digest, turn)),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if url is not None:
        safe = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)
        fields.append(("WARC-Target-URI", safe))
    if key is not None:
        fields.append(("X-Record-Key", key))
    if first is not None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(first, digest)),
            ("X-Refers-To-Key", first),
        ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member without a time of its own."""
    return gzip.compress(data, 6, mtime=0)


class _Files:
    """The files of one shard, in a folder of this attempt."""

    def __init__(self, folder: str, shard: int, roll_bytes: int, date: str) -> None:
        self.system, self.root = _open(folder)
        self.attempt, self.shard = uuid.uuid4().hex, shard
        self.roll_bytes, self.date = roll_bytes, date
        self.reports: list[dict] = []
        self.stream = None

    def add(self, record: bytes) -> None:
        if self.stream is None:
            self.name = f"part-{self.shard:06d}-{len(self.reports):06d}.warc.gz"
            self.temporary = f"_temporary/{self.attempt}/{self.name}"
            path = posixpath.join(self.root, self.temporary)
            self.system.create_dir(posixpath.dirname(path), recursive=True)
            self.stream = self.system.open_output_stream(path, compression=None)
            self.size, self.count, self.digest = 0, 0, hashlib.sha256()
            info = f"software: socialspark\r\nformat: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
            head = (
                f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(self.name, 'info')}\r\nWARC-Date: {self.date}\r\n"
                f"WARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
            )
            self._put(member(head.encode() + info + b"\r\n\r\n"))
        self._put(member(record))
        self.count += 1
        if self.size >= self.roll_bytes:
            self.close()

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.digest.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None
            self.reports.append(
                {"name": self.name, "temporary": self.temporary, "records": self.count, "bytes": self.size, "sha256": self.digest.hexdigest()}
            )


_MANIFEST = pa.schema(
    [("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]
)
_MANIFEST_SQL = "name string, temporary string, records long, bytes long, sha256 string"


def _writer(folder: str, roll_bytes: int, date: str):
    """Rows of shards in order; rows of kind 0 say which record holds the payload of a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: _Files | None = None
        key, firsts, turns = None, {}, {}

        def closed() -> pa.RecordBatch:
            files.close()
            return pa.RecordBatch.from_pylist(files.reports, _MANIFEST)

        for batch in batches:
            for shard, own, kind, digest, first, url, payload in zip(*(batch.column(i) for i in range(7)), strict=True):
                shard, own, digest = shard.as_py(), own.as_py(), digest.as_py()
                if files is None or files.shard != shard:
                    if files is not None:
                        yield closed()
                    files = _Files(folder, shard, roll_bytes, date)
                    key, firsts, turns = None, {}, {}
                if own != key:
                    key, firsts, turns = own, {}, {}
                if kind.as_py() == 0:
                    firsts[digest] = first.as_py()
                    continue
                turn = turns[digest] = turns.get(digest, -1) + 1
                holder = firsts.get(digest)
                if holder is not None and holder == own and turn == 0:
                    holder = None
                files.add(make_record(own, url.as_py(), digest, payload.as_py(), date, turn, holder))
        if files is not None:
            yield closed()

    return run


def _rename(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            for name, temporary in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source, target = posixpath.join(root, temporary), posixpath.join(root, name)
                if system.get_file_info(source).type == fs.FileType.File:
                    system.move(source, target)
                elif system.get_file_info(target).type != fs.FileType.File:
                    raise FileNotFoundError(f"{source} was reported and is gone")
            yield batch

    return run


def write_archive(
    pages: DataFrame,
    folder: str,
    key_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
    least_bytes: int = LEAST_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Write the records and return the manifest ``(name, records, bytes, sha256)``, as stored in ``folder``."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(key_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    meta = cut(rows.select("key", "digest", F.length("payload").cast("long").alias("size")))
    large = meta.where(F.col("size") >= least_bytes)
    holders = large.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    held = large.join(holders.drop("n"), "digest").select("key", "digest", "first").distinct()

    total = meta.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    sample = meta.select("key").where("key is not null").distinct().orderBy(F.xxhash64("key"), "key").limit(KEYS_PER_SHARD * shards)
    keys = np.sort(sample.toPandas()["key"].to_numpy(np.int64))  # bounded by the number of shards
    bounds = keys[np.arange(1, shards) * len(keys) // shards] if len(keys) else keys

    @F.pandas_udf("int")
    def shard_of(key: pd.Series) -> pd.Series:
        known = key.notna()
        shard = np.zeros(len(key), np.int32)
        shard[known] = np.searchsorted(bounds, key[known].astype(np.int64), side="right")
        return pd.Series(shard)

    both = rows.select("key", F.lit(1).alias("kind"), "digest", F.lit(None).cast("long").alias("first"), "url", "payload").unionByName(
        held.select("key", F.lit(0).alias("kind"), "digest", "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    )
    dealt = (
        both.select(shard_of("key").alias("shard"), "*")
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions("shard", F.asc_nulls_first("key"), "kind", "digest", F.asc_nulls_first("url"))
    )
    reports = cut(dealt.mapInArrow(_writer(folder, roll_bytes, date), _MANIFEST_SQL))
    moved = reports.mapInArrow(_rename(folder), _MANIFEST_SQL).drop("temporary")
    moved.write.parquet(f"{folder}/manifest")
    system, root = _open(folder)
    if system.get_file_info(posixpath.join(root, "_temporary")).type == fs.FileType.Directory:
        system.delete_dir(posixpath.join(root, "_temporary"))
    return spark.read.parquet(f"{folder}/manifest")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
        yield fields, block


_RECORD = pa.schema(
    [
        ("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()),
        ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("name", pa.string()),
    ]
)
_RECORD_SQL = (
    "key long, url string, record_type string, record_id string, refers_to_id string, refers_to long,"
    " payload_bytes long, payload_digest string, payload binary, name string"
)


def _read_record(fields: dict[str, str], block: bytes, name: str, with_payload: bool) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["warc-block-digest"]:
        raise ValueError(f"{name}: block of {fields['warc-record-id']} does not match its digest")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"{name}: payload of {fields['warc-record-id']} does not match its digest")
    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    key, first = fields.get("x-record-key"), fields.get("x-refers-to-key")
    return {
        "key": None if key is None else int(key),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "record_id": fields["warc-record-id"],
        "refers_to_id": fields.get("warc-refers-to"),
        "refers_to": None if first is None else int(first),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload if with_payload and kind == "response" else None,
        "name": name,
    }


def read_archive(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of a committed archive; a digest that does not match is an error."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    at_once = 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(posixpath.join(root, name), compression=None) as raw:
                    rows, held = [], 0
                    for fields, block in parse(gzip.GzipFile(fileobj=raw)):
                        if fields["warc-type"] == "warcinfo":
                            continue
                        rows.append(_read_record(fields, block, name, with_payload))
                        held += len(block)
                        if len(rows) >= at_once or held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _RECORD)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD)

    files = manifest.select("name").distinct()
    return files.repartition("name").mapInArrow(run, _RECORD_SQL)
