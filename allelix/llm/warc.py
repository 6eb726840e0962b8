"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame per record.

Writing decides by payload digest which record is a response and which ones revisit it. Every task
writes archives of bounded size to the shared folder under a name of its own attempt and renames
them, so that a task that is run again leaves whole files only. Reading decodes one frame at a time
and checks the version line, header fields, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.llm.common import table
from allelix.session import shared_dir, ship_package

#: Fixed values of the formats.
DICTIONARY_FRAME_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION_LINE = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of at least so many bytes are revisited.
MIN_REVISIT_BYTES = 0
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 32 << 10
SAMPLE_RECORDS, SAMPLE_BYTES = 200, 16 << 10
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record or archive that is not as its headers say."""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers["WARC-Type"]


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise WarcError(f"not an id of a page: {urn[:80]}")
    return int(urn[10:-1]) if urn[10:-1] else None


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A whole record; a revisit has the response's HTTP headers and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [VERSION_LINE, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> Record:
    """The record of one frame; anything that contradicts its headers raises ``WarcError``."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] != VERSION_LINE:
        raise WarcError(f"bad version line: {lines[0][:40]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name.strip() != name:
            raise WarcError(f"bad header line: {line[:80]!r}")
        headers[name] = value.strip()
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    length = headers["Content-Length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {length}, the frame holds {len(rest) - 4}")
    return Record(headers, rest[:-4])


def http_payload(record: Record) -> tuple[int, bytes]:
    """The length that the HTTP headers of a record's block state, and the bytes that follow them."""
    head, gap, payload = record.block.partition(b"\r\n\r\n")
    stated = [x.partition(b":")[2].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not gap or len(stated) != 1 or not stated[0].isdigit():
        raise WarcError("bad HTTP headers")
    return int(stated[0]), payload


class ArchiveWriter:
    """One archive in memory, at most about ``ARCHIVE_BYTES`` of records."""

    def __init__(self, sample: list[bytes]):
        self.out = io.BytesIO()
        sample = [s[:SAMPLE_BYTES] for s in sample if s]
        try:
            dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, sample)) // 8)), sample)
        except (zstandard.ZstdError, ValueError):  # too few records: one trained on the headers that all have
            sample = [make_record(i * 7919, f"https://www.example.org/{i}", b"", i if i % 3 else None, i % 3 > 0) for i in range(500)]
            dictionary = zstandard.train_dictionary(1024, sample)
        stored = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
        self.out.write(struct.pack("<II", DICTIONARY_FRAME_MAGIC, len(stored)) + stored)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
        self.records = 0

    def add(self, record: bytes) -> None:
        self.out.write(self.compressor.compress(record))
        self.records += 1


def read_archive(stream) -> Iterator[Record]:
    """Records of an archive, from any readable binary stream."""
    start = stream.read(8)
    if len(start) < 8:
        raise WarcError("no leading frame")
    magic, size = struct.unpack("<II", start)
    if magic != DICTIONARY_FRAME_MAGIC:
        raise WarcError("the leading frame holds no dictionary")
    stored = stream.read(size)
    if len(stored) != size:
        raise WarcError("the dictionary is cut off")
    if len(stored) >= 4 and struct.unpack("<I", stored[:4])[0] == FRAME_MAGIC:
        stored = zstandard.ZstdDecompressor().decompress(stored)
    engine = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stored))
    held = b""
    while held := held or stream.read(1 << 20):
        frame, raw = engine.decompressobj(), []
        while not frame.eof:
            if not held and not (held := stream.read(1 << 20)):
                raise WarcError("the last frame is cut off")
            try:
                raw.append(frame.decompress(held))
            except zstandard.ZstdError as bad:
                raise WarcError(f"bad frame: {bad}") from bad
            held = frame.unused_data if frame.eof else b""
        yield parse_record(b"".join(raw))


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def assign_revisits(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload (binary), refers_to and revisit of each row.

    Rows with the same payload of at least ``least`` bytes revisit the one of smallest page_id; rows
    that share that id are all responses, and a null page_id comes after all others. The first ids
    are found from digests alone; the join deals payloads out by digest, and adaptive execution
    splits a digest that many pages share.
    """
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("payload"))
    key = F.when(F.octet_length("payload") >= least, F.sha2("payload", 256))
    firsts = rows.select("page_id", key.alias("first_key")).where("first_key is not null").groupBy("first_key").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1 and first_id is not null")
    joined = rows.withColumn("key", key).join(firsts, F.col("key") == F.col("first_key"), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes every row of ``pages`` to archives in ``folder``; returns their paths and record counts.

    The rows come from writing: use the returned frame once, or store it. A null html is an empty
    payload, null ids and urls leave their headers out, repeated rows are records each, other columns
    are not read, and no rows write no archive.
    """
    ship_package(pages.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        number = 0

        def save(pending: list[bytes]) -> pa.RecordBatch:
            nonlocal number
            archive = ArchiveWriter(pending[:SAMPLE_RECORDS])
            for record in pending:
                archive.add(record)
            name = f"{base}/pages-{context.partitionId():06d}-{number:05d}-{context.taskAttemptId()}.warc.zst"
            with store.open_output_stream(name + ".part", compression=None) as out:
                out.write(archive.out.getbuffer())
            store.move(name + ".part", name)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([archive.records], pa.int64()), pa.array([archive.out.tell()], pa.int64())], names=["path", "records", "bytes"])

        pending: list[bytes] = []
        size = 0
        for batch in batches:
            for page_id, url, payload, refers_to, revisit in zip(*(batch.column(i) for i in range(5)), strict=True):
                record = make_record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), revisit.as_py())
                if pending and size + len(record) > ARCHIVE_BYTES:
                    yield save(pending)
                    pending, size = [], 0
                pending.append(record)
                size += len(record)
        if pending:
            yield save(pending)

    return assign_revisits(pages, least).mapInArrow(run, "path string, records long, bytes long")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives: page_id, url, payload (null for a revisit), payload_bytes, payload_digest, record_type, refers_to.

    Raises if an archive holds another number of records than ``records`` says, or a payload is not
    as long as its headers say or has another digest. Headers that a record leaves out are null; no
    archives give no rows.
    """
    ship_package(archives.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            for path, stated in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                size = count = 0
                with store.open_input_stream(path, compression=None) as stream:
                    for record in read_archive(stream):
                        length, payload = http_payload(record)
                        digest = record.headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                        if record.kind == "response":
                            if len(payload) != length or digest_of(payload) != digest:
                                raise WarcError(f"{record.headers['WARC-Record-ID']}: the payload is not as its headers say")
                            refers_to = None
                        elif record.kind == "revisit" and not payload and record.headers.get("WARC-Profile") == REVISIT_PROFILE:
                            refers_to, payload = page_of(record.headers.get("WARC-Refers-To", "")), None
                        else:
                            raise WarcError(f"unexpected record: {record.kind}")
                        rows.append((page_of(record.headers["WARC-Record-ID"]), record.headers.get("WARC-Target-URI"), payload, length, digest, record.kind, refers_to))
                        size += length
                        count += 1
                        if size > 8 << 20:
                            yield _as_batch(rows)
                            rows, size = [], 0
                if count != stated:
                    raise WarcError(f"{path} holds {count} records of {stated}")
                if rows:
                    yield _as_batch(rows)

    return archives.select("path", "records").mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def archive_round_trip(pages: DataFrame, folder: str | None = None, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes all ``pages`` as archives and reads them back, one row for each row of ``pages``.

    A null html is an empty payload; null page_ids and urls stay null; repeated rows are records
    each; an empty table writes nothing. Other columns are not read.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    # the manifest names the files of the attempts that counted; it is small and stored
    manifest = f"{folder}/manifest.parquet"
    write_archives(pages, f"{folder}/archives", least).write.parquet(manifest)
    archives = pages.sparkSession.read.parquet(manifest)
    spread = archives.repartition(max(1, min(10_000, archives.count())))
    return read_archives(spread, f"{folder}/archives")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from the archives of all pages: see ``archive_round_trip``."""
    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB gives SHA-1 in hexadecimal; base32 is taken from it five bits at a time.
ORACLE_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p),
b AS (SELECT *, list_transform(range(0, 32), lambda i:
  (('0x' || substr(h, 1 + (5 * i) // 4, 1))::INT * 16 + coalesce(('0x' || nullif(substr(h, 2 + (5 * i) // 4, 1), ''))::INT, 0)) >> (3 - (5 * i) % 4) & 31) AS g FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(g, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM b"""
