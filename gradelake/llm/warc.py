"""WARC archives: writing, turning whole-file gzip into one member per record, reading back."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.common import settled, table
from gradelake.session import scratch_folder

# An archive is closed once it holds so many bytes of records, or so many records.
ARCHIVE_BYTES = 64 << 20
ARCHIVE_RECORDS = 1 << 16
# Payloads below this are never revisits.
LEAST_SHARED = 0
# Bytes read, inflated or copied at a time.
CHUNK = 1 << 18
MAX_HEAD = 1 << 20
# Tasks that archives are dealt over at most; beyond that a task takes several, one by one.
MOST_TASKS = 1 << 14
GZIP = 31
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class DamagedArchive(ValueError):
    """An archive that ends early, or whose parts do not fit together."""


# --- storage ---------------------------------------------------------------------------------


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a file in the shared folder (a path, or a URI that Arrow knows)."""
    return fs.FileSystem.from_uri(path)


@contextmanager
def _writing(path: str) -> Iterator[BinaryIO]:
    system, name = _place(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(name, compression=None) as sink:
        yield sink


@contextmanager
def _reading(path: str) -> Iterator[BinaryIO]:
    system, name = _place(path)
    with system.open_input_file(name) as source:
        yield source


def _attempt_name() -> str:
    """A file name of this task attempt; only names of finished attempts are ever read."""
    context = TaskContext.get()
    return f"part-{context.partitionId():06d}-{context.taskAttemptId()}"


# --- records ---------------------------------------------------------------------------------


def payload_digest(payload: bytes) -> str:
    return base32(hashlib.sha1(payload).digest())


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(archive: str, number: int) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{archive}#{number}").urn


def uri_fields(url: str | None) -> list[tuple[str, str]]:
    """Header fields of a URL: as it is, or escaped and marked when a line cannot hold it."""
    if url is None:
        return []
    if url == url.strip() and not re.search(r"[\x00-\x1f\x7f]", url):
        return [("WARC-Target-URI", url)]
    return [("WARC-Target-URI", quote(url, safe="")), ("X-Escaped", "WARC-Target-URI")]


def uri_of(fields: dict[str, str]) -> str | None:
    url = fields.get("WARC-Target-URI")
    return unquote(url) if "X-Escaped" in fields else url


def head_bytes(fields: list[tuple[str, str]]) -> bytes:
    lines = [VERSION, *(f"{name}: {value}" for name, value in fields)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8")


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise DamagedArchive(f"a record starts with {lines[0][:40]!r}")
    return dict(line.split(": ", 1) for line in lines[1:] if line)


def response_block(payload_bytes: int) -> bytes:
    """The reply's own headers; the payload follows them."""
    return (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {payload_bytes}\r\n\r\n"
    ).encode()


def response_head(number_id: str, page: str | None, url: str | None, payload: bytes) -> bytes:
    """Head and reply headers of a response record; the payload and a blank line follow."""
    reply = response_block(len(payload))
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{number_id}>"), ("WARC-Date", DATE)]
    fields += uri_fields(url)
    if page is not None:
        fields.append(("X-Page-Id", page))
    fields += [
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(reply) + len(payload))),
    ]
    return head_bytes(fields) + reply


# --- writing whole-file archives ---------------------------------------------------------------


class _WholeFile:
    """An archive whose records are compressed as one stream, as some crawlers leave them."""

    def __init__(self, folder: str, name: str):
        self.name, self.records, self.size = name, 0, 0
        self._file = _writing(f"{folder}/{name}")
        self._sink = self._file.__enter__()
        self._packer = zlib.compressobj(1, zlib.DEFLATED, GZIP)

    def add(self, page: str | None, url: str | None, payload: bytes) -> None:
        head = response_head(record_id(self.name, self.records), page, url, payload)
        for piece in (head, payload, b"\r\n\r\n"):
            self._sink.write(self._packer.compress(piece))
        self.records += 1
        self.size += len(head) + len(payload) + 4

    def close(self) -> None:
        self._sink.write(self._packer.flush())
        self._file.__exit__(None, None, None)


def write_archives(
    pages: DataFrame,
    folder: str,
    archive_bytes: int = ARCHIVE_BYTES,
    archive_records: int = ARCHIVE_RECORDS,
) -> DataFrame:
    """One response record per row of ``pages`` (page_id, url, html), in whole-file gzip archives.

    Returns archive, number (place in the archive), page_id, payload_bytes and digest of every
    record. Each task fills archives of its own; nothing is shuffled and one page is held at a
    time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, serial = None, 0
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                rows = []
                columns = [part.column(0), part.column(1), part.column(2).cast(pa.binary())]
                for page, url, html in zip(*[c.to_pylist() for c in columns], strict=True):
                    if archive is None:
                        name = f"{_attempt_name()}-{serial:04d}.warc.gz"
                        archive, serial = _WholeFile(folder, name), serial + 1
                    payload = html or b""
                    number = archive.records
                    archive.add(None if page is None else str(page), url, payload)
                    digest = hashlib.sha1(payload).digest()
                    rows.append((archive.name, number, page, len(payload), digest))
                    if archive.size >= archive_bytes or archive.records >= archive_records:
                        archive.close()
                        archive = None
                yield _batch(rows, WRITTEN)
        if archive is not None:
            archive.close()

    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    return settled(rows.mapInArrow(run, _ddl(WRITTEN)), "warc-written")


WRITTEN = {
    "archive": pa.string(), "number": pa.int64(), "page_id": pa.int64(),
    "payload_bytes": pa.int64(), "digest": pa.binary(),
}
NORMALISED = {"archive": pa.string(), "sidecar": pa.string(), "records": pa.int64()}
READ = {
    "page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(),
    "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
    "record_id": pa.string(),
}
_SPARK = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary"}


def _ddl(fields: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{name} {_SPARK[kind]}" for name, kind in fields.items())


def _batch(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(columns, fields.values(), strict=True)],
        names=list(fields),
    )


def revisits(written: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """archive, number and head of every record that repeats an earlier payload.

    Of the records with one digest and length the response is the one with the smallest page_id,
    of equal ids the first by archive and number; a null page_id comes last. ``head`` holds the
    response's page_id, archive and number. Only digests and places are shuffled, and heads are
    found before the shuffle.
    """
    place = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "archive", "number")
    heads = written.where(F.col("payload_bytes") >= least_shared).groupBy(
        F.col("digest").alias("shared"), F.col("payload_bytes").alias("shared_bytes")
    ).agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("copies"))
    heads = heads.where(F.col("copies") > 1)
    return written.join(
        heads,
        (F.col("digest") == F.col("shared")) & (F.col("payload_bytes") == F.col("shared_bytes")),
    ).where(
        (F.col("archive") != F.col("head.archive")) | (F.col("number") != F.col("head.number"))
    ).select(
        "archive", "number", F.col("head.page_id").alias("head_page"),
        F.col("head.archive").alias("head_archive"), F.col("head.number").alias("head_number"),
    )


# --- normalising -------------------------------------------------------------------------------


class Inflated:
    """Bytes of a gzip stream of any number of members, inflated once from start to end."""

    def __init__(self, source: BinaryIO, chunk: int = CHUNK):
        self._source, self._chunk = source, chunk
        self._inflater = zlib.decompressobj(GZIP)
        self._held, self._at = b"", 0  # inflated bytes, and how many of them are used up
        self._begun = False
        self._raw = b""

    def _more(self) -> bool:
        """Hold more inflated bytes, in steps of about a chunk; False at the end."""
        while True:
            if not self._raw:
                self._raw = self._source.read(self._chunk)
                if not self._raw:
                    if self._begun and not self._inflater.eof:
                        raise DamagedArchive("the gzip stream ends early")
                    return False
            if self._inflater.eof:
                self._inflater, self._begun = zlib.decompressobj(GZIP), False
            self._begun = True
            try:
                found = self._inflater.decompress(self._raw, self._chunk)
            except zlib.error as error:
                raise DamagedArchive(str(error)) from error
            eof = self._inflater.eof
            self._raw = self._inflater.unused_data if eof else self._inflater.unconsumed_tail
            if found:
                self._held, self._at = self._held[self._at :] + found, 0
                return True

    def line_block(self) -> bytes:
        """Bytes up to a blank line, without it; empty at the end of the stream."""
        while (end := self._held.find(b"\r\n\r\n", self._at)) < 0:
            if len(self._held) - self._at > MAX_HEAD:
                raise DamagedArchive("a head does not end")
            if not self._more():
                if len(self._held) > self._at:
                    raise DamagedArchive("a head does not end")
                return b""
        block, self._at = self._held[self._at : end], end + 4
        return block

    def take(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes, piece by piece."""
        while size:
            if len(self._held) == self._at and not self._more():
                raise DamagedArchive("a record ends early")
            piece = self._held[self._at : self._at + size]
            self._at += len(piece)
            size -= len(piece)
            yield piece


class Members:
    """Writes records as gzip members of their own and keeps their places."""

    def __init__(self, sink: BinaryIO):
        self._sink, self.index, self._at = sink, [], 0

    def add(self, fields: dict[str, str], pieces: Iterator[bytes]) -> None:
        packer, start = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), self._at
        self._put(packer.compress(head_bytes(list(fields.items()))))
        for piece in pieces:
            self._put(packer.compress(piece))
        self._put(packer.compress(b"\r\n\r\n"))
        self._put(packer.flush())
        self.index.append(
            {
                "offset": start,
                "length": self._at - start,
                "type": fields.get("WARC-Type"),
                "id": fields.get("WARC-Record-ID"),
                "uri": fields.get("WARC-Target-URI"),
                "digest": fields.get("WARC-Payload-Digest"),
            }
        )

    def _put(self, data: bytes) -> None:
        if data:
            self._sink.write(data)
            self._at += len(data)


def normalise_stream(source: BinaryIO, sink: BinaryIO, turned: dict[int, dict[str, str]]) -> list:
    """Rewrite every record of ``source`` as a member of its own in ``sink``; the offset index.

    ``source`` is inflated once, whether it is one gzip stream or many. ``turned`` names records
    by their place that become revisits, with the fields they get; of their block the reply's
    headers stay. Other records keep their fields and bytes.
    """
    inflated, members, number = Inflated(source), Members(sink), 0
    while head := inflated.line_block():
        fields = parse_head(head)
        block = inflated.take(int(fields["Content-Length"]))
        if number in turned:
            reply = _reply_headers(block)
            fields |= turned[number] | {
                "WARC-Type": "revisit", "WARC-Profile": PROFILE, "Content-Length": str(len(reply)),
            }
            members.add(fields, iter([reply]))
        else:
            members.add(fields, block)
        if b"".join(inflated.take(4)) != b"\r\n\r\n":
            raise DamagedArchive("a record is longer than its Content-Length")
        number += 1
    return members.index


def _reply_headers(block: Iterator[bytes]) -> bytes:
    """The first lines of a block, to the blank line; the rest is read and left out."""
    found = b""
    for piece in block:
        if b"\r\n\r\n" not in found:
            found += piece
    end = found.find(b"\r\n\r\n")
    return found[: end + 4] if end >= 0 else b""


def normalise(written: DataFrame, turned: DataFrame, source: str, folder: str) -> DataFrame:
    """Archives of ``written`` with one gzip member per record, and a sidecar index beside each.

    Returns archive, sidecar and records. A task takes one archive, and with it the places of
    its records that become revisits, at most as many as an archive holds. A sidecar has one
    JSON line per record: offset, length, type, id, uri, digest.
    """

    def run(frame: pa.Table) -> pa.Table:
        name = frame.column("archive")[0].as_py()
        changes = {
            r["number"]: _revisit_fields(r)
            for r in frame.to_pylist()
            if r["number"] is not None
        }
        made = f"{_attempt_name()}-{name}"
        with _reading(f"{source}/{name}") as raw, _writing(f"{folder}/{made}") as sink:
            index = normalise_stream(raw, sink, changes)
        with _writing(f"{folder}/{made}.idx") as sink:
            for entry in index:
                sink.write((json.dumps(entry) + "\n").encode())
        return pa.Table.from_batches([_batch([(made, f"{made}.idx", len(index))], NORMALISED)])

    every = written.select("archive").distinct().select(
        "archive", *[F.lit(None).cast(k).alias(c) for c, k in (
            ("number", "bigint"), ("head_page", "bigint"), ("head_archive", "string"),
            ("head_number", "bigint"))]
    )
    dealt = every.unionByName(turned).repartition(_tasks(every.count()), "archive")
    files = dealt.groupBy("archive").applyInArrow(run, _ddl(NORMALISED))
    return settled(files, "warc-normalised")


def _tasks(archives: int) -> int:
    """A task per archive, however few rows name it, up to a number Spark deals with easily."""
    return max(1, min(archives, MOST_TASKS))


def _revisit_fields(row: dict) -> dict[str, str]:
    fields = {"WARC-Refers-To": f"<{record_id(row['head_archive'], row['head_number'])}>"}
    if row["head_page"] is not None:
        fields["X-Refers-To-Page-Id"] = str(row["head_page"])
    return fields


# --- reading -----------------------------------------------------------------------------------


def read_member(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of the record in one gzip member."""
    inflater = zlib.decompressobj(GZIP)
    try:
        found = inflater.decompress(data)
    except zlib.error as error:
        raise DamagedArchive(str(error)) from error
    if not inflater.eof or inflater.unused_data:
        raise DamagedArchive("an index entry does not hold exactly one member")
    head, _, rest = found.partition(b"\r\n\r\n")
    fields = parse_head(head)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise DamagedArchive("a block does not have its Content-Length")
    return fields, rest[:size]


def _row(fields: dict[str, str], block: bytes) -> tuple:
    """A row of READ; a response's payload must have the digest and length it names."""
    number = lambda name: int(fields[name]) if name in fields else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    reply, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?m)^Content-Length: (\d+)", reply)[1])
    if fields["WARC-Type"] == "response" and (
        payload_digest(payload) != digest or len(payload) != size
    ):
        raise DamagedArchive(f"the payload of {fields['WARC-Record-ID']} is not the one written")
    return (
        number("X-Page-Id"), uri_of(fields), size, digest, fields["WARC-Type"],
        number("X-Refers-To-Page-Id"), fields["WARC-Record-ID"].strip("<>"),
    )


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    record_id.

    ``archives`` has archive and sidecar. Members are found by the sidecar's offsets and
    inflated one by one; digests and lengths of responses are checked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, sidecar in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with _reading(f"{folder}/{sidecar}") as source:
                    index = [json.loads(line) for line in source.read().splitlines()]
                with _reading(f"{folder}/{archive}") as source:
                    for at in range(0, len(index), 1024):
                        rows = []
                        for entry in index[at : at + 1024]:
                            source.seek(entry["offset"])
                            rows.append(_row(*read_member(source.read(entry["length"]))))
                        yield _batch(rows, READ)

    dealt = archives.select("archive", "sidecar").repartition(_tasks(archives.count()), "archive")
    return dealt.mapInArrow(run, _ddl(READ))


def archive_pages(
    pages: DataFrame,
    least_shared: int = LEAST_SHARED,
    archive_bytes: int = ARCHIVE_BYTES,
    archive_records: int = ARCHIVE_RECORDS,
    folder: str | None = None,
) -> tuple[DataFrame, str]:
    """Pages as archives with one gzip member per record; (archive, sidecar, records) and folder.

    Every row is written as a response into whole-file gzip archives. These are then normalised:
    inflated once as a stream, each record written as a member of its own, with a sidecar index
    of offsets. Records that repeat a payload of at least ``least_shared`` bytes become revisits
    on the way. Files lie under ``folder`` (default: the shared scratch folder) and carry the
    task attempt in their names, so a lost executor's half-written files are never read.
    """
    home = folder or f"{scratch_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    written = write_archives(pages, f"{home}/whole", archive_bytes, archive_records)
    made = normalise(written, revisits(written, least_shared), f"{home}/whole", f"{home}/members")
    return made, f"{home}/members"


def archived(pages: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """Per row of ``pages``: page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    record_id, as read back from the archives that ``archive_pages`` writes.

    A null html is an empty payload, a null url or page_id is left out of its record and comes
    back null. Of rows with equal payloads the one with the smallest page_id is the response,
    the others revisit it; a null page_id comes last, and of rows that repeat a page_id the one
    written first is the response. refers_to is null when the response has no page_id. No rows
    give no archives and no rows. Other columns are not read.
    """
    made, folder = archive_pages(pages, least_shared)
    return read_archives(made, folder)


def op12(spark: SparkSession, folder: str) -> DataFrame:
    # The record id depends on the archive a row happened to be written to.
    return archived(table(spark, folder, "pages")).drop("record_id")


ORACLE = """
with digests as (
  select page_id, url, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as hex from pages
),
-- Five hexadecimal digits are four letters of base 32.
letters as (
  select page_id, url, n, hex, list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + (
      (cast(concat('0x', substr(hex, cast(1 + 5 * (i // 4) as int), 5)) as int)
       >> cast(5 * (3 - i % 4) as int)) & 31) as int), 1)), 'string_agg', '') as digest
  from digests
),
firsts as (select hex, min(page_id) as first from digests group by hex)
select l.page_id, l.url, cast(n as bigint) as payload_bytes, digest as payload_digest,
       case when l.page_id = first then 'response' else 'revisit' end as record_type,
       case when l.page_id = first then null else first end as refers_to
from letters l join firsts using (hex)
"""
