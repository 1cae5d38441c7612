"""WARC archives as a Spark data source, written and read.

`spark.read.format("warc")` gives one row a record.  Reading plans its partitions
by file: small files share one, so that each holds about the same number of
bytes.  Equality and IN tests on `warc_type` and on the other header columns are
pushed down.  A task parses a record's headers first; if they fail the tests, or
the payload is not wanted (option payload=false), the payload is neither
decompressed nor decoded.

Archives are written with one gzip member a record.  The member's header carries
an extra field `sl`: its own length compressed and uncompressed.  So a reader
inflates only the start of a member, which holds the WARC headers, and steps over
the rest.  Members without that field are inflated to find their end, but their
payload is not kept.  Files that are not compressed are stepped through by
Content-Length.

Writing: each task writes files of its own name; commit puts the names of those
of the tasks that succeeded into a list beside them, and readers of the folder
read what lists name.  A folder without lists is read whole.

Header values that hold line breaks or other control characters are written with
these percent-encoded.  A null payload is an empty one; null headers are left out.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from stowage.llm.common import fresh_folder, prepared, text_of
from stowage.llm.files import names, open_folder

#: Header of each column that is text.
HEADERS = {
    "warc_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "profile": "WARC-Profile",
    "content_type": "Content-Type",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", content_length long, file string, offset long, payload binary"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a planned partition, and of the first piece that is inflated of a member.
PARTITION_BYTES, FIRST_PIECE = 64 << 20, 4096
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
_MEMBER = struct.Struct("<HBBIBBH2sHII")  # gzip header with the extra field `sl`


def _clean(value: str) -> str:
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(row: dict) -> bytes:
    """A record: version, headers, an empty line, the block and two empty lines."""
    payload = bytes(row.get("payload") or b"")
    lines = ["WARC/1.1"]
    lines += [f"{header}: {_clean(row[c])}" for c, header in HEADERS.items() if row.get(c) is not None]
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that says how long it is."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = _MEMBER.size + len(body) + 8
    head = _MEMBER.pack(0x8B1F, 8, 4, 0, 0, 255, 12, b"sl", 8, size, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_headers(head: bytes) -> dict[str, str]:
    """Header names in lower case and their values."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    found: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:  # a folded line
            found[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            found[last] = value.strip()
    return found


class _Plain:
    """Records of a file that is not compressed."""

    def __init__(self, file):
        self.file = file

    def records(self) -> Iterator[tuple[int, dict[str, str], object]]:
        offset = 0
        while True:
            self.file.seek(offset)
            head = b""
            while b"\r\n\r\n" not in head:
                more = self.file.read(FIRST_PIECE)
                if not more:
                    if head.strip():
                        raise ValueError("a record ends within its headers")
                    return
                head = head.lstrip(b"\r\n") if not head else head
                head += more
            lead = len(head) - len(head.lstrip(b"\r\n"))
            cut = head.index(b"\r\n\r\n")
            headers = parse_headers(head[lead:cut])
            start, length = offset + cut + 4, int(headers.get("content-length", 0))

            def payload(start=start, length=length) -> bytes:
                self.file.seek(start)
                return self.file.read(length)

            yield offset, headers, payload
            offset = start + length + 4


class _Members:
    """Records of a file with one gzip member each."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def records(self) -> Iterator[tuple[int, dict[str, str], object]]:
        offset = 0
        while offset < self.size:
            self.file.seek(offset)
            raw = self.file.read(FIRST_PIECE)
            length = self._length(raw)
            inflate = zlib.decompressobj(31)
            head = inflate.decompress(raw[:length] if length else raw, FIRST_PIECE)
            while b"\r\n\r\n" not in head:
                more = inflate.unconsumed_tail or self.file.read(FIRST_PIECE)
                if not more or inflate.eof:
                    raise ValueError("a member ends within its headers")
                head += inflate.decompress(more, FIRST_PIECE)
            cut = head.index(b"\r\n\r\n")
            headers = parse_headers(head[:cut])
            end = [offset + length if length else None]

            def payload(inflate=inflate, rest=head[cut + 4 :], at=self.file.tell(), end=end, keep=True) -> bytes:
                wanted = int(headers.get("content-length", 0))
                self.file.seek(at)
                parts, have = [rest], len(rest)
                more = inflate.unconsumed_tail
                while not inflate.eof:
                    piece = inflate.decompress(more or self.file.read(1 << 16), 1 << 20)
                    more = inflate.unconsumed_tail
                    if keep and have < wanted:
                        parts.append(piece)
                        have += len(piece)
                    if not piece and not more and not inflate.eof and self.file.tell() >= self.size:
                        raise ValueError("a member ends early")
                if end[0] is None:
                    end[0] = self.file.tell() - len(inflate.unused_data)
                return b"".join(parts)[:wanted]

            yield offset, headers, payload
            if end[0] is None:
                payload(keep=False)
            offset = end[0]

    @staticmethod
    def _length(raw: bytes) -> int | None:
        """What the field `sl` of a member says."""
        if raw[:3] != b"\x1f\x8b\x08":
            raise ValueError("not a gzip member")
        if not raw[3] & 4:
            return None
        (size,) = struct.unpack_from("<H", raw, 10)
        at, stop = 12, 12 + size
        while at + 4 <= stop:
            (length,) = struct.unpack_from("<H", raw, at + 2)
            if raw[at : at + 2] == b"sl":
                return struct.unpack_from("<I", raw, at + 4)[0]
            at += 4 + length
        return None


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]

    def __post_init__(self):
        super().__init__(0)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        #: Headers that must be there, and the values of those that must have one of some.
        self.present: list[str] = []
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        """Take tests of one header column against values; leave the rest to Spark."""
        for test in filters:
            column = test.attribute[0] if len(getattr(test, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(test, IsNotNull):
                self.present.append(HEADERS[column].lower())
            elif column in HEADERS and isinstance(test, EqualTo) and isinstance(test.value, str):
                self.tests.append((HEADERS[column].lower(), (test.value,)))
            elif column in HEADERS and isinstance(test, In) and all(isinstance(v, str) for v in test.value):
                self.tests.append((HEADERS[column].lower(), tuple(test.value)))
            else:
                yield test

    def partitions(self):
        found = [f for f in names(self.folder, ".warc.gz") + names(self.folder, ".warc")]
        store, path = open_folder(self.folder)
        lists = names(self.folder, ".committed")
        if lists:
            known = set()
            for name, _ in lists:
                with store.open_input_stream(f"{path}/{name}") as file:
                    known.update(json.loads(file.read()))
            found = [f for f in found if f[0] in known]
        planned, held = [[]], 0
        for name, size in found:
            if planned[-1] and held + size > self.bytes:
                planned.append([])
                held = 0
            planned[-1].append((name, size))
            held += size
        return [Files(files) for files in planned]

    def read(self, partition: Files):
        store, path = open_folder(self.folder)
        columns = [h.lower() for h in HEADERS.values()]
        for name, size in partition.files:
            with store.open_input_file(f"{path}/{name}") as file:
                records = _Members(file, size) if name.endswith(".gz") else _Plain(file)
                for offset, headers, payload in records.records():
                    if all(header in headers for header in self.present) and all(
                        headers.get(header) in values for header, values in self.tests
                    ):
                        yield (
                            *(headers.get(c) for c in columns),
                            int(headers.get("content-length", 0)),
                            name,
                            offset,
                            payload() if self.payload else None,
                        )


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType):
        self.folder, self.columns = options["path"], schema.names
        self.compressed = options.get("compression", "gzip") == "gzip"

    def write(self, iterator) -> Written:
        store, path = open_folder(self.folder)
        store.create_dir(path, recursive=True)
        out, written = None, []
        try:
            for row in iterator:
                if out is None:
                    written.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.compressed)
                    out = store.open_output_stream(f"{path}/{written[-1]}", compression=None, buffer_size=1 << 20)
                data = record_bytes(dict(zip(self.columns, row, strict=True)))
                out.write(member(data) if self.compressed else data)
        finally:
            if out is not None:
                out.close()
        return Written(written)

    def commit(self, messages) -> None:
        """One list for the whole write; a name for each file that a task kept."""
        store, path = open_folder(self.folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{uuid.uuid4().hex}.committed") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages) -> None:
        """Files of a failed write are named in no list."""


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options, schema)


def with_warc(spark: SparkSession) -> SparkSession:
    """Make the format known to the session, with filters pushed into it."""
    prepared(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark


#: Smallest payload that a later record may refer to.
LEAST_REVISIT = 1000


def captures(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", text_col: str = "html") -> DataFrame:
    """Records to write, one a page.

    Of pages with equal payloads of LEAST_REVISIT bytes or more the one with the
    largest id is the response, others revisit it without a payload of their own.
    Who revisits whom is decided on ids and digests; payloads travel once.  Pages
    without an id never are what others refer to, unless the payload has no other
    page.  Rows that share id and payload are one page: all are of one type.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{uri_col}`").cast("string").alias("target_uri"),
        text_of(F.col(f"`{text_col}`")).cast("binary").alias("payload"),
    )
    narrow = rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("bytes"))
    newest = (
        narrow.filter(F.col("bytes") >= LEAST_REVISIT)
        .groupBy("digest")
        .agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    revisits = (
        narrow.join(newest, "digest")
        .filter(~F.col("page_id").eqNullSafe(F.col("newest")))
        .select(F.struct("page_id", "digest").alias("key"), "newest")
        .distinct()
    )
    keyed = rows.withColumn("digest", F.sha1("payload")).withColumn("key", F.struct("page_id", "digest"))
    again = F.col("newest").isNotNull()
    return keyed.join(revisits, "key", "left").select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"),
        F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")).alias("record_id"),
        "target_uri",
        F.lit("2024-01-01T00:00:00Z").alias("warc_date"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.when(again, F.concat(F.lit("<urn:page:"), F.col("newest").cast("string"), F.lit(">"))).alias("refers_to"),
        F.when(again, REVISIT_PROFILE).alias("profile"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def page_number(column: str) -> F.Column:
    """The page id within a record id; null if it has none."""
    return F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def resolved(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of a folder.

    Digest and length of a response are taken from its payload as read; the
    digest in its header must agree.  Those of a revisit are its response's.
    """
    archive = with_warc(spark).read.format("warc")
    response = (
        archive.load(folder)
        .filter(F.col("warc_type") == "response")
        .select(
            page_number("record_id").alias("page_id"),
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.sha1("payload").alias("payload_digest"),
            F.col("payload_digest").alias("stated"),
        )
    )
    sound = F.when(F.concat(F.lit("sha1:"), "payload_digest") == F.col("stated"), F.col("payload_digest")).otherwise(
        F.raise_error(F.lit("a payload is not what its digest says"))
    )
    response = response.withColumn("payload_digest", sound).drop("stated")
    revisit = (
        archive.option("payload", "false")
        .load(folder)
        .filter(F.col("warc_type") == "revisit")
        .select(
            page_number("record_id").alias("page_id"),
            page_number("refers_to").alias("refers_to"),
            F.substring("payload_digest", 6, 40).alias("payload_digest"),
        )
    )
    known = response.filter(F.col("payload_bytes") >= LEAST_REVISIT).select(
        F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes"
    ).distinct()
    return response.select(
        "page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")
    ).union(
        revisit.join(known, ["refers_to", "payload_digest"]).select(
            "page_id", "payload_bytes", "payload_digest", F.lit("revisit"), "refers_to"
        )
    )


def archive(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", text_col: str = "html") -> DataFrame:
    """Write a record a page to a new shared folder and read the archives back."""
    spark = with_warc(pages.sparkSession)
    folder = fresh_folder(spark, "warc")
    captures(pages, id_col, uri_col, text_col).write.format("warc").mode("append").save(folder)
    return resolved(spark, folder)
