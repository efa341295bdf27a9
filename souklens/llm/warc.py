"""WARC records in ZIP packages, read back by byte ranges.

Each archive is a ZIP file of stored members: ``archive/data.warc`` with the records and
``indexes/index.cdxj`` with a JSON line for each (offset and length inside the first member). The reader
looks for the end-of-directory record in the file's tail, follows a ZIP64 locator if there is one, parses
the central directory, reads the index member and then the records by ranges; nothing is extracted.

Equal payloads are found by their SHA-1. Of those with ``least`` bytes or more, the record with the
largest id is a response and the others revisit it. Rows with equal id and payload are alike: both are
responses if theirs is the largest id. A payload that only rows without id have gives responses. NULL is
an empty payload, a NULL url is left out of the record.

Archives are closed at ``ARCHIVE_BYTES``, carry a new name for each task attempt and count only if the
list of archives, written to the shared folder, names them. Tasks open them through pyarrow's file systems.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from souklens.llm.common import new_name, quoted, slices, store
from souklens.session import new_path

ARCHIVE_BYTES = 64 << 20
READ_BYTES = 4 << 20
RECORDS, INDEX = "archive/data.warc", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a location with or without a scheme."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit without the payload; both state its digest and length."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~ ")))
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(body))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record. The digest of a response is checked against its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    if not lines[0].startswith("WARC/") or len(rest) != int(fields["Content-Length"]) + 4:
        raise ValueError("not a complete WARC record")
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    length = next(int(h.split(b":")[1]) for h in http.split(b"\r\n") if h.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None, "payload_bytes": length,
            "payload_digest": digest, "record_type": kind, "refers_to": number("WARC-Refers-To")}


@dataclass(frozen=True)
class Member:
    """A stored member: where its data begins and how long it is."""

    name: str
    begin: int
    size: int


def read_range(file: pa.NativeFile, begin: int, size: int) -> bytes:
    file.seek(begin)
    data = file.read(size)
    if len(data) != size:
        raise EOFError("the archive is shorter than its directory says")
    return data


def directory(file: pa.NativeFile) -> dict[str, Member]:
    """Stored members of a ZIP file, from its (ZIP64) central directory."""
    size = file.size()
    tail = read_range(file, max(0, size - 65557), min(size, 65557))
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of a ZIP directory")
    count, length, begin = struct.unpack("<HII", tail[at + 10:at + 20])
    if at >= 20 and tail[at - 20:at - 16] == b"PK\x06\x07":
        where = struct.unpack("<Q", tail[at - 12:at - 4])[0]
        end = read_range(file, where, 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 directory where its locator points")
        count, length, begin = struct.unpack("<QQQ", end[32:56])
    data, members, i = read_range(file, begin, length), {}, 0
    for _ in range(count):
        if data[i:i + 4] != b"PK\x01\x02":
            raise ValueError("broken ZIP directory")
        method, = struct.unpack("<H", data[i + 10:i + 12])
        packed, unpacked, name_size, extra_size, comment = struct.unpack("<IIHHH", data[i + 20:i + 34])
        offset, = struct.unpack("<I", data[i + 42:i + 46])
        name = data[i + 46:i + 46 + name_size].decode()
        extra, values = data[i + 46 + name_size:i + 46 + name_size + extra_size], {}
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            values[kind], extra = extra[4:4 + n], extra[4 + n:]
        wide = iter(struct.unpack(f"<{len(values.get(1, b'')) // 8}Q", values.get(1, b"")[:len(values.get(1, b"")) // 8 * 8]))
        unpacked, packed, offset = [next(wide) if v == 0xFFFFFFFF else v for v in (unpacked, packed, offset)]
        if method == 0:
            local = read_range(file, offset, 30)
            members[name] = Member(name, offset + 30 + sum(struct.unpack("<HH", local[26:30])), packed)
        i += 46 + name_size + extra_size + comment
    return members


class Package:
    """One archive that is being written."""

    def __init__(self, folder: str):
        system, path = open_system(folder)
        system.create_dir(path, recursive=True)
        name = new_name("pages") + ".wacz"
        self.path, self.file = f"{folder}/{name}", system.open_output_stream(f"{path}/{name}")
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(RECORDS, "w", force_zip64=True)
        self.size, self.index = 0, []

    def add(self, page: int | None, data: bytes) -> None:
        self.index.append(json.dumps({"page": page, "offset": self.size, "length": len(data)}))
        self.member.write(data)
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(INDEX, "\n".join(self.index))
        self.zip.close()
        self.file.close()
        return self.path, len(self.index), self.size


def with_targets(pages: DataFrame, key: str, url: str, html: str, least: int) -> DataFrame:
    """``page``, ``url``, ``payload`` and ``refers_to`` (NULL for a response) of every row."""
    rows = pages.select(quoted(key).cast("long").alias("page"), quoted(url).cast("string").alias("url"),
                        F.encode(F.coalesce(quoted(html).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # reduced in each task before the shuffle; the written table lets adaptive execution split a hot digest
    groups = store(rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page").alias("target"), F.count("*").alias("n"))
                   .where("n > 1").select("digest", "target"), "warc-targets")
    joined = rows.join(groups, "digest", "left")
    other = F.col("page").isNull() | (F.col("page") != F.col("target"))
    return joined.select("page", "url", "payload", F.when(F.col("target").isNotNull() & other, F.col("target")).alias("refers_to"))


def write_archives(
    pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0,
    date: str = "1970-01-01T00:00:00Z", most_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record for each row; returns the list of archives (``path``, ``records``, ``bytes``)."""
    folder = folder or new_path(pages.sparkSession, "warc")
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])

    def run(batches):
        package, done = None, []
        for batch in batches:
            for part in slices(batch, 2):
                for page, url_, payload, refers in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    package = package or Package(folder)
                    package.add(page, record(page, url_, payload, refers, date))
                    if package.size >= most_bytes:
                        done.append(package.close())
                        package = None
        if package:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], schema.names)

    return store(with_targets(pages, key, url, html, least).mapInArrow(run, schema), "warc-list")


def read_package(path: str) -> Iterator[list[dict]]:
    """Records of an archive, a bounded run of adjacent ones at a time."""
    system, inner = open_system(path)
    with system.open_input_file(inner) as file:
        members = directory(file)
        begin = members[RECORDS].begin
        index = [json.loads(x) for x in read_range(file, members[INDEX].begin, members[INDEX].size).decode().split("\n") if x]
        run: list[dict] = []
        for i, entry in enumerate(index):
            run.append(entry)
            size = entry["offset"] + entry["length"] - run[0]["offset"]
            if size >= READ_BYTES or i + 1 == len(index):
                data = read_range(file, begin + run[0]["offset"], size)
                yield [parse(data[(at := e["offset"] - run[0]["offset"]):at + e["length"]]) for e in run]
                run = []


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """A row for each record of the archives named by ``path``, each response checked against its digest."""
    kinds = {"page_id": (T.LongType(), pa.int64()), "url": (T.StringType(), pa.string()), "payload": (T.BinaryType(), pa.binary()),
             "payload_bytes": (T.LongType(), pa.int64()), "payload_digest": (T.StringType(), pa.string()),
             "record_type": (T.StringType(), pa.string()), "refers_to": (T.LongType(), pa.int64())}
    if not payload:
        del kinds["payload"]

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for found in read_package(path):
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], k) for n, (_, k) in kinds.items()], list(kinds))

    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number is not merged, however short the list
    return archives.select("path").repartition(tasks, "path").mapInArrow(run, T.StructType([T.StructField(n, t) for n, (t, _) in kinds.items()]))
