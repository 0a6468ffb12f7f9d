"""WARC records in ZIP packages: written by tasks, read back by byte ranges.

A package is a ZIP file with stored members only: `archive/data.warc.gz`, every record compressed for itself, and
`indexes/index.cdxj`, a line of JSON for each record with its place in the member. The reader parses the end record, the
ZIP64 records and the central directory, finds where the members' bytes lie in the package, reads the index, and fetches
records by ranges of the package, neighbours together up to `WINDOW` bytes; nothing is extracted.

Packages lie in the shared folder. A task writes under a new name, and only the names that successful tasks report, in a
manifest written once, are read: a lost executor leaves at most an unread file.

Of records with equal payloads of at least `min_bytes` bytes, the one with the largest id is a response, the others are
revisits that refer to it. The winners are counted with map-side partial sums; only digests with several records are
joined, by broadcast if they are few.

Defined results: a null payload is empty; a null address gives a record without one; a null id is written as an
empty name, read back as null, and loses to any other id; rows with the same id and payload as the response are
responses too; an empty table gives an empty result; only the three columns named are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidframe.llm.common import empty_text, has_columns, looked_up, materialize, scratch_path
from lucidframe.shipping import ship

#: A task starts a new package beyond this many bytes; neighbouring records are fetched together up to WINDOW bytes.
PACKAGE, WINDOW = 64 << 20, 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and plain path of a folder named like spark.checkpoint.dir: an address, or a local path."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


# Records


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32_sha1(text: Column) -> Column:
    """The same digest as a column: five hex digits are twenty bits, four base32 digits."""
    hexed = F.sha1(text)
    fours = [F.lpad(F.conv(F.substring(hexed, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*fours), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if is_revisit else head + payload
    name = "" if page_id is None else page_id
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if is_revisit:
        fields += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"WARC-Profile: {PROFILE}"]
    fields += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


# Packages


class PackageWriter:
    """A package on any output stream; records are added one by one, the index is kept until the end."""

    def __init__(self, sink):
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA, (2000, 1, 1, 0, 0, 0)), "w", force_zip64=True)
        self.index: list[str] = []
        self.at = 0

    def add(self, raw: bytes, key: str, digest: str) -> None:
        packed = gzip.compress(raw, 4, mtime=0)
        self.member.write(packed)
        self.index.append(f"{key} {json.dumps({'digest': digest, 'offset': self.at, 'length': len(packed), 'filename': DATA})}")
        self.at += len(packed)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX, (2000, 1, 1, 0, 0, 0)), "\n".join(self.index).encode())
        self.zip.close()


class PackageReader:
    """Members of a ZIP file by ranges: `fetch(start, length)` and the file's size are all it needs."""

    def __init__(self, fetch, size: int):
        self.fetch, self.size = fetch, size
        self.members = self._directory()

    def _directory(self) -> dict[str, tuple[int, int, int]]:
        """name -> (offset of the local header, length, method) from the central directory."""
        tail_at = max(0, self.size - 65_557)  # the end record with its longest comment
        tail = self.fetch(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end record: not a ZIP file")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            locator_at = tail_at + end - 20
            locator = self.fetch(locator_at, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            big = self.fetch(struct.unpack_from("<Q", locator, 8)[0], 56)
            if big[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            count, length, start = struct.unpack_from("<QQQ", big, 32)
        raw, at, found = self.fetch(start, length), 0, {}
        for _ in range(count):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, packed, plain = struct.unpack_from("<H", raw, at + 10)[0], *struct.unpack_from("<II", raw, at + 20)
            n_name, n_extra, n_comment = struct.unpack_from("<HHH", raw, at + 28)
            offset = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + n_name].decode()
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            e = 0
            while e + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, e)
                if kind == 1:  # the ZIP64 field holds, in this order, only what is full in the entry
                    big = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                    plain = next(big) if plain == 0xFFFFFFFF else plain
                    packed = next(big) if packed == 0xFFFFFFFF else packed
                    offset = next(big) if offset == 0xFFFFFFFF else offset
                e += 4 + n
            found[name] = (offset, packed, method)
            at += 46 + n_name + n_extra + n_comment
        return found

    def locate(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes lie in the package."""
        offset, length, method = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is not stored")
        head = self.fetch(offset, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return offset + 30 + n_name + n_extra, length

    def entries(self) -> list[tuple[int, int]]:
        """(offset in the package, length) of every record, from the index, in the package's order."""
        start, length = self.locate(INDEX)
        base = {}
        out = []
        for line in self.fetch(start, length).decode().splitlines():
            x = json.loads(line[line.index(" {") + 1 :])
            if x["filename"] not in base:
                base[x["filename"]] = self.locate(x["filename"])[0]
            out.append((base[x["filename"]] + x["offset"], x["length"]))
        return sorted(out)

    def records(self) -> Iterator[bytes]:
        """Every record, uncompressed, fetched in ranges of neighbours."""
        group: list[tuple[int, int]] = []
        for e in [*self.entries(), None]:
            if group and (e is None or e[0] != group[-1][0] + group[-1][1] or e[0] + e[1] - group[0][0] > WINDOW):
                start = group[0][0]
                raw = self.fetch(start, group[-1][0] + group[-1][1] - start)
                for at, n in group:
                    yield zlib.decompress(raw[at - start : at - start + n], 31)
                group = []
            if e:
                group.append(e)


# Frames


def _typed(df: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """page_id, url, payload, digest, refers_to and revisit of each row."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), empty_text(F.col(f"`{payload_col}`")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    big = F.octet_length("payload") >= min_bytes
    rows = rows.withColumn("several", F.when(big, F.col("digest")))
    several = rows.where(big).groupBy("several").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = looked_up(rows, materialize(several, "payload-winners"), ["several"], "n")
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("keep")).alias("refers_to"), revisit.alias("revisit"))


def write_packages(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the packages; a manifest of (path, records, bytes), itself written once."""
    has_columns(df, id_col, url_col, payload_col)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        writer = None

        def finish() -> pa.RecordBatch:
            writer.close()
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(writer.index)], pa.int64()), pa.array([writer.at], pa.int64())], ["path", "records", "bytes"])

        for batch in batches:
            for i in range(batch.num_rows):
                if writer is None:
                    path = f"{folder}/{uuid.uuid4().hex}.zip"
                    sink = store.open_output_stream(f"{base}/{path.rsplit('/', 1)[1]}")
                    writer = PackageWriter(sink)
                page_id, url, payload, digest, refers_to, revisit = (batch.column(k)[i].as_py() for k in range(6))
                raw = record(page_id, url, payload.encode(), digest, refers_to, revisit)
                writer.add(raw, f"{'-' if page_id is None else page_id} {DATE}", digest)
                if writer.at >= PACKAGE:
                    yield finish()
                    writer = None
        if writer is not None:
            yield finish()

    rows = _typed(df, id_col, url_col, payload_col, min_bytes)
    return materialize(rows.mapInArrow(run, "path string, records bigint, bytes bigint"), "manifest")


def read_packages(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of all packages: page_id, payload_bytes, payload_digest, record_type, refers_to, url and, if asked for, the payload."""
    extra = ", payload binary" if with_payload else ""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * with_payload

    def number(name: str | None) -> int | None:
        digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def read(raw: bytes) -> tuple:
        fields, http, payload = parse_record(raw)
        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
        if kind == "response" and (payload_digest(payload) != digest or len(payload) != int(http["Content-Length"])):
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
        row = (number(fields["WARC-Record-ID"]), int(http["Content-Length"]), digest, kind, number(fields.get("WARC-Refers-To")), fields.get("WARC-Target-URI"))
        return row + (payload,) * with_payload

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths in batches:
            for path in paths.column(0).to_pylist():
                store, plain = filesystem(path)
                with store.open_input_file(plain) as file:
                    rows, held = [], 0
                    for raw in PackageReader(lambda at, n: file.read_at(n, at), file.size()).records():
                        rows.append(read(raw))
                        held += len(raw)
                        if len(rows) >= 4096 or held > WINDOW:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    packages = max(1, manifest.count())
    schema = f"page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string{extra}"
    return manifest.select("path").repartition(packages).mapInArrow(run, schema)


def round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write all rows as packages in the shared folder and read them back."""
    folder = scratch_path(df.sparkSession, "packages")
    return read_packages(write_packages(df, folder, id_col, url_col, payload_col, min_bytes))
