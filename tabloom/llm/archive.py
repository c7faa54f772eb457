"""Web archives packed in ZIP files: written by tasks, found through their directories, read by ranges.

A package holds stored (never compressed) members: ``archive/data.warc.gz``,
one gzip member a record, and ``indexes/index.cdxj``, a line a record with its
place. The reader parses the end record, the ZIP64 records and the central
directory itself, takes the index, and reads records at their places, without
unpacking anything.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.joins import is_small
from tabloom.session import checkpoint, shared_dir

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
LEAST = 1_000  # bytes from which an equal payload is not stored again
LARGEST = 256 << 20  # bytes of records in a package
RANGE = 4 << 20  # bytes read at once
READERS = 64  # tasks that read packages, at least
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"

LOCATION = T.StructType([T.StructField("path", T.StringType()), T.StructField("start", T.LongType()),
                         T.StructField("sizes", T.ArrayType(T.LongType()))])
RECORD = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("payload", T.BinaryType())])


def with_originals(pages: DataFrame, page_id: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(page_id, url, payload, digest, original): the largest id of rows with an equal payload of LEAST bytes or more.

    Equality is that of SHA-1 and length. The ids are reduced before rows meet,
    and only digests that occur twice are kept, so a payload with many copies
    is one row of the smaller side.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    least = rows.filter(F.col("size") >= LEAST)
    equal = least.groupBy("digest", "size").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    equal = checkpoint(equal.filter("n > 1").select(F.col("digest").alias("d"), F.col("size").alias("s"), "original"))
    same = (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s"))
    if is_small(equal):  # by rows and bytes; then no payload is shuffled
        return rows.join(F.broadcast(equal), same, "left").drop("d", "s")
    # rows too small to have an original stay where they are
    met = rows.filter(F.col("size") >= LEAST).join(equal, same, "left").drop("d", "s")
    return met.unionByName(rows.filter(F.col("size") < LEAST).withColumn("original", F.lit(None).cast("long")))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None) -> bytes:
    """One WARC record: a response with the payload, or a revisit that names the response."""
    revisit = original is not None and original != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    code = base64.b32encode(bytes.fromhex(digest)).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{id_text(page_id)}>",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
            f"WARC-Payload-Digest: sha1:{code}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}"]
    if url is None:
        head.remove("WARC-Target-URI: ")
    if revisit:
        head[5:5] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                     f"WARC-Refers-To: <urn:page:{original}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def id_text(page_id: int | None) -> str:
    return "" if page_id is None else str(page_id)


def parse_record(raw: bytes) -> dict:
    """The fields of a record; a revisit's size is that which its HTTP header states."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not hold the payload that it states")

    def number(name):
        text = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    from urllib.parse import unquote
    return {"page_id": number("WARC-Record-ID"), "url": unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields
            else None, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"),
            "payload_bytes": size, "payload_digest": digest, "payload": None if revisit else payload}


class PackageWriter:
    """One package, streamed: the data member first, then the index of where its records lie."""

    def __init__(self, out, level: int = LEVEL):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.at, self.level, self.lines = 0, level, []

    def add(self, key: str, raw: bytes) -> None:
        pack = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        packed = pack.compress(raw) + pack.flush()
        self.data.write(packed)
        self.lines.append(f"{key} {json.dumps({'offset': self.at, 'length': len(packed)})}\n")
        self.at += len(packed)

    def close(self) -> None:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            f.write("".join(self.lines).encode())
        self.zip.close()


def members(source, size: int) -> dict[str, tuple[int, int]]:
    """(first byte, length) of each stored member, from the directories at the package's end."""
    def read(at, n):
        source.seek(at)
        return source.read(n)

    tail_at = max(0, size - 65_557)  # an end record and the longest comment
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10:end + 20])
    locator = tail[max(0, end - 20):end]
    if locator[:4] == b"PK\6\7":
        record = read(struct.unpack("<Q", locator[8:16])[0], 56)
        if record[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", record[32:56])
    directory, out, at = read(start, length), {}, 0
    for _ in range(count):
        if directory[at:at + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method, = struct.unpack("<H", directory[at + 10:at + 12])
        packed, full, n_name, n_extra, n_comment = struct.unpack("<IIHHH", directory[at + 20:at + 34])
        offset, = struct.unpack("<I", directory[at + 42:at + 46])
        name = directory[at + 46:at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name:at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # the 64-bit values of those fields that are full, in this order
                values = list(struct.unpack(f"<{n // 8}Q", extra[4:4 + n // 8 * 8]))
                full = values.pop(0) if full == 0xFFFFFFFF else full
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                offset = values.pop(0) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + n:]
        if method == 0:
            local = read(offset, 30)
            if local[:4] != b"PK\3\4":
                raise ValueError("broken local header")
            skip_name, skip_extra = struct.unpack("<HH", local[26:30])
            out[name] = (offset + 30 + skip_name + skip_extra, full)
        at += 46 + n_name + n_extra + n_comment
    return out


def locations(source, size: int) -> Iterator[tuple[int, list[int]]]:
    """(first byte in the package, sizes of the records that follow it): ranges of about RANGE bytes, from the index."""
    found = members(source, size)
    base = found[DATA][0]
    source.seek(found[INDEX][0])
    start, sizes, held = None, [], 0
    for line in io.BytesIO(source.read(found[INDEX][1])):
        place = json.loads(line.split(b" ", 1)[1])
        if sizes and (held >= RANGE or base + place["offset"] != start + held):
            yield start, sizes
            start, sizes, held = None, [], 0
        if start is None:
            start = base + place["offset"]
        sizes.append(place["length"])
        held += place["length"]
    if sizes:
        yield start, sizes


def opened(path: str):
    return pafs.FileSystem.from_uri(path)


def write_packages(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of ``with_originals`` as packages under ``folder`` and returns their paths.

    A task's packages have names of their own, so a second attempt never meets
    the first one's files, and only the paths of attempts that ended are returned.
    """
    def run(batches):
        store, root = opened(folder)
        writer, out, path, paths = None, None, None, []

        def close():
            writer.close()
            out.close()
            paths.append(path)

        for batch in batches:
            for r in batch.to_pylist():
                if writer is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    store.create_dir(root, recursive=True)
                    path, out = f"{folder}/{name}", store.open_output_stream(f"{root}/{name}")
                    writer = PackageWriter(out)
                writer.add(id_text(r["page_id"]) or "-", record_bytes(
                    r["page_id"], r["url"], r["payload"], r["digest"], r["original"]))
                if writer.at >= LARGEST:
                    close()
                    writer = None
        if writer is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return checkpoint(rows.mapInArrow(run, "path string"))


def read_packages(paths: DataFrame) -> DataFrame:
    """The records of packages (column path): located through directories and indexes, then read range by range."""
    def locate(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = opened(path)
                size = store.get_file_info(inner).size
                with store.open_input_file(inner) as f:
                    for start, sizes in locations(f, size):
                        yield pa.RecordBatch.from_pylist([{"path": path, "start": start, "sizes": sizes}], schema=pa.schema(
                            [("path", pa.string()), ("start", pa.int64()), ("sizes", pa.list_(pa.int64()))]))

    def read(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(RECORD)
        for batch in batches:
            for place in batch.to_pylist():
                store, inner = opened(place["path"])
                with store.open_input_file(inner) as f:
                    f.seek(place["start"])
                    raw = f.read(sum(place["sizes"]))
                at, rows, held = 0, [], 0
                for n in place["sizes"]:
                    rows.append(parse_record(zlib.decompress(raw[at:at + n], 31)))
                    at, held = at + n, held + rows[-1]["payload_bytes"]
                    if held >= RANGE:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    places = paths.mapInArrow(locate, LOCATION)
    # with a number, so that adaptive execution does not join the few small rows, each megabytes to be read
    parts = max(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), READERS)
    spread = places.repartition(parts, F.xxhash64("path", "start"))
    return spread.mapInArrow(read, RECORD)


def archived(spark: SparkSession, pages: DataFrame, page_id: str = "page_id", html: str = "html",
             url: str = "url") -> DataFrame:
    """Writes every page as a record in the shared folder and reads the packages back.

    A null html is an empty payload, a null url no target, a null page_id an
    empty record name; a group of equal payloads whose ids are all null has no
    revisits. Repeated rows of the largest id are all responses. An empty table
    gives no package and no record.
    """
    folder = f"{shared_dir(spark)}/wacz-{uuid.uuid4().hex}"
    return read_packages(write_packages(with_originals(pages, page_id, html, url), folder))
