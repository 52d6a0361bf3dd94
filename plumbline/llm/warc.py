"""WARC archives in Zstandard: one frame a record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import slices, table
from plumbline.session import fresh_path, ship, stored

# Fixed values of the formats.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
ARCHIVE_BYTES, DICTIONARY_BYTES, DICTIONARY_SAMPLES = 8 << 20, 16 << 10, 200
FIELDS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page, url, payload: bytes, refers) -> bytes:
    """One record. Line breaks in the address are percent-coded; a revisit has an empty block."""
    kind, body = ("response", payload) if refers is None else ("revisit", b"")
    address = "".join(f"%{ord(c):02X}" if c < "!" or c == "\x7f" else c for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
             "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {address}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
             f"X-Payload-Length: {len(payload)}", "Content-Type: text/html", f"Content-Length: {len(body)}"]
    if refers is not None:
        lines.insert(3, f"WARC-Refers-To: <urn:page:{refers}>")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The bytes of an archive. The dictionary is trained on its first records, or is their raw bytes if they are few."""
    import zstandard

    sample = records[:DICTIONARY_SAMPLES]
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, sample)
    except zstandard.ZstdError:
        trained = zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES].ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    body = zstandard.ZstdCompressor(level=3).compress(trained.as_bytes())
    packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(body)), body, *map(packer.compress, records)])


def frames(data: memoryview, at: int):
    """(start, end) of each frame: its header and block sizes are read, nothing is decoded."""
    while at < len(data):
        magic, flags = struct.unpack_from("<IB", data, at)
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        single = flags >> 5 & 1
        end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
        last = 0
        while not last:
            head = int.from_bytes(data[end:end + 3], "little")
            last = head & 1
            end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        end += 4 * (flags >> 2 & 1)
        if end > len(data):
            raise ValueError(f"cut frame at byte {at}")
        yield at, end
        at = end


def read(content: bytes):
    """Records of an archive as FIELDS. Wrong headers, lengths or digests raise."""
    import zstandard

    data = memoryview(content)
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no leading dictionary frame")
    raw = bytes(data[8:8 + size])
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):
        raw = zstandard.ZstdDecompressor().decompress(raw)
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    for start, end in frames(data, 8 + size):
        head, _, rest = opener.decompress(data[start:end]).partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        length = int(fields["Content-Length"])
        if first != "WARC/1.1" or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
            raise ValueError(f"bad record at byte {start}")
        name, of = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields.get("WARC-Refers-To")
        if fields["WARC-Type"] == "response" and digest(rest[:length]) != name:
            raise ValueError(f"payload at byte {start} doesn't have its digest")
        page = fields["WARC-Record-ID"][10:-1]
        yield (int(page) if page else None, int(fields["X-Payload-Length"]), name, fields["WARC-Type"],
               int(of[10:-1]) if of else None, rest[:length])


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """Adds `_refers`: the smallest page_id with an equal payload of at least `least` bytes, null for that page itself.

    Null pages are empty payloads. Rows that repeat the smallest page_id are responses too; a null page_id names no response.
    """
    keyed = pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("_sum", F.sha1(F.col("html").cast("binary")))
    first = stored(keyed.groupBy("_sum").agg(F.min("page_id").alias("_first")), "payloads")
    long = F.octet_length("html") >= least
    own = F.col("page_id").eqNullSafe(F.col("_first"))
    return keyed.join(first, "_sum").withColumn("_refers", F.when(long & ~own, F.col("_first"))).drop("_sum", "_first")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes archives of about ARCHIVE_BYTES under `folder` and returns their paths.

    A task writes under a name of its own and returns what it wrote, so files of failed tries are never read.
    """
    def run(batches):
        from pyarrow import fs

        def write(records):
            store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
            store.create_dir(path, recursive=True)
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{path}/{name}", compression=None) as out:
                out.write(archive(records))
            return pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

        records, size = [], 0
        for batch in slices(batches, "html"):
            for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "_refers")), strict=True):
                records.append(record(page, url, (html or "").encode(), refers))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield write(records)
                    records, size = [], 0
        if records:
            yield write(records)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", F.col("_refers").cast("long"))
    return stored(rows.mapInArrow(run, "name string"), "archives")


def read_archives(spark: SparkSession, folder: str, names: DataFrame | None = None) -> DataFrame:
    """Records of all archives in a folder, or of the named ones."""
    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for row in read(content.as_buffer().to_pybytes()):
                    rows.append(row)
                    size += len(row[-1])
                    if size > ARCHIVE_BYTES:
                        yield pack(rows)
                        rows, size = [], 0
                if rows:
                    yield pack(rows)

    def pack(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], FIELDS)

    if names is not None and names.isEmpty():
        return spark.createDataFrame([], SCHEMA)
    files = ship(spark).read.format("binaryFile").load(folder).select("content", F.element_at(F.split("path", "/"), -1).alias("name"))
    if names is not None:
        files = files.join(names, "name", "left_semi")
    return files.select("content").mapInArrow(run, SCHEMA)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    names = write_archives(with_revisits(table(spark, sf_dir, "pages")), folder)
    return read_archives(spark, folder, names).drop("payload")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT *, sha1(h) AS x, min(page_id) OVER (PARTITION BY sha1(h)) AS f FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
    (('0x' || substr(x || '0', 1 + (i * 5) // 4, 2))::INT >> (3 - (i * 5) % 4)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM d"""
