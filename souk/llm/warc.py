"""WARC archives with one Zstandard dictionary each, and their reader.

A task writes its records to archives in the shared folder. Each archive starts with a
skippable frame that holds a dictionary trained on the archive's first records, followed
by one frame per record, compressed with that dictionary. A record with a payload that an
earlier page already has is a ``revisit``: headers only, referring to the page with the
smallest page_id, which is the ``response``.

A task reports the archives it finished; only reported ones are read, so a repeated or
speculative attempt leaves files that nobody reads, never half a result.

Defined results: a null html is an empty payload; a null url has no target header; rows
that repeat both page_id and payload are each written as what the first would be; a null
page_id is the smallest only if all its equals are null; an empty table writes no archive
and reads no record; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, stored

SKIPPABLE = 0x184D2A5D
DICT_BYTES = 16 * 1024
SAMPLE_BYTES = 2 << 20        # records an archive's dictionary is trained on
ARCHIVE_BYTES = 64 << 20      # record bytes per archive, before compression
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"     # the pages carry no date of their own
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def make_record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One uncompressed record; ``refers_to`` None makes a response, else a revisit."""
    digest, revisit = digest_of(payload), refers_to is not None
    head = [("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)),
                 ("X-Refers-To-Page", str(refers_to))]
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
             + str(len(payload)).encode() + b"\r\n\r\n") + (b"" if revisit else payload)
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def make_dictionary(samples: list[bytes]):
    """A trained dictionary; where too few samples allow none, their raw content."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICT_BYTES:],
                                             dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Writes records to a binary stream behind a dictionary frame."""

    def __init__(self, out, samples: list[bytes]):
        import zstandard

        trained = make_dictionary(samples)
        raw = trained.as_bytes()
        out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        self.out, self.compressor = out, zstandard.ZstdCompressor(level=LEVEL, dict_data=trained)

    def write(self, record: bytes) -> None:
        self.out.write(self.compressor.compress(record))


def read_archive(data: bytes) -> Iterator[dict]:
    """Header fields (lower-cased names) and ``block`` of each record of one archive."""
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("the archive has no dictionary frame")
    trained = zstandard.ZstdCompressionDict(data[8:8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=trained).stream_reader(
        io.BytesIO(memoryview(data)[8 + size:]), read_across_frames=True)
    stream = io.BufferedReader(reader, 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("a record does not start with its version")
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            fields[name.lower()] = value
        fields["block"] = stream.read(int(fields["content-length"]))
        stream.read(4)
        yield fields


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url",
                   html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write all pages; returns the table of finished archives ``file, records, bytes``."""
    payload = F.coalesce(F.col(html), F.lit(""))
    keyed = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                         payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha"),
                         F.octet_length(payload).alias("size"))
    shared = stored(keyed.where(F.col("size") >= least_bytes).groupBy("sha")
                    .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                    .where("n > 1").drop("n"), "shared")
    # ids travel as text: pandas would turn whole numbers beside a null into floats
    records = keyed.join(shared, "sha", "left").select(
        F.col("page_id").cast("string").alias("page_id"), "url", "html",
        F.when((F.col("size") >= least_bytes) & ~F.col("first").eqNullSafe(F.col("page_id")),
               F.col("first")).cast("string").alias("refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        made, held, held_bytes, out, writer = [], [], 0, None, None
        name, count, size = "", 0, 0

        def start():
            nonlocal out, writer, name, held, held_bytes, count, size
            name = f"pages-{uuid.uuid4().hex}.warc.zst"
            out = store.open_output_stream(f"{root}/{name}", compression=None)
            writer, count, size = ArchiveWriter(out, held), 0, 0
            for record in held:
                add(record)
            held, held_bytes = [], 0

        def add(record: bytes):
            nonlocal count, size
            writer.write(record)
            count, size = count + 1, size + len(record)

        def finish():
            nonlocal out, writer
            if out is not None:
                out.close()
                made.append((name, count, size))
            out = writer = None

        for batch in batches:
            for key, link, body, refers in zip(batch["page_id"], batch["url"], batch["html"],
                                               batch["refers_to"]):
                record = make_record(key, link, body.encode("utf-8"), refers)
                if writer is not None:
                    add(record)
                    if size >= ARCHIVE_BYTES:
                        finish()
                    continue
                held.append(record)
                held_bytes += len(record)
                if held_bytes >= SAMPLE_BYTES:
                    start()
        if held:
            start()
        finish()
        yield pd.DataFrame(made, columns=["file", "records", "bytes"]) \
            .astype({"records": "int64", "bytes": "int64"})

    return stored(records.mapInPandas(write, "file string, records long, bytes long"), "archives")


def read_archives(spark: SparkSession, folder: str, finished: DataFrame) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to``.

    The payload of a response is checked against its digest and length; a revisit has none.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        whole = {"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"}

        def frame(rows):
            return pd.DataFrame({name: pd.array(list(col), whole.get(name, object))
                                 for name, col in zip(names, zip(*rows))})

        for batch in batches:
            for data in batch["content"]:
                rows, size = [], 0
                for r in read_archive(data):
                    digest, length = r["warc-payload-digest"].removeprefix("sha1:"), int(r["x-payload-length"])
                    payload = None
                    if r["warc-type"] == "response":
                        payload = r["block"].partition(b"\r\n\r\n")[2]
                        if len(payload) != length or digest_of(payload) != digest:
                            raise ValueError("a payload differs from its digest")
                    page, refers = r.get("x-page-id"), r.get("x-refers-to-page")
                    rows.append((None if page is None else int(page), r.get("warc-target-uri"), payload,
                                 length, digest, r["warc-type"], None if refers is None else int(refers)))
                    size += len(payload or b"")
                    if size >= 8 << 20:
                        yield frame(rows)
                        rows, size = [], 0
                if rows:
                    yield frame(rows)

    if not finished.take(1):
        return spark.createDataFrame([], "page_id long, url string, payload binary, payload_bytes long, "
                                     "payload_digest string, record_type string, refers_to long")
    files = spark.read.format("binaryFile").load(folder) \
        .withColumn("file", F.substring_index("path", "/", -1))
    return (files.join(finished.select("file"), "file", "left_semi").select("content")
            .mapInPandas(parse, "page_id long, url string, payload binary, payload_bytes long, "
                                "payload_digest string, record_type string, refers_to long"))


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages to fresh archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    return read_archives(spark, folder, write_archives(pages, folder, least_bytes=least_bytes))
