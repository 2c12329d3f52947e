"""WARC archives under Zstandard with a dictionary: writing, reading and validation.

An archive is a skippable frame (magic 0x184D2A5D) with the dictionary, then one Zstandard frame per record. The reader takes the
dictionary from that leading frame, decodes one frame per record, and checks the version line, the record type, the mandatory headers (each once), the
lengths, that each frame ends with its record, and the digest of each response's payload. Other skippable frames (0x184D2A50-5F) are passed over.
Where all records of a set of archives are read, revisits are held against the responses that they refer to: length and digest must be theirs.

Archives are built and written through Spark's own writer into a folder that the cluster shares: one archive per file, followed by an
empty skippable frame where the writer ends its line. A lost task is written again by its next attempt; only committed files are read.

Of records with equal payloads (SHA-256) of at least `least` bytes the one with the smallest page_id is a response, the others revisit it. Null html is an
empty payload; a null page_id is kept and never is what others revisit; repeated page_ids each make a record, and where equal payloads share the smallest page_id, all of
that id are responses. A null url is an empty URI; what isn't printable ASCII in a URL, and spaces, is escaped as its UTF-8 bytes. A record can be larger than an
archive's size; it closes its archive. An empty table makes no archive and an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.plans.lineage import Scratch
from pairloom.plans.ship import ship

DICTIONARY_MAGIC, SKIPPABLE = 0x184D2A5D, range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
#: An empty skippable frame; all its bytes are ASCII, so it can be the writer's line end.
LINE_END = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
#: An archive is closed at this many bytes or records; pages (drawn by a hash of their id, about so many, twice as many at most) and bytes of each from which the dictionary is trained.
ARCHIVE_BYTES, ARCHIVE_RECORDS, SAMPLE_PAGES, SAMPLE_BYTES = 8 << 20, 20_000, 400, 8192
#: A fixed date keeps the archives equal from run to run.
DATE = "2024-01-01T00:00:00Z"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: Record types of the standard (fixed values).
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
#: Bytes of an archive that the decompressor gets at once.
SLICE = 1 << 16


class BadArchive(ValueError):
    """What the archive holds is not what its headers say."""


def escape_url(url: str) -> str:
    """Bytes of UTF-8 that aren't printable ASCII, and spaces, as percent and two hexadecimal digits; escapes that are there stay."""
    return "".join(chr(b) if 32 < b < 127 else f"%{b:02X}" for b in url.encode("utf-8", "surrogatepass"))


def record(page_id: int | None, url: str, payload: bytes, digest: str, revisits: int | None, date: str = DATE) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisits is not None else http + payload
    head = {
        "WARC-Type": "response" if revisits is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": escape_url(url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if revisits is not None:
        head |= {"WARC-Refers-To": f"<urn:page:{revisits}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    head["Content-Length"] = str(len(body))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The headers and payload of a record that is exactly data."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    pairs = [x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines]
    headers = dict(pairs)
    if twice := {k for k, _ in pairs if sum(k == x for x, _ in pairs) > 1}:
        raise BadArchive(f"headers given twice: {sorted(twice)}")
    if not version.startswith("WARC/1.") or not gap:
        raise BadArchive(f"no WARC version line: {version[:40]!r}")
    if missing := [x for x in REQUIRED if x not in headers]:
        raise BadArchive(f"headers missing: {missing}")
    if headers["WARC-Type"] not in TYPES or (headers["WARC-Type"] == "revisit" and "WARC-Refers-To" not in headers):
        raise BadArchive(f"a record of type {headers['WARC-Type'][:40]!r} without what it needs")
    if not headers["Content-Length"].isdigit() or len(rest) != int(headers["Content-Length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise BadArchive(f"a record of {len(rest)} bytes under Content-Length {headers['Content-Length']}")
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), -1)
    digest = headers.get("WARC-Payload-Digest", "").removeprefix("sha256:")
    if headers["WARC-Type"] == "response" and (size != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
        raise BadArchive(f"payload of {headers['WARC-Record-ID']} doesn't match its length or digest")
    return {"headers": headers, "payload": payload, "payload_bytes": size, "digest": digest}


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of an archive, one frame after the other."""
    import zstandard

    dictionary, at, frames = None, 0, 0
    view = memoryview(data)
    while at < len(data):
        if len(data) - at < 8:
            raise BadArchive(f"{len(data) - at} bytes after the last frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(data):
                raise BadArchive("a skippable frame reaches beyond the archive")
            if magic == DICTIONARY_MAGIC and at == 0:
                raw = data[8 : 8 + size]
                dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == FRAME_MAGIC else raw) if size else None
                make = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
            at += 8 + size
            continue
        if bytes(view[at : at + 4]) != FRAME_MAGIC:
            raise BadArchive(f"no frame at byte {at}")
        if at == 0:
            make = zstandard.ZstdDecompressor()
        one, parts, end = make.decompressobj(), [], at
        try:
            while not one.eof and end < len(data):
                parts.append(one.decompress(view[end : end + SLICE]))
                end = min(end + SLICE, len(data))
        except zstandard.ZstdError as e:
            raise BadArchive(f"frame {frames} at byte {at}: {e}") from e
        if not one.eof:
            raise BadArchive(f"frame {frames} at byte {at} is cut short")
        at, frames = end - len(one.unused_data), frames + 1
        yield parse_record(b"".join(parts))


class ArchiveBuilder:
    def __init__(self, dictionary: bytes, level: int = 3) -> None:
        import zstandard

        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.head = dictionary_frame(dictionary)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=True)
        self.parts, self.size = [self.head], len(self.head)

    def add(self, data: bytes) -> None:
        frame = self.compressor.compress(data)
        self.parts.append(frame)
        self.size += len(frame)

    @property
    def full(self) -> bool:
        return self.size >= ARCHIVE_BYTES or len(self.parts) > ARCHIVE_RECORDS

    def close(self) -> bytes | None:
        data = b"".join(self.parts) if len(self.parts) > 1 else None
        self.parts, self.size = [self.head], len(self.head)
        return data


def train_dictionary(samples: list[bytes], size: int = 32_768) -> bytes:
    """A Zstandard dictionary; few or tiny samples give a raw one of the samples themselves, none an empty one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _build(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = ArchiveBuilder(dictionary)
        for batch in batches:
            for page, url, payload, digest, first in zip(*(batch.column(i) for i in range(5))):
                builder.add(record(page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), first.as_py()))
                if builder.full:
                    yield pa.RecordBatch.from_arrays([pa.array([builder.close()], pa.binary())], names=["archive"])
        if data := builder.close():
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["archive"])

    return run


def marked(pages: DataFrame, least: int = 100, salts: int = 16) -> DataFrame:
    """page_id, url, payload binary, digest, refers_to (null for responses).

    Only payloads that occur twice are looked up, and pages are salted by their id, so the copies of one page are spread over `salts` tasks."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    twice = pages.where(F.octet_length("html") >= least).select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest")).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.coalesce(F.pmod("page_id", F.lit(salts)), F.lit(0)).cast("int"))
    joined = salted.join(twice, ["digest", "salt"], "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") == F.col("first"), F.lit(None)).otherwise(F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least: int = 100) -> None:
    """Write the pages as .warc.zst archives into a new folder. The dictionary is trained on a bounded sample of pages."""
    share = min(1.0, SAMPLE_PAGES / max(1, pages.count()))
    drawn = F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = pages.where(drawn).limit(2 * SAMPLE_PAGES).select(F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_BYTES).cast("binary").alias("h"))
    dictionary = train_dictionary(sorted(bytes(r.h) for r in sample.collect() if r.h))
    archives = marked(ship(pages), least).mapInArrow(_build(dictionary), "archive binary")
    archives.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", LINE_END).option("maxRecordsPerFile", 1).text(path)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def number(urn: str) -> int | None:
        text = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    for batch in batches:
        for data in batch.column(0):
            rows = []
            for r in read_archive(data.as_py()):
                h = r["headers"]
                rows.append((number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), r["payload_bytes"], r["digest"], h["WARC-Type"], number(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def wrong_revisits(records: DataFrame) -> DataFrame:
    """The revisits whose length or digest no response of the page that they refer to has. What responses say is read once for each page, length and digest."""
    said = ["payload_bytes", "payload_digest"]
    there = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), *said).distinct()
    return records.where("record_type = 'revisit'").join(there, ["refers_to", *said], "left_anti").select(*records.columns)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, uri, payload_bytes, payload_digest, record_type, refers_to of every record of the archives in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_parse, "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write the pages' archives into the shared folder and read them back."""
    scratch = Scratch(pages.sparkSession, "warc")
    path = scratch.path("archives")
    write_archives(pages, path, least)
    return read_archives(pages.sparkSession, path)
