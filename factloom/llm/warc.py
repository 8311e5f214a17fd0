"""WARC archives whose records are compressed one by one with a Zstandard dictionary.

Each archive begins with a skippable frame that holds a dictionary built from its own records; each record is a Zstandard
frame of its own, so it can be read alone. Of records with equal payloads one is the response, the others are revisits
that carry its id and no payload. Archives are cut by bytes and are files of their own: Spark's text writer writes each as
one value with an empty skippable frame as its end, so archives go wherever Spark writes, its commit protocol covers lost
executors, and a reader's task holds one archive of bounded size at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, small_batches

#: Skippable frames: the one that holds the dictionary, and an empty one that stands between records.
DICT_MAGIC = b"\x5d\x2a\x4d\x18"
EMPTY_FRAME = "P*M\x18\0\0\0\0"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _clean(value) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def record(kind: str, record_id: str, page_id, uri, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_clean(uri) if uri else 'urn:x-none'}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"] if refers_to else []), *([f"X-Page-ID: {page_id}"] if page_id is not None else []), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int):
    """A dictionary from records; None if there are too few to build one from."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples)
    except (zstandard.ZstdError, MemoryError, ValueError):
        return None


def archive(records: list[bytes], full: list[bool], size: int, sample_bytes: int, level: int) -> bytes:
    """One archive: the frame of the dictionary, then that of each record, each followed by an empty frame but the last.

    The dictionary is built from every k-th of the archive's records that carry a payload (full), k the least for which
    they have about sample_bytes; whole, in pieces of 64 KB as the trainer takes short samples.
    """
    bodies = [r for r, f in zip(records, full, strict=True) if f]
    bodies = bodies[:: max(1, -(-sum(map(len, bodies)) // sample_bytes))]
    d = dictionary([r[i : i + 65536] for r in bodies for i in range(0, len(r), 65536)], size)
    raw = d.as_bytes() if d else b""
    c = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=True) if d else zstandard.ZstdCompressor(level=level, write_checksum=True)
    return EMPTY_FRAME.encode().join([DICT_MAGIC + struct.pack("<I", len(raw)) + raw, *map(c.compress, records)])


def archives(records, size: int, sample_bytes: int, archive_bytes: int, level: int):
    """Archives of records (bytes, whether it carries a payload): each of about archive_bytes before compression, or of one
    larger record."""
    held: list = []
    n = 0
    for r in records:
        if held and n + len(r[0]) > archive_bytes:
            yield archive(*map(list, zip(*held, strict=True)), size, sample_bytes, level)
            held, n = [], 0
        held.append(r)
        n += len(r[0])
    if held:
        yield archive(*map(list, zip(*held, strict=True)), size, sample_bytes, level)


def parse(archive):
    """(headers, block) of each record of an archive."""
    at, d, archive = 0, None, memoryview(archive)
    if archive[:4] == DICT_MAGIC:
        n = struct.unpack("<I", archive[4:8])[0]
        at, d = 8 + n, zstandard.ZstdCompressionDict(bytes(archive[8 : 8 + n])) if n else None
    z = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()
    with z.stream_reader(archive[at:], read_across_frames=True) as f:
        held = bytearray()

        def fill() -> bool:
            more = f.read(1 << 18)
            held.extend(more)
            return bool(more)

        while True:
            while (end := held.find(b"\r\n\r\n")) < 0:
                if not fill():
                    if held:
                        raise ValueError("archive ends within a record")
                    return
            lines = bytes(held[:end]).decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"no record begins with {lines[0][:40]!r}")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            stop = end + 4 + int(headers["Content-Length"])
            while len(held) < stop + 4:
                if not fill():
                    raise ValueError("archive ends within a record")
            yield headers, bytes(held[end + 4 : stop])
            del held[: stop + 4]


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", dict_bytes: int = 65536, sample_bytes: int = 4 << 20, archive_bytes: int = 32 << 20, level: int = 3) -> None:
    """Writes a record per row of pages to archives below path, each a file of about archive_bytes before compression.

    Null payloads count as empty. Of equal payloads of at least min_bytes, compared by SHA-256, the row of the smallest id
    (null last) is the response; of rows that repeat that id, the first one read. Ids and urls may be null. Empty input gives
    no archive. Other columns are ignored, whatever their names.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    scratch = Scratch(pages.sparkSession, "warc")
    rows = scratch.table(rows.withColumn("key", F.unhex(F.sha2("payload", 256))).withColumn("uid", F.monotonically_increasing_id()), "rows")  # written, so that the numbers hold if a task runs again
    rank = F.struct(F.col("id").isNull().alias("z"), "id", "uid")
    same = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("key").agg(F.min(rank).alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    out = rows.join(scratch.table(same, "same").hint("merge"), "key", "left")  # both sides are tables, so that a payload of any number of pages is split

    def compress(batches):
        def name(i, uid):
            return f"urn:x-page:{'null' if i is None else i}:{uid}"

        def records():
            for p in (p for b in batches for k in range(0, b.num_rows, 256) for p in b.slice(k, 256).to_pylist()):
                least, own = p["least"], name(p["id"], p["uid"])
                first = name(least["id"], least["uid"]) if least else own
                digest = b32(hashlib.sha1(p["payload"]).digest())
                yield record("response" if first == own else "revisit", own, p["id"], p["url"], p["payload"], digest, None if first == own else first, date), first == own and len(p["payload"]) > 0

        for f in archives(records(), dict_bytes, sample_bytes, archive_bytes, level):
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.binary())], names=["archive"])

    out.mapInArrow(compress, "archive binary").select(F.col("archive").cast("string")).write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)
    scratch.drop()


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives below path: record_id, record_type, uri, page_id, refers_to_id, payload_bytes,
    payload_digest, payload (null for revisits). Digests of blocks and of responses' payloads are checked."""
    cols = ["record_id", "record_type", "uri", "page_id", "refers_to_id", "payload_bytes", "payload_digest", "payload"]
    schema = pa.schema([(c, pa.int64() if c == "payload_bytes" else pa.binary() if c == "payload" else pa.string()) for c in cols])

    def rows(archive):
        for h, block in parse(archive):
            head, _, body = block.partition(b"\r\n\r\n")
            size = int(re.search(rb"Content-Length: (\d+)", head)[1])
            digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
            if "sha1:" + b32(hashlib.sha1(block).digest()) != h["WARC-Block-Digest"] or h["WARC-Type"] == "response" and (len(body) != size or b32(hashlib.sha1(body).digest()) != digest):
                raise ValueError(f"{h['WARC-Record-ID']}: digests differ")
            yield h["WARC-Record-ID"][1:-1], h["WARC-Type"], h["WARC-Target-URI"], h.get("X-Page-ID"), h.get("WARC-Refers-To", "<>")[1:-1] or None, size, digest, body if h["WARC-Type"] == "response" else None

    def run(batches):
        for b in batches:
            for archive in b.column(0):
                held, n = [], 0
                for r in rows(archive.as_buffer()):
                    held.append(r)
                    n += len(r[-1] or b"") + 512
                    if n >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                        held, n = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "record_id string, record_type string, uri string, page_id string, refers_to_id string, payload_bytes long, payload_digest string, payload binary")
