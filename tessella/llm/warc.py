"""WARC archives as seekable Zstandard bundles.

A bundle is a file of Zstandard frames, each of which holds some whole WARC
records (about ``FRAME_BYTES`` of them) and can be read without the others.  A
skippable frame at its end has the seek table: the packed and unpacked size and a
checksum of each frame.  Other readers of Zstandard see the records one after
another.  The index gives each record's bundle, frame, and offset in the unpacked
frame.

Of records with the same payload the first is written whole; the others revisit
it.  Which they are is found on digests alone: the payloads move once, by record,
so that payloads that many pages share don't meet in one task, and revisits'
payloads don't reach the writers.

A task writes a bundle under another name and moves it when it is complete.  Only
the index, which Spark commits, says what counts: bundles of tasks that were lost
or ran twice are never read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import _delete, hashed, shared_folder, shipped, split_join, staged, staged_alone, table, tidy

#: Unpacked bytes of a frame, about, and packed bytes after which a task starts another bundle.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 1 << 30
#: Payloads of fewer bytes are always written whole.
LEAST_BYTES = 100
#: Zstandard's level.
LEVEL = 3
#: Fixed values of the seekable format: the skippable frame's mark, the footer's mark, and the flag of checksums.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: The format's version, what a record of a page is, and the profile of revisits.
VERSION, PAGE_TYPE = "WARC/1.1", "application/http;msgtype=response"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The time of capture, where pages have none.
DATE = "1970-01-01T00:00:00Z"
#: The beginning of record identifiers.
URN = "urn:page"

INDEX = "record string, kind string, bundle string, frame int, offset long, length long"
RECORDS = "record string, kind string, url string, date string, digest string, refers string, payload_bytes long, payload binary"
#: Bytes of a record in a table of revisits, about.
_LINK_BYTES = 300


def _store(folder: str):
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    return store, root.rstrip("/")


def record_bytes(record: str, kind: str, url: str | None, date: str, digest: str, refers: str | None, payload: bytes) -> bytes:
    """A WARC record; a revisit has the answer's head, without the payload.  Control characters and blanks of the address are percent-encoded, as a header is one line."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    body = http + (b"\r\n" if kind == "revisit" else b"Content-Length: %d\r\n\r\n" % len(payload) + payload)
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{record}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url))
    if refers is not None:
        head += [f"WARC-Refers-To: <{refers}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"Content-Type: {PAGE_TYPE}", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes | None, int]:
    """The headers of the record at a place, its payload (None for a revisit), and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != VERSION:
        raise ValueError(f"no record at {at}")
    headers = dict(line.split(": ", 1) for line in lines)
    start, size = end + 4, int(headers["Content-Length"])
    if data[start + size : start + size + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} is cut off")
    payload = None if headers["WARC-Type"] == "revisit" else data[data.index(b"\r\n\r\n", start) + 4 : start + size]
    return headers, payload, start + size + 4


class _Bundle:
    """A bundle that is being written: frames, then the seek table."""

    def __init__(self, folder: str) -> None:
        import zstandard

        self.store, root = _store(folder)
        self.store.create_dir(root)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.path, self.packer = f"{root}/{self.name}", zstandard.ZstdCompressor(level=LEVEL)
        self.out = self.store.open_output_stream(f"{self.path}.part")
        self.table, self.size, self.frame = [], 0, bytearray()

    def add(self, record: bytes) -> tuple[int, int]:
        """The frame and the offset in it where the record is."""
        place = len(self.table), len(self.frame)
        self.frame += record
        if len(self.frame) >= FRAME_BYTES:
            self.flush()
        return place

    def flush(self) -> None:
        if self.frame:
            raw = bytes(self.frame)
            packed = self.packer.compress(raw)
            self.out.write(packed)
            self.table.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.size += len(packed)
            self.frame = bytearray()

    def close(self) -> None:
        self.flush()
        body = b"".join(self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()
        self.store.move(f"{self.path}.part", self.path)

    def abort(self) -> None:
        self.out.close()
        self.store.delete_file(f"{self.path}.part")


def seek_table(file) -> list[tuple[int, int, int, int]]:
    """Each frame's start, packed size, unpacked size and checksum, from the end of a bundle; two short reads."""
    size = file.size()
    file.seek(size - 9)
    frames, flags, mark = struct.unpack("<IBI", file.read(9))
    if mark != SEEKABLE or flags != CHECKSUMS:
        raise ValueError("no seek table")
    file.seek(size - 9 - 12 * frames)
    out, start = [], 0
    for packed, raw, check in struct.iter_unpack("<III", file.read(12 * frames)):
        out.append((start, packed, raw, check))
        start += packed
    return out


def unpacked(file, start: int, packed: int, raw: int, check: int) -> bytes:
    """One frame."""
    import zstandard

    file.seek(start)
    data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=raw)
    if len(data) != raw or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
        raise ValueError(f"the frame at {start} is damaged")
    return data


def identified(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Pages as ``record`` (an identifier of each row), ``id``, ``copy``, ``url`` and ``payload``.

    Rows are told apart by their ids; only where these repeat are the rows
    written down once with a number.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"))
    repeats = rows.groupBy("id").count().where("count > 1").limit(1).count()
    rows = staged(rows.withColumn("copy", F.monotonically_increasing_id()), "pages") if repeats else rows.withColumn("copy", F.lit(0).cast("long"))
    return rows.withColumn("record", F.concat_ws(":", F.lit(URN), F.col("copy").cast("string"), F.url_encode(F.col("id").cast("string"))))


def record_id(record: Column) -> Column:
    """The page's id in a record identifier, as text; null if it was."""
    return F.url_decode(F.get(F.split(record, ":"), F.lit(3)))


def revisits(rows: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """The rows that repeat another's payload: record, digest, refers (the record that has it, of the smallest id)."""
    marks = staged(rows.select("record", "id", "copy", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size")).where(F.col("size") >= least).drop("size"), "digests")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "copy", "record")
    firsts = marks.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("digest", F.col("first.record").alias("refers"))
    return staged(split_join(marks.select("record", "digest"), staged(firsts, "firsts"), ["digest"]).where(F.col("record") != F.col("refers")), "revisits")


def write_bundles(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE, least: int = LEAST_BYTES) -> DataFrame:
    """Write a record of each row to bundles in a folder that all tasks reach; returns the index, in the shared folder.

    Payloads are the pages' UTF-8; a null one is empty, a null address is left
    out.  Of rows with the same payload of ``least`` bytes or more that with the
    smallest id is the response (null ids come last; of rows that repeat an id,
    any one), and the others revisit it.  Each row has its record, also those that repeat.  An empty
    table gives an empty index and no bundle.
    """
    spark = shipped(pages.sparkSession)
    rows = identified(pages, id_col, url_col, html_col)
    links = revisits(rows, least)
    links = hashed(links, _LINK_BYTES * links.count())
    sent = rows.join(links, "record", "left").select("record", "url", "refers", "digest", F.when(F.col("refers").isNull(), F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        try:
            for batch in batches:
                made = []
                for record, url, refers, digest, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if bundle and bundle.size >= BUNDLE_BYTES:
                        bundle.close()
                        bundle = None
                    bundle = bundle or _Bundle(folder)
                    kind = "revisit" if refers else "response"
                    data = record_bytes(record, kind, url, date, digest or hashlib.sha256(payload).hexdigest(), refers, payload)
                    made.append((record, kind, bundle.name, *bundle.add(data), len(data)))
                columns = list(zip(*made, strict=True)) or [()] * 6
                kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["record", "kind", "bundle", "frame", "offset", "length"])
            if bundle:
                bundle.close()
        except BaseException:
            if bundle:
                bundle.abort()
            raise

    return staged(sent.mapInArrow(tidy(run), INDEX), "index")


def _rows_of(records: list[tuple[dict[str, str], bytes | None]], payloads: bool) -> pa.RecordBatch:
    heads = [h for h, _ in records]
    bare = lambda v: v and v[1:-1]
    columns = [
        pa.array([bare(h["WARC-Record-ID"]) for h in heads], pa.string()),
        pa.array([h["WARC-Type"] for h in heads], pa.string()),
        pa.array([h.get("WARC-Target-URI") for h in heads], pa.string()),
        pa.array([h["WARC-Date"] for h in heads], pa.string()),
        pa.array([h["WARC-Payload-Digest"].removeprefix("sha256:") if p is None else hashlib.sha256(p).hexdigest() for h, p in records], pa.string()),
        pa.array([bare(h.get("WARC-Refers-To")) for h in heads], pa.string()),
        pa.array([None if p is None else len(p) for _, p in records], pa.int64()),
        pa.array([p if payloads else None for _, p in records], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["record", "kind", "url", "date", "digest", "refers", "payload_bytes", "payload"])


def read_bundles(bundles: DataFrame, folder: str, *, payloads: bool = True) -> DataFrame:
    """All records of bundles (column ``bundle``): ``RECORDS``; a revisit has no payload, and digests of payloads are made anew.

    Seek tables are read first, and the frames then dealt out, so a large bundle
    is read by many tasks, each holding a frame at a time.
    """
    spark = shipped(bundles.sparkSession)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{root}/{name}") as f:
                    frames = seek_table(f)
                columns = [pa.array([name] * len(frames), pa.string()), *(pa.array([x[k] for x in frames], pa.int64()) for k in range(4))]
                yield pa.RecordBatch.from_arrays(columns, ["bundle", "start", "packed", "raw", "check"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for name, *frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    data = unpacked(f, *frame)
                found, at = [], 0
                while at < len(data):
                    headers, payload, at = parsed(data, at)
                    found.append((headers, payload))
                yield _rows_of(found, payloads)

    frames = bundles.select("bundle").distinct().mapInArrow(tidy(tables), "bundle string, start long, packed long, raw long, check long")
    return frames.repartition(tasks).mapInArrow(tidy(records), RECORDS)


def fetch(index: DataFrame, folder: str) -> DataFrame:
    """The records of some rows of an index: ``RECORDS``.  Only the frames that hold them are read, each once."""
    spark = shipped(index.sparkSession)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        held, frames, now, data = None, [], None, b""
        for batch in batches:
            found = []
            for name, frame, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (name, frame) != now:
                    with store.open_input_file(f"{root}/{name}") as f:
                        if name != held:
                            held, frames = name, seek_table(f)
                        now, data = (name, frame), unpacked(f, *frames[frame])
                headers, payload, _ = parsed(data, offset)
                found.append((headers, payload))
            yield _rows_of(found, True)

    wanted = index.select("bundle", "frame", "offset")
    return wanted.repartitionByRange(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(tidy(run), RECORDS)


def described(records: DataFrame) -> DataFrame:
    """Records with ``payload_bytes`` of revisits taken from the record that they refer to."""
    found = staged(records.select("record", "kind", "digest", "refers", "payload_bytes"), "records")
    whole = found.where(F.col("kind") == "response")
    again = found.where(F.col("kind") == "revisit").select("record", "kind", "digest", "refers")
    named = staged(again.select("refers").distinct(), "named")
    sizes = staged(whole.select(F.col("record").alias("refers"), "payload_bytes").join(named, "refers"), "sizes")
    return whole.unionByName(split_join(staged(again, "again"), sizes, ["refers"]))


def op11_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to bundles, read them back, and say what each record is."""
    pages, folder = table(spark, sf_dir, "pages"), f"{shared_folder(spark)}/tessella/warc-{uuid.uuid4().hex}"

    def result() -> DataFrame:
        index = write_bundles(pages, folder)
        rows = described(read_bundles(index, folder, payloads=False))
        kind = pages.schema["page_id"].dataType
        return rows.select(record_id(F.col("record")).cast(kind).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), record_id(F.col("refers")).cast(kind).alias("refers_to"))

    out = staged_alone(result, "warc-records")
    _delete(spark, folder)
    return out


OP11_SQL = """
WITH rows AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM rows WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM rows LEFT JOIN firsts USING (payload_digest)
"""
