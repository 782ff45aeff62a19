"""WARC archives of pages with revisit records, and a two-level capture index to read them back.

Writing: equal payloads are found by digest, the record of the largest page id is the response and the others revisit
it. Each task writes its records as gzip members into archives of a bounded size and returns an entry per record.
Indexing: entries are range-partitioned and sorted by their key (reversed host and path) and page id; each partition
stores compressed blocks of lines and a sparse directory with the first key of each block.
Reading: lookups are routed to a partition by the first keys of the partitions (one row each), find their block by
binary search in the directory, fetch it by one range read, search it, and are then dealt by archive and read in order
of offset.

File names are unique to a task attempt and only entries of successful attempts are indexed, so a lost executor leaves
at most unread files. The folder may be any URI that ``pyarrow.fs`` knows.

Edge cases: a null html is an empty payload; a null url is the key ``)/``; repeated rows each have a record, and
of rows with one page id and one payload all are responses if that id is the largest; an empty table gives no row;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonecast.session import materialize, shared_dir

ARCHIVE_BYTES = 256 << 20
BLOCK_LINES = 2_000
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20  # neighbouring records are fetched together within these
_ESCAPED = {c: f"%{c:02X}" for c in [*range(33), 127]}


def surt(url: str | None) -> str:
    """Sort-friendly key: host labels reversed and lower-cased, then the rest of the url; no white space."""
    rest = (url or "").partition("://")[2] or (url or "")
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:].partition("#")[0]
    host, _, port = host.partition(":")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (path if path.startswith("/") else "/" + path)
    return key.translate(_ESCAPED)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP header with the payload's length, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "" if page_id is None else page_id
    head = [f"WARC/1.1\r\nWARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>",
            f"WARC-Target-URI: {(url or '').translate(_ESCAPED)}", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    whole = "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def parse(member: bytes) -> dict:
    """Headers of a record (lower-case names), its HTTP headers under ``http`` and the payload."""
    whole = zlib.decompress(member, 31)
    head, _, block = whole.partition(b"\r\n\r\n")
    out = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in head.decode().split("\r\n")[1:])}
    block = block[:int(out["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    out["http"] = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in http.decode().split("\r\n")[1:])}
    out["payload"] = payload
    return out


def write_archives(pages: DataFrame, folder: str, least_revisit: int = 0, date: str = "1970-01-01T00:00:00Z",
                   page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages; returns the written entries (key, page_id, archive, offset, length)."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    equal = rows.where(F.octet_length("html") >= least_revisit).groupBy("sha").agg(
        F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    typed = rows.join(equal, "sha", "left").select(
        "page_id", "url", "html", "refers_to",
        (F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = _place(folder)
        place.create_dir(root, recursive=True)
        out, at, archive = None, 0, ""
        try:
            for batch in batches:
                entries = []
                for p, u, h, r, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        archive = f"pages-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                        out, at = place.open_output_stream(f"{root}/{archive}", compression=None), 0
                    member = record(p, u, h.encode(), r, again, date)
                    out.write(member)
                    entries.append((surt(u), p, archive, at, len(member)))
                    at += len(member)
                if entries:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), t) for c, t in zip(zip(*entries, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                        ["key", "page_id", "archive", "offset", "length"])
        finally:
            if out is not None:
                out.close()
    # written once: later passes must not write the archives again
    return materialize(typed.mapInArrow(run, "key string, page_id long, archive string, offset long, length long"), "entries")


def write_index(entries: DataFrame, folder: str) -> DataFrame:
    """Sort entries into compressed blocks; returns one row per index partition (first_key, first_id, name)."""
    ordered = entries.withColumn("id", F.coalesce("page_id", F.lit(-1 << 62))).repartitionByRange(
        "key", "id").sortWithinPartitions("key", "id", "archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = _place(folder)
        place.create_dir(root, recursive=True)
        name = f"index-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        lines: list[str] = []
        directory: list[str] = []
        first, at = None, 0

        def flush(out):
            nonlocal at
            block = zlib.compress("\n".join(lines).encode())
            out.write(block)
            directory.append(" ".join([*lines[0].split(" ")[:2], str(at), str(len(block))]))
            at += len(block)
            lines.clear()
        with place.open_output_stream(f"{root}/{name}.blocks", compression=None) as out:
            for batch in batches:
                for key, _, archive, offset, length, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    first = first or (key, own)
                    lines.append(f"{key} {own} {archive} {offset} {length}")
                    if len(lines) >= BLOCK_LINES:
                        flush(out)
            if lines:
                flush(out)
        if first:
            with place.open_output_stream(f"{root}/{name}.directory", compression=None) as out:
                out.write("\n".join(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*first, name)], ["first_key", "first_id", "name"])
    return materialize(ordered.mapInArrow(run, "first_key string, first_id long, name string"), "index")


class Reader:
    """One index partition: its directory, and the block read last."""

    def __init__(self, folder: str, name: str):
        self.place, root = _place(folder)
        self.path = f"{root}/{name}"
        with self.place.open_input_file(f"{self.path}.directory") as f:
            rows = [x.split(" ") for x in f.read().decode().split("\n")]
        self.firsts = [(k, int(i)) for k, i, _, _ in rows]
        self.ranges = [(int(a), int(n)) for _, _, a, n in rows]
        self.blocks = self.place.open_input_file(f"{self.path}.blocks")
        self.held, self.lines, self.keys = -1, [], []

    def _load(self, k: int) -> None:
        if k != self.held:
            at, n = self.ranges[k]
            self.blocks.seek(at)
            self.lines = [x.split(" ") for x in zlib.decompress(self.blocks.read(n)).decode().split("\n")]
            self.keys = [(x[0], int(x[1])) for x in self.lines]
            self.held = k

    def find(self, key: str, own: int) -> Iterator[tuple[str, int, int]]:
        """Archive, offset and length of every entry of a key and page id."""
        k = max(0, bisect.bisect_left(self.firsts, (key, own)) - 1)
        while k < len(self.firsts) and self.firsts[k] <= (key, own):
            self._load(k)
            for i in range(bisect.bisect_left(self.keys, (key, own)), len(self.keys)):
                if self.keys[i] != (key, own):
                    return
                yield self.lines[i][2], int(self.lines[i][3]), int(self.lines[i][4])
            k += 1


def locate(lookups: DataFrame, index: DataFrame, folder: str, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Entries (archive, offset, length) of the asked captures, each found through the two levels."""
    parts = sorted((r.first_key, r.first_id, r.name) for r in index.collect())  # one row per index partition
    shared = lookups.sparkSession.sparkContext.broadcast(parts)
    asked = lookups.select(F.coalesce(F.col(page_id).cast("long"), F.lit(-1 << 62)).alias("id"), F.col(url).alias("url")).distinct()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [(k, i) for k, i, _ in shared.value]
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), [surt(u) for u in batch.column(1).to_pylist()]
            part = []
            for k, i in zip(keys, ids, strict=True):
                low, high = max(0, bisect.bisect_left(firsts, (k, i)) - 1), bisect.bisect_right(firsts, (k, i))
                part.append(list(range(low, max(high, low + 1))) if firsts else [])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(part, pa.list_(pa.int32()))],
                                             ["key", "id", "parts"])
    routed = asked.mapInArrow(route, "key string, id long, parts array<int>").select(
        "key", "id", F.explode("parts").alias("part")).distinct()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, reader = None, None
        for batch in batches:
            found = []
            for key, own, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != held:
                    held, reader = part, Reader(folder, shared.value[part][2])
                found += reader.find(key, own)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)],
                                                 ["archive", "offset", "length"])
    return routed.repartition("part").sortWithinPartitions("part", "key", "id").mapInArrow(
        search, "archive string, offset long, length long")


def read_records(entries: DataFrame, folder: str) -> DataFrame:
    """Read entries: page_id, payload_bytes, payload_digest, record_type, refers_to. Digests of responses are checked."""
    ordered = entries.select("archive", "offset", "length").repartition("archive").sortWithinPartitions("archive", "offset")

    def number(name: str | None) -> int | None:
        return int(n) if name and (n := name[len("<urn:page:"):-1]) else None

    def told(member: bytes) -> tuple:
        r = parse(member)
        size, sha = int(r["http"]["content-length"]), r["warc-payload-digest"].removeprefix("sha1:")
        if r["warc-type"] == "response" and (len(r["payload"]) != size or digest(r["payload"]) != sha):
            raise ValueError(f"damaged record {r['warc-record-id']}")
        return number(r["warc-record-id"]), size, sha, r["warc-type"], number(r.get("warc-refers-to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = _place(folder)
        held, source = None, None
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            out, rows = [], list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            i = 0
            while i < len(rows):
                archive, start, length = rows[i]
                if archive != held:
                    if source is not None:
                        source.close()
                    held, source = archive, place.open_input_file(f"{root}/{archive}")
                j, end = i + 1, start + length
                while j < len(rows) and rows[j][0] == archive and rows[j][1] - end <= GAP_BYTES and rows[j][1] + rows[j][2] - start <= READ_BYTES:
                    end = rows[j][1] + rows[j][2]
                    j += 1
                source.seek(start)
                data = source.read(end - start)
                out += [told(data[o - start:o - start + n]) for _, o, n in rows[i:j]]
                i = j
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                                 ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return ordered.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """Archive all pages, index the captures and read every page back through the index."""
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    index = write_index(write_archives(pages, folder, least_revisit), folder)
    return read_records(locate(pages, index, folder), folder)
