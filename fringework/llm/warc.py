"""WARC archives with a two-level capture index.

Records are written to archives of gzip members, one member a record. Captures are sorted by their
address with the host reversed, in blocks of compressed lines; each index file has a sparse
directory with every block's first key. A lookup bisects the index files' first keys, then the
file's directory, and reads ranges only: one block of the index, then the record.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import math
import uuid
import zlib

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from fringework.llm.common import drop_dir, shared_dir, stored

#: Captures in an index block, bytes after which a new archive begins, and bytes of records that a task reads.
BLOCK, ARCHIVE_BYTES, READ_BYTES = 2000, 256 << 20, 128 << 20
_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: str | None) -> str:
    """The address with its host reversed: com,example,www)/path?query. Without :// as it is."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return url or ""
    end = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
    return ",".join(reversed(rest[:end].lower().split("."))) + ")" + (rest[end:].partition("#")[0] or "/")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str | None) -> str:
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in text or "")


def _urn(row: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=row & (1 << 128) - 1)}>"


def record(row: int, page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: str, of: tuple[int, int | None] | None) -> bytes:
    """A gzip member: a response, or a revisit of the record ``of`` = (row, page_id)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if of else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if of else 'response'}", f"WARC-Record-ID: {_urn(row)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head += [f"Page-ID: {page_id}"] if page_id is not None else []
    if of:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(of[0])}"] + ([f"Refers-To-Page-ID: {of[1]}"] if of[1] is not None else [])
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of a gzip member, whose digest must be right."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["WARC-Type"] == "response" and "sha1:" + digest(payload) != fields["WARC-Payload-Digest"]:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:] if ": " in x), payload


def _opened(folder: str):
    """File system and path of a folder given as URI, for code that runs in Python workers."""
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


class _Writer:
    """Files of members with names of their own: a task that runs again leaves those of its first run unused."""

    def __init__(self, folder: str, kind: str):
        self.system, self.path = _opened(folder)
        self.system.create_dir(self.path, recursive=True)
        self.kind, self.out, self.at, self.name = kind, None, 0, ""

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= ARCHIVE_BYTES:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.{self.kind}", 0
            self.out = self.system.open_output_stream(f"{self.path}/{self.name}", compression=None)
        self.out.write(data)
        self.at += len(data)
        return self.name, self.at - len(data), len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class _Reader:
    """Range reads; the file read last stays open."""

    def __init__(self, folder: str):
        self.system, self.path = _opened(folder)
        self.name, self.file = "", None

    def range(self, name: str, at: int, size: int) -> bytes:
        if name != self.name:
            self.close()
            self.file, self.name = self.system.open_input_file(f"{self.path}/{name}"), name
        return self.file.read_at(size, at)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file, self.name = None, ""


def _packed(batches):
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            html = [(h or "").encode("utf-8") for h in part.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(map(len, html), pa.int64()), pa.array(map(digest, html), pa.string()), pa.array(map(pack, html), pa.binary())], ["row", "page_id", "url", "size", "sha1", "packed"])


def write(pages: DataFrame, folder: str, least: int = 0, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """Archives in folder/warc for all rows of pages, and (key, row, file, at, size) of each record.

    Of rows with equal payloads of ``least`` bytes or more, that with the smallest page_id (null last;
    then the first row) is a response and the others are revisits of it.
    """
    base = pages.select(F.monotonically_increasing_id().alias("row"), pages[page_id].cast("bigint").alias("page_id"), pages[url].cast("string").alias("url"), pages[html].cast("string").alias("html"))
    base = stored(base.mapInArrow(_packed, "row bigint, page_id bigint, url string, size bigint, sha1 string, packed binary"), folder, "payloads")
    first = base.where(F.col("size") >= least).groupBy("sha1", "size").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = stored(first.select("sha1", "size", F.col("f.row").alias("of_row"), F.col("f.page_id").alias("of_page")), folder, "first")
    rows = base.join(first, ["sha1", "size"], "left").select("row", "page_id", "url", "size", "sha1", "packed", "of_row", "of_page")

    def run(batches):
        out, unpack = _Writer(f"{folder}/warc", "warc.gz"), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            done = []
            for row, page, address, size, sha1, packed, of_row, of_page in zip(*(c.to_pylist() for c in batch.columns)):
                of = (of_row, of_page) if of_row is not None and of_row != row else None
                done.append((surt(address), row, *out.add(record(row, page, address, None if of else unpack(packed), size, sha1, of))))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*done)) or [()] * 5, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "row", "file", "at", "size"])
        out.close()

    return stored(rows.mapInArrow(run, "key string, row bigint, file string, at bigint, size bigint"), folder, "captures")


def index(captures: DataFrame, folder: str) -> DataFrame:
    """Sorts captures into compressed blocks in folder/index; (first_key, file) of each index file.

    Each file ends with its sparse directory: the first key, place and size of every block, and in
    the last 8 bytes the directory's size. Rows with one key may lie in two files.
    """

    def run(batches):
        out, lines, blocks, first = _Writer(f"{folder}/index", "cdx"), [], [], None

        def flush():
            blocks.append([lines[0][0], *out.add(zlib.compress(json.dumps(lines).encode()))[1:]])
            lines.clear()

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns)):
                first = line[0] if first is None else first
                lines.append(line)
                if len(lines) >= BLOCK:
                    flush()
        if lines:
            flush()
        if blocks:
            tail = zlib.compress(json.dumps(blocks).encode())
            name = out.add(tail + len(tail).to_bytes(8, "big"))[0]
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([name])], ["first_key", "file"])
        out.close()

    files = captures.repartitionByRange("key", "row").sortWithinPartitions("key", "row").select("key", "file", "at", "size")
    return stored(files.mapInArrow(run, "first_key string, file string"), folder, "files")


def _directory(reader: _Reader, name: str) -> list:
    size = reader.system.get_file_info(f"{reader.path}/{name}").size
    n = int.from_bytes(reader.range(name, size - 8, 8), "big")
    return json.loads(zlib.decompress(reader.range(name, size - 8 - n, n)))


def _block(reader: _Reader, name: str, at: int, size: int) -> list:
    return json.loads(zlib.decompress(reader.range(name, at, size)))


def lookup(folder: str, files: list[tuple[str, str]], url: str) -> list[bytes]:
    """The records of an address. files: (first_key, file) of each index file, in order."""
    key, found = surt(url), []
    reader, archive = _Reader(f"{folder}/index"), _Reader(f"{folder}/warc")
    at = max(0, bisect.bisect_left([k for k, _ in files], key) - 1)
    for first, name in files[at:]:
        if first > key:
            break
        blocks = _directory(reader, name)
        b = max(0, bisect.bisect_left([x[0] for x in blocks], key) - 1)
        for begins, place, size in blocks[b:]:
            if begins > key:
                break
            lines = _block(reader, name, place, size)
            i = bisect.bisect_left([x[0] for x in lines], key)
            while i < len(lines) and lines[i][0] == key:
                found.append(archive.range(*lines[i][1:]))
                i += 1
    reader.close()
    archive.close()
    return found


def read_keys(keys: DataFrame, files: DataFrame, captures: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record whose key is in keys(key).

    Each different key is bisected into the index files' first keys and into a file's directory; a row for
    each block that may hold it goes on, so that a key with very many captures is spread over its blocks.
    There it is bisected into the block's lines, and the records found are read in order of their place,
    in as many partitions as their bytes ask for.
    """
    names = sorted(map(tuple, files.select("first_key", "file").collect()))  # a row for each index file, of which a task writes one
    first_keys = [k for k, _ in names]

    def blocks(batches):
        reader, held = _Reader(f"{folder}/index"), ("", [], [])
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                for begins, name in names[max(0, bisect.bisect_left(first_keys, key) - 1) :]:
                    if begins > key:
                        break
                    if held[0] != name:
                        entries = _directory(reader, name)
                        held = (name, entries, [x[0] for x in entries])
                    _, entries, starts = held
                    for first, at, size in entries[max(0, bisect.bisect_left(starts, key) - 1) :]:
                        if first > key:
                            break
                        out.append((name, at, size, key))
                    if len(out) > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["file", "at", "size", "key"])
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["file", "at", "size", "key"])
        reader.close()

    def lines(batches):
        reader, held = _Reader(f"{folder}/index"), (None, [], [])
        for batch in batches:
            for name, at, size, key in zip(*(c.to_pylist() for c in batch.columns)):
                if held[0] != (name, at):
                    block = _block(reader, name, at, size)
                    held = ((name, at), block, [x[0] for x in block])
                _, block, own = held
                low, high = bisect.bisect_left(own, key), bisect.bisect_right(own, key)
                if low < high:
                    _, file, place, length = zip(*block[low:high])
                    yield pa.RecordBatch.from_arrays([pa.array(file), pa.array(place), pa.array(length)], ["file", "at", "size"])
        reader.close()

    def records(batches):
        reader = _Reader(f"{folder}/warc")
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                out = []
                for place in zip(*(c.to_pylist() for c in batch.slice(k, 500).columns)):
                    w, http, payload = parse(reader.range(*place))
                    page, of = w.get("Page-ID"), w.get("Refers-To-Page-ID")
                    size = len(payload) if w["WARC-Type"] == "response" else int(http["Content-Length"])
                    out.append((int(page) if page else None, size, w["WARC-Payload-Digest"][5:], w["WARC-Type"], int(of) if of else None))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        reader.close()

    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    total = captures.agg(F.sum("size")).first()[0] or 0
    n = max(keys.sparkSession.sparkContext.defaultParallelism, math.ceil(total / READ_BYTES))
    place = "file string, at bigint, size bigint"
    asked = keys.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key")
    found = asked.mapInArrow(blocks, place + ", key string").repartition("file", "at").sortWithinPartitions("file", "at", "key").mapInArrow(lines, place)
    return found.repartitionByRange(n, "file", "at").sortWithinPartitions("file", "at").mapInArrow(
        records, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    )


def round_trip(pages: DataFrame, least: int = 0, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """Writes archives and index for pages, looks every page's address up in the index and reads its records back.

    A row for each row of pages: (page_id, payload_bytes, payload_digest, record_type, refers_to).
    Null html is an empty payload, a null address has the empty key, null ids come back null.
    Other columns are ignored. An empty table writes nothing and gives an empty result.
    """
    folder = shared_dir(pages.sparkSession)
    captures = write(pages, folder, least, url, html, page_id)
    files = index(captures, folder)
    for name in ("payloads", "first"):  # they are in the archives now
        drop_dir(pages.sparkSession, f"{folder}/{name}")

    def keyed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(surt, batch.column(0).to_pylist()), pa.string())], ["key"])

    keys = pages.select(pages[url].cast("string").alias("url")).mapInArrow(keyed, "key string")
    return read_keys(keys, files, captures, folder)
