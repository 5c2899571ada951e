"""SIGPROC filterbank files: a Python data source that reads and writes, and a scan through Spark's own readers."""

from __future__ import annotations

import math
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from fringework.sources import ranges

#: The header's keys by the kind of their value.
TEXT = ("rawdatafile", "source_name")
DOUBLE = ("az_start", "za_start", "src_raj", "src_dej", "tstart", "tsamp", "period", "fch1", "foff", "refdm", "fchannel")
INT = ("nchans", "telescope_id", "machine_id", "data_type", "ibeam", "nbeams", "nbits", "barycentric", "pulsarcentric", "nbins", "nsamples", "nifs", "npuls")
BYTE = ("signed",)

SCHEMA = "t bigint, chan int, value int"
#: Samples of one partition, about.
PART = 4 << 20


def parse_header(data: bytes) -> tuple[dict, int]:
    """(header, its size). A key that isn't known is an error; fchannel values become the list ``frequencies``."""
    at = 0

    def text() -> str:
        nonlocal at
        (n,) = struct.unpack_from("<i", data, at)
        if not 1 <= n <= 80 or at + 4 + n > len(data):
            raise ValueError(f"no header text at byte {at}")
        at += 4 + n
        return data[at - n : at].decode("ascii")

    if text() != "HEADER_START":
        raise ValueError("the file doesn't begin with a header")
    head: dict = {}
    while (key := text()) != "HEADER_END":
        if key in TEXT:
            head[key] = text()
        elif key == "fchannel":
            head.setdefault("frequencies", []).append(struct.unpack_from("<d", data, at)[0])
            at += 8
        elif key in DOUBLE:
            (head[key],) = struct.unpack_from("<d", data, at)
            at += 8
        elif key in INT:
            (head[key],) = struct.unpack_from("<i", data, at)
            at += 4
        elif key in BYTE:
            head[key] = data[at]
            at += 1
        elif key not in ("FREQUENCY_START", "FREQUENCY_END"):
            raise ValueError(f"unknown header key {key!r}")
    return head, at


def make_header(head: dict) -> bytes:
    text = lambda s: struct.pack("<i", len(s)) + s.encode("ascii")
    out = text("HEADER_START")
    for key, value in head.items():
        if key == "frequencies":
            out += text("FREQUENCY_START") + b"".join(text("fchannel") + struct.pack("<d", f) for f in value) + text("FREQUENCY_END")
        elif key in TEXT:
            out += text(key) + text(value)
        elif key in DOUBLE:
            out += text(key) + struct.pack("<d", value)
        elif key in INT:
            out += text(key) + struct.pack("<i", value)
        elif key in BYTE:
            out += text(key) + bytes([value])
        else:
            raise ValueError(f"unknown header key {key!r}")
    return out + text("HEADER_END")


def _part(data: bytes, first: int, n_chan: int) -> pa.RecordBatch:
    x = np.frombuffer(data, np.uint8)
    t, c = np.divmod(np.arange(len(x)), n_chan)
    return pa.RecordBatch.from_arrays([pa.array(t + first), pa.array(c, pa.int32()), pa.array(x, pa.int32())], ["t", "chan", "value"])


class _Range(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")
        with open(self.path, "rb") as f:
            self.head, self.size = parse_header(f.read(1 << 20))
        if self.head.get("nbits", 8) != 8 or self.head.get("nifs", 1) != 1:
            raise ValueError("only 8-bit files of one IF are read")

    def partitions(self) -> list[_Range]:
        n = (os.path.getsize(self.path) - self.size) // self.head["nchans"]
        step = max(1, PART // self.head["nchans"])
        return [_Range(a, min(step, n - a)) for a in range(0, n, step)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        n = self.head["nchans"]
        with open(self.path, "rb") as f:
            f.seek(self.size + partition.first * n)
            yield _part(f.read(partition.count * n), partition.first, n)


class _Done(WriterCommitMessage):
    def __init__(self, parts: list[tuple[int, str]]):
        self.parts = parts


class _Writer(DataSourceArrowWriter):
    """Each task writes its rows, which must be in order and whole samples; commit joins the pieces in order of time."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].removeprefix("file://")
        self.head = {k: (options[k] if k in TEXT else float(options[k]) if k in DOUBLE else int(options[k])) for k in (*TEXT, *DOUBLE, *INT) if k in options}
        if os.path.exists(self.path) and not overwrite:
            raise ValueError(f"{self.path} is there")

    def write(self, batches) -> _Done:
        n, first, last, file = self.head["nchans"], None, -1, None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column("t").to_numpy() * n + batch.column("chan").to_numpy()
            if first is None:
                first, last = int(place[0]), int(place[0]) - 1
                name = f"{self.path}.part-{first}"
                file = open(name, "wb")
            if (np.diff(place, prepend=last) != 1).any():
                file.close()
                os.remove(name)
                raise ValueError("rows of a partition must be in order of t and chan, without gaps")
            last = int(place[-1])
            file.write(np.clip(batch.column("value").to_numpy(), 0, 255).astype(np.uint8).tobytes())
        if file is None:
            return _Done([])
        file.close()
        return _Done([(first, name)])

    def commit(self, messages) -> None:
        parts = sorted(p for m in messages if m for p in m.parts)
        with open(self.path, "wb") as f:
            f.write(make_header(self.head))
            for _, name in parts:
                with open(name, "rb") as g:
                    while data := g.read(1 << 20):
                        f.write(data)
                os.remove(name)

    def abort(self, messages) -> None:
        for m in messages:
            for _, name in m.parts if m else []:
                os.remove(name)


class Sigproc(DataSource):
    """spark.dataSource.register(Sigproc), then format("sigproc"). Files lie where all executors see them."""

    @classmethod
    def name(cls) -> str:
        return "sigproc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value as text) of every file below path."""

    def run(batches):
        for batch in batches:
            rows = [(p, k, str(v)) for p, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, v in parse_header(d)[0].items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in list(zip(*rows)) or [()] * 3], ["path", "key", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, key string, value string")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, t, chan, value) of every file below path, read in ranges: large files are many tasks' work. A half sample at the end is left out."""

    def plan(batches):
        for batch in batches:
            for name, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with ranges.opened(name) as f:
                    head, size = parse_header(f.read_at(min(length, 1 << 20), 0))
                n = head["nchans"]
                if head.get("nbits", 8) != 8 or head.get("nifs", 1) != 1:
                    raise ValueError(f"{name}: only 8-bit files of one IF are read")
                step, there = max(1, ranges.STEP // n), (length - size) // n
                first = np.arange(0, there, step)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(first), pa.string()), pa.array(size + first * n), pa.array(np.minimum(step, there - first) * n), pa.array(np.full(len(first), length)), pa.array(first), pa.array(np.full(len(first), n))], ["path", "at", "size", "length", "first", "n"])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                first, n = one.column(4)[0].as_py(), one.column(5)[0].as_py()
                for name, _, _, data in ranges.contents([one]):
                    step = max(1, PART // n) * n
                    for at in range(0, len(data), step):
                        part = _part(data[at : at + step], first + at // n, n)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * part.num_rows), *part.columns], ["path", "t", "chan", "value"])

    found = ranges.files(spark, path)
    n = max(1, math.ceil((found.agg(F.sum("length")).first()[0] or 0) / ranges.STEP))
    planned = found.mapInArrow(plan, ranges.SCHEMA + ", first bigint, n bigint").repartition(n, "path", "at")
    return planned.mapInArrow(run, "path string, t bigint, chan int, value int")


def write_pieces(fb: DataFrame, folder: str, pieces: int | None = None, **head) -> DataFrame:
    """Writes (t, chan, value) as files of consecutive samples in a folder, each with its own header; (path, first, samples) of each.

    No byte goes through the driver, and any file system that Arrow opens will do. A piece's tstart is that
    of its first sample. There are ``pieces`` of them, or as many as Spark makes of the size. Rows must be there for every channel of a sample; a task that runs again replaces its piece.
    """
    n, tstart, tsamp = int(head["nchans"]), float(head.get("tstart", 0.0)), float(head.get("tsamp", 0.0))

    def run(batches):
        system, inside = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        system.create_dir(inside, recursive=True)
        out, name, first, last = None, "", 0, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column(0).to_numpy() * n + batch.column(1).to_numpy()
            if out is None:
                if place[0] % n:
                    raise ValueError("a piece must begin with a whole sample")
                first, last = int(place[0]) // n, int(place[0]) - 1
                name = f"{inside}/{first:015d}.fil"
                out = system.open_output_stream(name, compression=None)
                out.write(make_header(head | {"tstart": tstart + first * tsamp / 86400}))
            if (np.diff(place, prepend=last) != 1).any():
                raise ValueError("rows of a piece must be every channel of consecutive samples")
            last = int(place[-1])
            out.write(np.clip(batch.column(2).to_numpy(), 0, 255).astype(np.uint8).tobytes())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first]), pa.array([(last + 1) // n - first])], ["path", "first", "samples"])

    rows = fb.select(F.col("t").cast("bigint").alias("t"), F.col("chan").cast("int").alias("chan"), F.col("value").cast("int").alias("value"))
    done = rows.repartitionByRange(*[pieces][: pieces is not None], "t").sortWithinPartitions("t", "chan").mapInArrow(run, "path string, first bigint, samples bigint")
    return fb.sparkSession.createDataFrame(done.collect(), done.schema)  # a row for each piece; the files are there when this returns


def write(fb: DataFrame, path: str, **head) -> None:
    """Writes (t, chan, value) as one file: sorted by range, so that tasks hold consecutive samples."""
    fb.sparkSession.dataSource.register(Sigproc)
    rows = fb.select(F.col("t").cast("bigint").alias("t"), F.col("chan").cast("int").alias("chan"), F.col("value").cast("int").alias("value"))
    rows = rows.repartitionByRange("t", "chan").sortWithinPartitions("t", "chan")
    rows.write.format("sigproc").mode("append").options(**{k: str(v) for k, v in head.items()}).save(path)
