"""Media columns: a Spark data source over archive directories.

``write_archives`` stores one payload per row as an 8-bit grey PNG of 64 pixels
a line inside tar archives, each with an index beside it.  ``MediaArchives`` is
the reader: the driver plans byte ranges from the archives' sizes alone, tasks
find the first member of their range in the sparse table at the end of the
index and stream batches of members through Arrow, and a member that can't be
read is tried again by its own offset without touching the rest.

Archives are named by partition and attempt, and the manifest, which Spark
commits, names those of the attempts that count: a task that runs again after
an executor is lost, or late, touches no other's archive.

Paths are those of pyarrow's file systems; s3a:// and s3n:// are read as s3://.

Defined cases: a null text is stored as an empty one; an empty payload is 64
zero bytes; a null doc_id comes back null; repeated rows are stored each by
itself and come back equal; a long text is one member, held whole by the task
that reads it; an empty table gives a folder without archives and an empty
result; columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import dataset as pads
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sparkloom.llm import textkit as tk
from sparkloom.llm.shared import new_folder

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_STEP = 4 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub("^s3[an]://", "s3://", path)
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


def pad(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return text + bytes(max(WIDTH, -(-len(text) // WIDTH) * WIDTH) - len(text))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes, n_bytes: int) -> bytes:
    """An 8-bit grey image of the payload; its unpadded length is kept as text."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((rows.shape[0], WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, rows.shape[0], 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[bytes, int]:
    """Payload and unpadded length; raises ValueError where a checksum or the form is wrong."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, n_bytes, shape = 8, [], -1, None
    while at < len(media):
        size = struct.unpack_from(">I", media, at)[0]
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if len(media) < at + 12 + size or zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("checksum of a PNG chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"tEXt" and body.startswith(b"Length\0"):
            n_bytes = int(body[7:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey PNG")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    return _unfilter(lines), n_bytes


def _unfilter(lines: np.ndarray) -> bytes:
    """Undo the five line filters; writers of this module use filter 0 only."""
    if not lines[:, 0].any():
        return lines[:, 1:].tobytes()
    out = np.zeros((lines.shape[0] + 1, lines.shape[1]), np.int64)
    for y, line in enumerate(lines.astype(np.int64), 1):
        for x in range(1, line.size):
            a, b, c = out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]
            p = (a + b - c, a, b, c)
            near = min((abs(p[0] - a), 0, a), (abs(p[0] - b), 1, b), (abs(p[0] - c), 2, c))[2]
            out[y, x] = (line[x] + (0, a, b, (a + b) // 2, near)[line[0]]) % 256
    return out[1:, 1:].astype(np.uint8).tobytes()


def _tar_header(name: str, size: int) -> bytes:
    head = bytearray(512)
    for at, part in ((0, name.encode()[:99]), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"00000000000\0"), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
        head[at : at + len(part)] = part
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


class _Writer:
    """One archive and its index: (offset, size) of each member, then a sparse table, then the counts."""

    def __init__(self, folder: str, part: int, attempt: int):
        self.fs, root = _open(folder)
        self.name = f"part-{part:06d}-{attempt}"
        self.to = f"{root}/{self.name}"
        self.fs.create_dir(root, recursive=True)
        self.out, self.at, self.members, self.sparse = self.fs.open_output_stream(self.to + ".tar"), 0, [], []

    def add(self, name: str, media: bytes) -> None:
        if not self.sparse or self.at - self.sparse[-1][1] >= _STEP:
            self.sparse.append((len(self.members), self.at))
        self.out.write(_tar_header(name, len(media)))
        self.out.write(media + bytes(-len(media) % 512))
        self.members.append((self.at, len(media)))
        self.at += 512 + len(media) + -len(media) % 512

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()
        with self.fs.open_output_stream(self.to + ".idx") as idx:
            idx.write(np.array(self.members + self.sparse + [(len(self.members), len(self.sparse))], "<i8").tobytes())


def write_archives(docs: DataFrame, folder: str) -> DataFrame:
    """Store every text of doc_id, text below ``folder``; returns the manifest: name, members and bytes of each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, writer = TaskContext.get(), None
        for batch in batches:
            for part in tk.text_slices(batch):
                data, offs = tk.flat(part.column("text"))
                whole = data.tobytes()
                for k, doc in enumerate(part.column("doc_id").to_pylist()):
                    writer = writer or _Writer(folder, task.partitionId(), task.taskAttemptId())
                    text = whole[offs[k] : offs[k + 1]]
                    writer.add(f"{len(writer.members):09d}/{'null' if doc is None else doc}.png", encode_png(pad(text), len(text)))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"archive": [writer.name], "members": [len(writer.members)], "bytes": [writer.at]})

    docs.select("doc_id", "text").mapInArrow(tk.tidy(run), _MANIFEST).write.parquet(f"{folder.rstrip('/')}/manifest")
    return docs.sparkSession.read.schema(_MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")


_MANIFEST = "archive string, members long, bytes long"


@dataclass
class ByteRange(InputPartition):
    """Members of one archive that start in start..end."""

    path: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", 16 << 20))
        self.tries = int(options.get("tries", 3))
        self.keep_bad = options.get("mode", "failfast").lower() == "permissive"
        self.batch_bytes = int(options.get("batchbytes", 4 << 20))

    def partitions(self) -> list[ByteRange]:
        """Byte ranges of the archives in the manifest, or of all archives where there is none."""
        fs, root = _open(self.folder)
        manifest = f"{root}/manifest"
        if fs.get_file_info(manifest).type == pafs.FileType.Directory:
            found = pads.dataset(manifest, filesystem=fs, format="parquet", schema=pa.schema([("archive", pa.string()), ("bytes", pa.int64())])).to_table()
            sizes = [(f"{root}/{n}.tar", b) for n, b in zip(found.column("archive").to_pylist(), found.column("bytes").to_pylist(), strict=True)]
        else:
            sizes = [(i.path, i.size) for i in fs.get_file_info(pafs.FileSelector(root, recursive=False, allow_not_found=True)) if i.base_name.endswith(".tar")]
        return [ByteRange(path, at, min(at + self.range_bytes, size)) for path, size in sorted(sizes) for at in range(0, size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def _member(self, open_file, file, offset: int, size: int) -> tuple[str, bytes, int, str | None, object]:
        """One member by its offset; on failure the archive is opened again and only this member is read."""
        error, name, body = None, "", b""
        for attempt in range(1, self.tries + 1):
            try:
                head = file.read_at(512, offset)
                if len(head) < 512 or int(head[148:154], 8) != sum(head) - sum(head[148:156]) + 256:
                    raise OSError(f"bad header at {offset}")
                name, body = head[:100].rstrip(b"\0").decode(), file.read_at(size, offset + 512)
                if len(body) != size or int(head[124:135], 8) != size:
                    raise OSError(f"short member at {offset}")
                decode_png(body)
                return name, body, attempt, None, file
            except (OSError, ValueError, zlib.error) as e:
                error = str(e)
                time.sleep(0.05 * (2**attempt - 1) if attempt < self.tries else 0)
                file = open_file()
        return name, body, self.tries, error, file

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = _open(self.folder)
        with fs.open_input_file(part.path[:-4] + ".idx") as idx:
            size = idx.size()
            members, n = np.frombuffer(idx.read_at(16, size - 16), "<i8").tolist()
            sparse = np.frombuffer(idx.read_at(16 * n, size - 16 - 16 * n), "<i8").reshape(-1, 2)
            first = sparse[max(0, np.searchsorted(sparse[:, 1], part.start, "right") - 1), 0] if n else 0
            past = np.searchsorted(sparse[:, 1], part.end)
            last = sparse[past, 0] if past < n else members
            index = np.frombuffer(idx.read_at(16 * int(last - first), 16 * int(first)), "<i8").reshape(-1, 2)
            index = index[(index[:, 0] >= part.start) & (index[:, 0] < part.end)]
        open_file = lambda: fs.open_input_file(part.path)
        file, rows, held = open_file(), [], 0
        for offset, size in index.tolist():
            name, body, tries, error, file = self._member(open_file, file, offset, size)
            if error and not self.keep_bad:
                raise OSError(f"{part.path}: {error}")
            rows.append((part.path, name, offset, None if error else body, tries, error))
            held += size
            if held >= self.batch_bytes:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


_ARROW = pa.schema([("archive", pa.string()), ("name", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("tries", pa.int32()), ("error", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(folder)``; options rangeBytes, batchBytes, tries, mode."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "archive string, name string, offset long, media binary, tries int, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(**options).load(folder)


def _feature(payload: bytes) -> str:
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p, v = counts / counts.sum(), np.arange(256)
    mean = float(p @ v)
    some = p[p > 0]
    return f"grey {WIDTH}x{len(payload) // WIDTH} mean={mean:.4f} std={max(0.0, float(p @ (v - mean) ** 2)) ** 0.5:.4f} entropy={abs(float(-(some * np.log2(some)).sum())):.4f}"


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of each member that was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, body in zip(batch.column("name").to_pylist(), batch.column("media"), strict=True):
                body = body.as_py()
                payload, n_bytes = decode_png(body)
                doc = name.rpartition("/")[2][:-4]
                rows.append((None if doc == "null" else int(doc), n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(body), hashlib.sha256(body).hexdigest(), _feature(payload)))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip((c.split()[0] for c in FEATURES.split(", ")), zip(*rows, strict=True), strict=True)), schema=_FEATURES)

    return media.where("error is null").select("name", "media").mapInArrow(tk.tidy(run), FEATURES)


_FEATURES = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in FEATURES.split(", "))])


def media_round_trip(docs: DataFrame) -> DataFrame:
    """Store every text as media, read the archives back and describe what was read."""
    spark = docs.sparkSession
    folder = new_folder(spark, "media")
    write_archives(docs, folder)
    return media_features(read_archives(spark, folder))
