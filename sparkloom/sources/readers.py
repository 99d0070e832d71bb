"""Readers.  All are lazy; filters and columns reach the scans that can take them."""

from __future__ import annotations

import zlib
from builtins import range as _range
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sparkloom.frame import Frame
from sparkloom.functions.media import open_path


def _finish(df: DataFrame, file_path_column: str | None) -> Frame:
    return Frame(df.select("*", F.col("_metadata.file_path").alias(file_path_column)) if file_path_column else df)


def _reader(spark: SparkSession, schema, options: dict, ignore_corrupt_files: bool):
    out = spark.read.options(**options).option("ignoreCorruptFiles", ignore_corrupt_files)
    return out.schema(schema) if schema is not None else out


def read_parquet(spark: SparkSession, path, schema=None, file_path_column: str | None = None, ignore_corrupt_files: bool = False, **options) -> Frame:
    paths = path if isinstance(path, list) else [path]
    return _finish(_reader(spark, schema, options, ignore_corrupt_files).parquet(*paths), file_path_column)


def read_csv(spark: SparkSession, path, schema=None, has_headers: bool = True, delimiter: str = ",", double_quote: bool = True, quote: str = '"', escape_char: str | None = None, comment: str | None = None, allow_variable_columns: bool = False, file_path_column: str | None = None, ignore_corrupt_files: bool = False, **options) -> Frame:
    """Types are inferred where no schema is given, which reads the files once more."""
    own = {"header": has_headers, "sep": delimiter, "quote": quote, "escape": escape_char or (quote if double_quote else "\\"), "mode": "PERMISSIVE" if allow_variable_columns else "FAILFAST", "inferSchema": schema is None}
    if comment:
        own["comment"] = comment
    return _finish(_reader(spark, schema, own | options, ignore_corrupt_files).csv(path), file_path_column)


def read_json(spark: SparkSession, path, schema=None, file_path_column: str | None = None, ignore_corrupt_files: bool = False, **options) -> Frame:
    return _finish(_reader(spark, schema, options, ignore_corrupt_files).json(path), file_path_column)


def read_text(spark: SparkSession, path, encoding: str = "utf-8", skip_blank_lines: bool = True, whole_text: bool = False, file_path_column: str | None = None) -> Frame:
    if encoding.lower() in ("utf-8", "utf8"):
        df = spark.read.text(path, wholetext=whole_text)
        df = df.select(F.col("value").alias("text"), *([F.col("_metadata.file_path").alias(file_path_column)] if file_path_column else []))
    else:
        texts = spark.read.format("binaryFile").load(path).select("path", F.decode("content", encoding).alias("text"))
        df = texts if whole_text else texts.select("path", F.explode(F.split("text", "\r?\n")).alias("text"))
        df = df.select("text", *([F.col("path").alias(file_path_column)] if file_path_column else []))
    return Frame(df.where("trim(text) <> ''") if skip_blank_lines and not whole_text else df)


def read_blob(spark: SparkSession, path) -> Frame:
    return Frame(spark.read.format("binaryFile").load(path).select("path", "content", F.col("length").alias("size")))


def from_glob_path(spark: SparkSession, path) -> Frame:
    """Paths and sizes; contents aren't read."""
    return Frame(spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.lit(None).cast("long").alias("num_rows")))


def from_files(spark: SparkSession, path) -> Frame:
    df = spark.read.format("binaryFile").load(path)
    return Frame(df.select(F.struct("path", F.lit(0).cast("long").alias("offset"), "length").alias("file")))


_WARC = "WARC_Record_ID string, WARC_Type string, WARC_Date timestamp, Content_Length long, WARC_Identified_Payload_Type string, warc_content binary, warc_headers string"


class _Bytes:
    """A file's bytes from an offset on, a block at a time, unpacked where they are gzip members."""

    BLOCK = 1 << 20

    def __init__(self, file, start: int, packed: bool):
        self.file, self.at, self.packed, self.raw, self.out, self.unpack = file, start, packed, b"", b"", None
        self.member = start  # where the gzip member that was unpacked last starts

    def more(self) -> bool:
        if not self.raw:
            self.raw = self.file.read_at(self.BLOCK, self.at) if self.at < self.file.size() else b""
            self.at += len(self.raw)
        if not self.raw:
            return False
        if not self.packed:
            self.out, self.raw = self.out + self.raw, b""
            return True
        if self.unpack is None:
            self.unpack, self.member = zlib.decompressobj(31), self.at - len(self.raw)
        self.out += self.unpack.decompress(self.raw)
        self.raw = b""
        if self.unpack.eof:
            self.raw, self.unpack = self.unpack.unused_data, None
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Everything before the mark, which goes too; None where the file ends first."""
        at = -1
        while (at := self.out.find(mark)) < 0:
            if not self.more():
                return None
        head, self.out = self.out[:at], self.out[at + len(mark) :]
        return head

    def take(self, n: int) -> bytes:
        parts, held = [], 0
        while held + len(self.out) < n:
            parts.append(self.out)
            held, self.out = held + len(self.out), b""
            if not self.more():
                break
        part, self.out = self.out[: n - held], self.out[n - held :]
        return b"".join([*parts, part])


def _warc_fields(head: bytes) -> dict[str, str]:
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip()] = v.strip()
    return fields


def warc_records(file, start: int = 0, end: int | None = None, packed: bool = False) -> Iterator[tuple[dict, bytes]]:
    """Header fields and content of each record; of gzip files those whose member starts in start..end."""
    end = file.size() if end is None else end
    at = _next_member(file, start, end) if packed else start
    if at is None:
        return
    source = _Bytes(file, at, packed)
    while source.until(b"WARC/") is not None and (not packed or source.member < end):
        fields = _warc_fields(b"WARC/" + (source.until(b"\r\n\r\n") or b""))
        yield fields, source.take(int(fields.get("Content-Length", 0)))


def _next_member(file, at: int, end: int) -> int | None:
    """The first place from ``at`` on where a gzip member starts that holds a WARC record."""
    while at < end:
        block = file.read_at(min(_Bytes.BLOCK, end - at) + 2, at)
        found = block.find(b"\x1f\x8b\x08")
        while found >= 0 and at + found < end:
            try:
                if zlib.decompressobj(31).decompress(file.read_at(4096, at + found), 16).lstrip().startswith(b"WARC/"):
                    return at + found
            except zlib.error:
                pass
            found = block.find(b"\x1f\x8b\x08", found + 1)
        at += max(1, len(block) - 2)
    return None


_WARC_ARROW = pa.schema([("WARC_Record_ID", pa.string()), ("WARC_Type", pa.string()), ("WARC_Date", pa.timestamp("us", "UTC")), ("Content_Length", pa.int64()), ("WARC_Identified_Payload_Type", pa.string()), ("warc_content", pa.binary()), ("warc_headers", pa.string())])


@dataclass
class _WarcRange(InputPartition):
    path: str
    start: int
    end: int


class _WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folders, self.range_bytes = options["path"].split("\n"), int(options.get("rangebytes", 128 << 20))

    def partitions(self) -> list[InputPartition]:
        fs, root = open_path(self.folders[0])
        scheme = self.folders[0].removesuffix(root)
        if not all(f.startswith(scheme) for f in self.folders):
            raise ValueError(f"all paths must start with {scheme!r} as the first does")
        files = []
        for info in fs.get_file_info([f[len(scheme) :] for f in self.folders]):
            files += [info] if info.is_file else [f for f in fs.get_file_info(pafs.FileSelector(info.path, recursive=True)) if f.is_file and f.base_name[0] not in "._"]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            step = self.range_bytes if f.path.endswith(".gz") else max(f.size, 1)
            out += [_WarcRange(f.path, at, min(at + step, f.size)) for at in _range(0, f.size, step)]
        return out or [_WarcRange("", 0, 0)]

    def read(self, part: _WarcRange) -> Iterator[pa.RecordBatch]:
        import json
        from datetime import datetime

        if not part.path:
            return
        rows, held = [], 0
        with open_path(self.folders[0])[0].open_input_file(part.path) as file:
            for f, body in warc_records(file, part.start, part.end, part.path.endswith(".gz")):
                when = f.pop("WARC-Date", None)
                rows.append(
                    {
                        "WARC_Record_ID": f.pop("WARC-Record-ID", "").strip("<>").removeprefix("urn:uuid:") or None,
                        "WARC_Type": f.pop("WARC-Type", None),
                        "WARC_Date": datetime.fromisoformat(when.replace("Z", "+00:00")) if when else None,
                        "Content_Length": int(f.pop("Content-Length", 0)),
                        "WARC_Identified_Payload_Type": f.pop("WARC-Identified-Payload-Type", None),
                        "warc_content": body,
                        "warc_headers": json.dumps(f),
                    }
                )
                held += len(body)
                if held >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=_WARC_ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_WARC_ARROW)


class WarcArchives(DataSource):
    """``spark.read.format("warc_archives").load(path)``: gzip files by byte ranges (option rangeBytes), plain ones a task each."""

    @classmethod
    def name(cls) -> str:
        return "warc_archives"

    def schema(self) -> str:
        return _WARC

    def reader(self, schema: StructType) -> DataSourceReader:
        return _WarcReader(dict(self.options))


def read_warc(spark: SparkSession, path: str | list[str], **options) -> Frame:
    """A row for each record; a task holds some megabytes of a file, or one record.  Several paths share one file system."""
    spark.dataSource.register(WarcArchives)
    return Frame(spark.read.format("warc_archives").options(**options).load(path if isinstance(path, str) else "\n".join(path)))


def read_sql(spark: SparkSession, sql: str, conn: str | Callable, partition_col: str | None = None, num_partitions: int = 1, schema: str | None = None, **options) -> Frame:
    """A query over JDBC (a URL), or over a DB-API connection that ``conn()`` opens in each task.

    With a partition column the query is cut into ranges between its least and
    largest value, and each task reads one.
    """
    if isinstance(conn, str):
        bounds = {}
        if partition_col:
            low, high = spark.read.format("jdbc").options(url=conn, query=f"select min({partition_col}), max({partition_col}) from ({sql}) b", **options).load().first()
            bounds = {"partitionColumn": partition_col, "lowerBound": low, "upperBound": high, "numPartitions": num_partitions}
        return Frame(spark.read.format("jdbc").options(url=conn, dbtable=f"({sql}) t", **bounds, **options).load())
    ranges = [None]
    with conn() as db:
        if schema is None:
            cursor = db.execute(f"select * from ({sql}) t limit 1000")
            names = [d[0] for d in cursor.description]
            schema = spark.createDataFrame(cursor.fetchall(), names).schema
        if partition_col and num_partitions > 1:
            low, high = db.execute(f"select min({partition_col}), max({partition_col}) from ({sql}) t").fetchone()
            if low is not None:
                edges = [low + (high - low) * k / num_partitions for k in _range(1, num_partitions)]
                ranges = [f"{partition_col} < {edges[0]!r} or {partition_col} is null", *(f"{partition_col} >= {a!r} and {partition_col} < {b!r}" for a, b in zip(edges, edges[1:], strict=False)), f"{partition_col} >= {edges[-1]!r}"]
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    parts = spark.createDataFrame([(r,) for r in ranges], "r string").repartition(len(ranges))

    def run(batches):
        for batch in batches:
            for r in batch["r"]:
                with conn() as db:
                    cursor = db.execute(f"select * from ({sql}) t" + (f" where {r}" if r else ""))
                    while rows := cursor.fetchmany(10_000):
                        import pandas as pd

                        yield pd.DataFrame(rows, columns=[d[0] for d in cursor.description])

    return Frame(parts.mapInPandas(run, wanted))


def read_kafka(spark: SparkSession, bootstrap_servers: str, topics: str, start: str = "earliest", end: str = "latest", **options) -> Frame:
    """A bounded range of offsets; needs Spark's Kafka package."""
    return Frame(spark.read.format("kafka").options(**{"kafka.bootstrap.servers": bootstrap_servers, "subscribe": topics, "startingOffsets": start, "endingOffsets": end} | options).load())


def _table(spark: SparkSession, fmt: str, path: str, chosen: dict, options: dict) -> Frame:
    """Spark's connector, whose jar must be on the class path, with what is chosen by its own option names."""
    return Frame(spark.read.format(fmt).options(**{k: v for k, v in chosen.items() if v is not None}, **options).load(path))


def read_iceberg(spark: SparkSession, table: str, snapshot_id: int | None = None, branch: str | None = None, tag: str | None = None, as_of_timestamp: int | None = None, **options) -> Frame:
    """A table as it is, at a snapshot, of a branch or tag, or at a time in milliseconds."""
    return _table(spark, "iceberg", table, {"snapshot-id": snapshot_id, "branch": branch, "tag": tag, "as-of-timestamp": as_of_timestamp}, options)


def read_deltalake(spark: SparkSession, table: str, version: int | None = None, timestamp: str | None = None, **options) -> Frame:
    return _table(spark, "delta", table, {"versionAsOf": version, "timestampAsOf": timestamp}, options)


def read_hudi(spark: SparkSession, table_uri: str, as_of_instant: str | None = None, **options) -> Frame:
    return _table(spark, "hudi", table_uri, {"as.of.instant": as_of_instant}, options)


def read_paimon(spark: SparkSession, path: str, snapshot_id: int | None = None, tag: str | None = None, **options) -> Frame:
    return _table(spark, "paimon", path, {"scan.snapshot-id": snapshot_id, "scan.tag-name": tag}, options)


def read_lance(spark: SparkSession, url: str, version: int | None = None, **options) -> Frame:
    return _table(spark, "lance", url, {"version": version}, options)


def read_huggingface(spark: SparkSession, repo: str, **options) -> Frame:
    """Parquet files of a dataset, where the hf:// filesystem is set up."""
    return Frame(spark.read.options(**options).parquet(f"hf://datasets/{repo}/**/*.parquet"))


class _Piece(InputPartition):
    def __init__(self, at: int):
        self.at = at


class _Generated(DataSourceReader):
    def __init__(self, makers: list[Callable]):
        self.makers = makers

    def partitions(self) -> list[InputPartition]:
        return [_Piece(k) for k in _range(len(self.makers))]

    def read(self, part: _Piece):
        yield from self.makers[part.at]()


def read_generator(spark: SparkSession, makers: list[Callable], schema: str) -> Frame:
    """One task for each function, which yields tuples or Arrow batches."""

    class Generator(DataSource):
        @classmethod
        def name(cls) -> str:
            return "loom_generator"

        def schema(self) -> str:
            return schema

        def reader(self, schema):
            return _Generated(makers)

    spark.dataSource.register(Generator)
    return Frame(spark.read.format("loom_generator").load())


def read_source(spark: SparkSession, source: type[DataSource], **options) -> Frame:
    """A user's Python data source."""
    spark.dataSource.register(source)
    return Frame(spark.read.format(source.name()).options(**options).load())


def read_mcap(spark: SparkSession, path) -> Frame:
    """Messages of MCAP logs: topic, time and bytes (needs the mcap package on executors)."""

    def run(batches):
        import io

        import pandas as pd
        from mcap.reader import make_reader

        for batch in batches:
            for content in batch["content"]:
                rows = [(c.topic, m.log_time, m.publish_time, m.sequence, m.data) for _, c, m in make_reader(io.BytesIO(content)).iter_messages()]
                yield pd.DataFrame(rows, columns=["topic", "log_time", "publish_time", "sequence", "data"])

    return Frame(spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "topic string, log_time long, publish_time long, sequence long, data binary"))


def read_video_frames(spark: SparkSession, path) -> Frame:
    """Frames of videos as RGB images (needs PyAV on executors)."""

    def run(batches):
        import io

        import av
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with av.open(io.BytesIO(content)) as video:
                    for k, frame in enumerate(video.decode(video=0)):
                        p = frame.to_ndarray(format="rgb24")
                        yield pd.DataFrame([(name, k, frame.time, p.shape[0], p.shape[1], p.tobytes())], columns=["path", "frame_index", "frame_time", "height", "width", "data"])

    return Frame(spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, frame_index long, frame_time double, height int, width int, data binary"))


def range(spark: SparkSession, start: int, end: int | None = None, step: int = 1, partitions: int | None = None) -> Frame:  # noqa: A001
    return Frame(spark.range(start, end, step, partitions) if end is not None else spark.range(0, start, step, partitions))


def from_pylist(spark: SparkSession, rows: list[dict], schema=None) -> Frame:
    return Frame(spark.createDataFrame(pa.Table.from_pylist(rows)) if schema is None else spark.createDataFrame(rows, schema))


def from_pydict(spark: SparkSession, data: dict) -> Frame:
    return Frame(spark.createDataFrame(pa.table(data)))


def from_arrow(spark: SparkSession, table: pa.Table) -> Frame:
    return Frame(spark.createDataFrame(table))


def from_pandas(spark: SparkSession, data) -> Frame:
    return Frame(spark.createDataFrame(data))
