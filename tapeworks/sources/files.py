"""Files of artifacts: a Spark data source for block containers, block streams with a bound on memory, and writers.

Paths are local ones on a shared mount or URIs that pyarrow's file systems open (file, hdfs, s3, gs). Inputs that only
Spark can open are read through ``scan``, which holds one whole file in a row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions import scalar as S
from ..functions.sequence import in_order
from ..schema import STREAM_ID, STREAMS, TapeError
from . import artifacts as A

SUFFIXES = (".hfc", ".hfr")
BLOCKS = "path string, session_id string, stream string, codec string, block long, first_byte_offset long, uncompressed_bytes long, compressed_bytes long, line_count long, raw binary"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), path


def listed(path: str, suffixes: tuple[str, ...] = SUFFIXES) -> list[tuple[str, int]]:
    """(path, bytes) of the files at or below a path, in order of path."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise TapeError("io_error", f"{path} does not exist")
    found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted((x.path, x.size) for x in found if x.type == pafs.FileType.File and x.path.endswith(suffixes))


def names_of(path: str) -> tuple[str, str]:
    """Session and stream of an artifact's path: its folder, and its name up to the first dot."""
    *_, folder, name = ["", *path.split("/")]
    return folder, name.split(".")[0]


def block_headers(f: pa.NativeFile, size: int) -> Iterator[tuple[dict, dict]]:
    """(container header, block header) of each block in order; payloads are skipped, so one header is held at a time.
    Everything is checked but the payloads: magic, checksum of the header, sizes, positions, totals and the end."""
    head = f.read(64)
    if len(head) < 64:
        raise A.corrupt("short header")
    top = A.read_head(head)
    at, block, first, lines = 64, 0, 0, 0
    while at < size:
        raw = f.read(32)
        if len(raw) < 32:
            raise A.corrupt("block header")
        b = A.read_block_head(raw, top)
        if b["first_byte_offset"] != first or at + 32 + b["compressed_bytes"] > size:
            raise A.corrupt("block")
        b |= {"block": block, "file_offset": at + 32}
        yield top, b
        first += b["uncompressed_bytes"]
        at += 32 + b["compressed_bytes"]
        lines += b["line_count"]
        block += 1
        f.seek(at)
    if first != top["input_bytes"] or block != top["block_count"] or (top["checked"] and top["output_bytes"] != size):
        raise A.corrupt("totals")


def stream_blocks(path: str) -> Iterator[bytes]:
    """The text of a container block by block; one block is held."""
    system, at = opened(path)
    size = system.get_file_info(at).size
    if size is None:
        raise TapeError("io_error", f"{path} does not exist")
    with system.open_input_file(at) as f:
        for top, b in block_headers(f, size):
            f.seek(b["file_offset"])
            yield A.open_block(f.read(b["compressed_bytes"]), top, b)


def whole_lines(blocks: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Lines of each block, where a line that goes on in the next block is carried there; the last one may lack its end."""
    carry = b""
    for block in blocks:
        *lines, carry = (carry + block).split(b"\n")
        yield [x.removesuffix(b"\r") for x in lines]
    if carry:
        yield [carry.removesuffix(b"\r")]


def record_batches(blocks: Iterator[bytes], stream: str, records: int = 4096) -> Iterator[dict]:
    """Batches of parsed records with the number of their first line; blank lines are skipped, a bad line is corrupt data."""
    if stream not in STREAMS:
        raise TapeError("invalid_argument", stream)
    held: list = []
    first = 1
    for lines in whole_lines(blocks):
        held += A.parse_text(b"\n".join(x for x in lines if x.strip()), stream)
        while len(held) >= records:
            yield {"first_line_number": first, "records": held[:records]}
            held, first = held[records:], first + records
    if held:
        yield {"first_line_number": first, "records": held}


class _Part(InputPartition):
    def __init__(self, path: str, size: int, low: int, high: int):
        self.path, self.size, self.low, self.high = path, size, low, high


_KEPT = {EqualTo: lambda v, x: v == x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x, In: lambda v, x: v in x}


class _Reader(DataSourceReader):
    """A task walks the headers of its file and reads only the blocks that begin in its byte range and pass the filters."""

    PART_BYTES = 128 << 20

    def __init__(self, options):
        self.path, self.payload = options["path"], options.get("payload", "true") == "true"
        self.filters: list[tuple] = []

    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", (None,))
            if type(f) in _KEPT and column in (("block",), ("first_byte_offset",), ("session_id",), ("stream",)):
                self.filters.append((column[0], type(f), f.value))
            else:
                yield f

    def _passes(self, row: dict) -> bool:
        return all(_KEPT[kind](row[c], value) for c, kind, value in self.filters if c in row)

    def partitions(self):
        out = []
        for path, size in listed(self.path):
            session, stream = names_of(path)
            if self._passes({"session_id": session, "stream": stream}):
                out += [_Part(path, size, low, min(low + self.PART_BYTES, size)) for low in range(0, max(size, 1), self.PART_BYTES)]
        return out or [_Part("", 0, 0, 0)]

    def read(self, part):
        if not part.path:
            return
        system = opened(self.path)[0]
        session, _ = names_of(part.path)
        with system.open_input_file(part.path) as f:
            for top, b in block_headers(f, part.size):
                if not part.low <= b["file_offset"] < part.high or not self._passes(b):
                    continue
                raw = None
                if self.payload:
                    f.seek(b["file_offset"])
                    raw = A.open_block(f.read(b["compressed_bytes"]), top, b)
                yield (part.path, session, STREAMS[top["stream"]], top["codec"], b["block"], b["first_byte_offset"], b["uncompressed_bytes"], b["compressed_bytes"], b["line_count"], raw)


class BlockSource(DataSource):
    """``spark.read.format("tape_blocks").load(path)``: one row for each block; option payload=false gives the index alone."""

    @classmethod
    def name(cls) -> str:
        return "tape_blocks"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_blocks(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BlockSource)
    return spark.read.format("tape_blocks").option("payload", str(payload).lower()).load(path)


def lines_of_blocks(blocks: DataFrame) -> DataFrame:
    """session_id, seq, line of containers' text. A block gives the lines that begin in it; each needs only the blocks that
    a line runs through, so pieces are dealt out by the line's number and put together there."""
    texts = blocks.select("session_id", "block", F.split(F.col("raw").cast("string"), "\n").alias("parts"))
    # Line feeds ahead of a block number its lines; one row a block, by session.
    feeds = blocks.select("session_id", "block", (F.size(F.split(F.col("raw").cast("string"), "\n")) - 1).cast("long").alias("n"))
    ahead = Window.partitionBy("session_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = feeds.select("session_id", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).cast("long").alias("base"))
    pieces = texts.join(base, ["session_id", "block"]).select("session_id", "block", "base", F.posexplode("parts").alias("i", "piece"))
    rows = pieces.groupBy("session_id", (F.col("base") + F.col("i")).alias("seq")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), "").alias("line"))
    # What follows the last line feed is a line only if there is something.
    return rows.where(F.col("line") != "").select("session_id", "seq", F.regexp_replace("line", r"\r$", "").alias("line"))


def scan(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """path, session_id, stream, artifact of files that Spark lists and reads whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).load(path)
    parts = F.split("path", "/")
    name = F.split(F.element_at(parts, -1), r"\.")[0]
    stream = F.when(F.lower(name).isin(*STREAMS), F.lower(name)).otherwise("unknown")
    return files.select("path", S.session_of_path(F.col("path")).alias("session_id"), stream.alias("stream"), F.col("content").alias("artifact"))


def target(root: str, slug: str, session: str, stream: str, extension: str) -> str:
    """Where an artifact goes: its pipeline's folder, the session, the channel's name."""
    return f"{root.rstrip('/')}/{slug}/sessions/{session}/{stream}{extension}"


def put(path: str, chunks: Iterator[bytes]) -> int:
    """Writes a file under another name and moves it into place, so a retried task leaves a whole one; its bytes."""
    system, at = opened(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    part, n = f"{at}.{uuid.uuid4().hex}.part", 0
    with system.open_output_stream(part) as f:
        for c in chunks:
            f.write(c)
            n += len(c)
    system.move(part, at)
    return n


def write_containers(packed: DataFrame, root: str, slug: str, extension: str, stream: str, codec_id: int, block_bytes: int) -> DataFrame:
    """Writes one container for each session of ``packed`` (blocks.compress_blocks) and returns a row for each:
    session_id, path, input_bytes, output_bytes, line_count, block_count.

    Totals are added up first, so the header goes out ahead of the blocks, which pass through one at a time.
    """
    raw = codec_id == 0
    totals = packed.groupBy("session_id").agg(F.sum("uncompressed_bytes").alias("input"), F.sum(F.col("compressed_bytes") + 32).alias("body"), F.sum("line_count").alias("lines"), F.count("*").alias("blocks"))
    names = ["session_id", "block", "first_byte_offset", "uncompressed_bytes", "compressed_bytes", "line_count", "uncompressed_crc", "compressed_crc", "payload", "input", "body", "lines", "blocks"]
    ordered = in_order(packed.join(totals, "session_id").select(*names), "block")

    def one(rows: Iterator[dict], first: dict) -> dict:
        def chunks():
            yield A.container_head(codec_id, STREAM_ID[stream], block_bytes, first["input"], 64 + first["body"], first["lines"], first["blocks"])
            for r in rows:
                yield A.block_head(raw, r["uncompressed_bytes"], r["compressed_bytes"], r["line_count"], r["first_byte_offset"], r["uncompressed_crc"], r["compressed_crc"]) + r["payload"]

        path = target(root, slug, first["session_id"], stream, extension)
        size = put(path, chunks())
        return {"session_id": first["session_id"], "path": path, "input_bytes": first["input"], "output_bytes": size, "line_count": first["lines"], "block_count": first["blocks"]}

    def run(batches):
        rows = (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist())
        for _, own in groupby(rows, key=lambda r: r["session_id"]):
            first = next(own)
            yield pa.RecordBatch.from_pylist([one(chain([first], own), first)])

    return ordered.mapInArrow(run, "session_id string, path string, input_bytes long, output_bytes long, line_count long, block_count long")


def write_text(lines: DataFrame, root: str, stream: str) -> DataFrame:
    """Writes ``<root>/<session>/<stream>.jsonl`` for each session of ``lines(session_id, seq, line)``, in order and without
    holding it: session_id, path, output_bytes."""
    ordered = in_order(lines.select("session_id", "seq", "line"), "seq")

    def run(batches):
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(2).to_pylist()))
        for session, own in groupby(rows, key=lambda r: r[0]):
            path = f"{root.rstrip('/')}/{session}/{stream}.jsonl"
            yield pa.RecordBatch.from_pylist([{"session_id": session, "path": path, "output_bytes": put(path, ((line + "\n").encode() for _, line in own))}])

    return ordered.mapInArrow(run, "session_id string, path string, output_bytes long")


def write_json(rows: DataFrame, path: str, suffix: str) -> DataFrame:
    """Writes each row as indented JSON beside the file its column ``path`` names, as ``<stem><suffix>``; hashes are unsigned. Returns the paths."""
    import json

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                fixed = {k: v + (1 << 64) if k.endswith("_hash") and isinstance(v, int) and v < 0 else v for k, v in row.items()}
                target_path = row[path].rsplit(".", 1)[0] + suffix
                put(target_path, iter([(json.dumps(fixed, indent=2) + "\n").encode()]))
                yield pa.RecordBatch.from_pylist([{"path": target_path}])

    return rows.mapInArrow(run, "path string")


def replayed(paths: DataFrame, stream: str, records: int = 4096) -> DataFrame:
    """session_id, batch, record_count, first_line_number, first_ts, last_ts of containers (rows ``path``), each streamed block by block."""

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                session = names_of(path)[0]
                for i, x in enumerate(record_batches(stream_blocks(path), stream, records)):
                    times = [r[-1] for r in x["records"]]
                    yield pa.RecordBatch.from_pylist([{"session_id": session, "batch": i, "record_count": len(times), "first_line_number": x["first_line_number"], "first_ts": min(times), "last_ts": max(times)}])

    return paths.select("path").mapInArrow(run, "session_id string, batch long, record_count long, first_line_number long, first_ts long, last_ts long")


def write_artifacts(artifacts: DataFrame, root: str, slug: str, extension: str, stream: str) -> DataFrame:
    """Writes one file for each row (session_id, artifact): session_id, path, output_bytes."""

    def run(batches):
        for b in batches:
            for session, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                path = target(root, slug, session, stream, extension)
                yield pa.RecordBatch.from_pylist([{"session_id": session, "path": path, "output_bytes": put(path, iter([data]))}])

    return artifacts.select("session_id", "artifact").mapInArrow(run, "session_id string, path string, output_bytes long")

