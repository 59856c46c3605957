"""Blocks of JSONL text: byte layout, replay batches, and general-purpose codecs block by block."""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.kernels import crc32c
from ..functions.sequence import chunked, prefix_sums
from ..schema import BATCH_RECORDS, BLOCK_BYTES, LEAST_BLOCK_BYTES, TapeError


@dataclass(frozen=True)
class CodecSpec:
    """A block codec: its wire id, level range and functions; without functions it is unavailable."""

    name: str
    wire_id: int
    levels: tuple[int, int] = (0, 0)
    compress: Callable[[bytes, int], bytes] | None = None
    decompress: Callable[[bytes], bytes] | None = None

    @property
    def available(self) -> bool:
        return self.compress is not None

    def level(self, wanted: int) -> int:
        return max(self.levels[0], min(self.levels[1], wanted))


def _zstd(raw: bytes, level: int) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(raw)


def _unzstd(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def _gzip(raw: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _optional(module: str):
    import importlib

    try:
        return importlib.import_module(module)
    except ImportError:
        return None


def _codecs() -> dict[str, CodecSpec]:
    out = [
        CodecSpec("zstd", 1, (1, 22), _zstd, _unzstd),
        CodecSpec("xz", 4, (0, 9), lambda b, n: lzma.compress(b, lzma.FORMAT_XZ, lzma.CHECK_CRC64, n), lzma.decompress),
        CodecSpec("gzip", 5, (1, 9), _gzip, lambda b: zlib.decompress(b, 31)),
        CodecSpec("raw", 0, (0, 0), lambda b, n: b, lambda b: b),
        CodecSpec("bz2", 101, (1, 9), lambda b, n: bz2.compress(b, n), bz2.decompress),
        CodecSpec("zlib", 102, (0, 9), zlib.compress, zlib.decompress),
        CodecSpec("lzma", 103, (0, 9), lambda b, n: lzma.compress(b, preset=n), lzma.decompress),
    ]
    lz4, brotli = _optional("lz4.block"), _optional("brotli")
    out.append(CodecSpec("lz4", 2, (0, 0), (lambda b, n: lz4.compress(b)) if lz4 else None, lz4.decompress if lz4 else None))
    out.append(CodecSpec("brotli", 3, (1, 11), (lambda b, n: brotli.compress(b, quality=n)) if brotli else None, brotli.decompress if brotli else None))
    return {c.name: c for c in out}


CODECS = _codecs()


def codec(name: str) -> CodecSpec:
    if name not in CODECS:
        raise TapeError("unsupported_pipeline", name)
    if not CODECS[name].available:
        raise TapeError("dependency_unavailable", name)
    return CODECS[name]


def lines(records: DataFrame, stream: str) -> DataFrame:
    """session_id, seq, line of canonical text."""
    return records.select("session_id", "seq", S.line_of(stream).alias("line"))


def layout(text: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Byte offset of every line (its line feed included) and the blocks it touches. Blocks ignore line ends."""
    block_bytes = max(block_bytes, LEAST_BLOCK_BYTES)
    rows = chunked(text).withColumn("size", F.octet_length("line").cast("long") + 1)
    rows = prefix_sums(rows, {"size": "end"}).withColumn("offset", F.col("end") - F.col("size"))
    return rows.select("session_id", "seq", "line", "size", "offset", F.expr(f"offset div {block_bytes}").alias("first_block"), F.expr(f"(end - 1) div {block_bytes}").alias("last_block"))


def block_table(text: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per block: first byte, bytes and line feeds inside."""
    block_bytes = max(block_bytes, LEAST_BLOCK_BYTES)
    rows = layout(text, block_bytes).withColumn("block", F.explode(F.sequence("first_block", "last_block")))
    start, end = F.greatest(F.col("offset"), F.col("block") * block_bytes), F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block_bytes)
    ends_here = (F.col("last_block") == F.col("block")).cast("long")
    return rows.groupBy("session_id", "block").agg(F.min(start).alias("first_byte_offset"), F.sum(end - start).alias("uncompressed_bytes"), F.sum(ends_here).alias("line_count"))


def pieces(text: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The bytes each line gives to each block it touches: session_id, block, start, piece."""
    block_bytes = max(block_bytes, LEAST_BLOCK_BYTES)
    rows = layout(text, block_bytes).withColumn("raw", F.concat("line", F.lit("\n")).cast("binary")).withColumn("block", F.explode(F.sequence("first_block", "last_block")))
    start = F.greatest(F.col("offset"), F.col("block") * block_bytes)
    end = F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block_bytes)
    rows = rows.withColumn("start", start)
    return rows.select("session_id", "block", "start", F.substring("raw", (F.col("start") - F.col("offset") + 1).cast("int"), (end - F.col("start")).cast("int")).alias("piece"))


def compress_blocks(text: DataFrame, name: str, level: int = 3, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Compressed blocks with sizes and checksums; every block is one independent group."""
    spec = codec(name)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("start")
        raw = b"".join(t.column("piece").to_pylist())
        packed = spec.compress(raw, spec.level(level))
        row = {
            "session_id": t.column("session_id")[0].as_py(), "block": t.column("block")[0].as_py(), "first_byte_offset": t.column("start")[0].as_py(),
            "uncompressed_bytes": len(raw), "compressed_bytes": len(packed), "line_count": raw.count(b"\n"), "uncompressed_crc": crc32c(raw), "compressed_crc": crc32c(packed),
            "payload": packed, "roundtrip_ok": spec.decompress(packed) == raw,
        }
        return pa.Table.from_pylist([row])

    schema = "session_id string, block long, first_byte_offset long, uncompressed_bytes long, compressed_bytes long, line_count long, uncompressed_crc long, compressed_crc long, payload binary, roundtrip_ok boolean"
    return pieces(text, block_bytes).groupBy("session_id", "block").applyInArrow(run, schema)


def replay_batches(text: DataFrame, records: int = BATCH_RECORDS) -> DataFrame:
    """Batches of records: counts, first line number and decoded bytes."""
    rows = text.where(F.length(F.trim("line")) > 0).withColumn("batch", F.expr(f"seq div {records}"))
    return rows.groupBy("session_id", "batch").agg(F.count("*").alias("record_count"), (F.min("seq") + 1).alias("first_line_number"), F.sum(F.octet_length("line") + 1).cast("long").alias("decoded_bytes"))


def time_span(records: DataFrame) -> DataFrame:
    return records.groupBy("session_id").agg(F.greatest(F.max("ts_ns") - F.min("ts_ns"), F.lit(0)).alias("time_span_ns"))


def last_per_key(runs: DataFrame) -> DataFrame:
    """The latest run of each pipeline and stream."""
    rank = F.row_number().over(Window.partitionBy("pipeline_id", "stream").orderBy(F.desc("run_no")))
    return runs.withColumn("_r", rank).where("_r = 1").drop("_r")
