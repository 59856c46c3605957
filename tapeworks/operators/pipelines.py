"""Whole pipelines by id: compress sessions to files, decode and verify them, with results and JSON reports.

A backend says how a family of pipelines encodes canonical lines to files and reads files back to lines; the gate on
availability and the place of each file come from the catalogue.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timing import Clock
from ..schema import BLOCK_BYTES, LEAST_BLOCK_BYTES, STREAMS, TapeError
from ..sources import files
from . import artifacts, blocks, catalog, metrics, verify

RESULT = ["session_id", "path", "input_bytes", "output_bytes", "line_count", "block_count"]


@dataclass(frozen=True)
class Backend:
    """``encode(lines, stream, descriptor, root, level, block_bytes)`` writes files and returns RESULT rows; ``decode(spark, path, extension)`` gives lines."""

    encode: Callable[..., DataFrame]
    decode: Callable[[SparkSession, str, str], DataFrame]


def _encode_blocks(lines: DataFrame, stream: str, d: dict, root: str, level: int, block_bytes: int) -> DataFrame:
    name = d["pipeline_id"].split(".")[1].removesuffix("_jsonl_blocks_v1")
    size = max(block_bytes, LEAST_BLOCK_BYTES)
    packed = blocks.compress_blocks(lines, name, level, size)
    # The writer compares each block with what comes back from it.
    checked = packed.withColumn("payload", F.when(F.col("roundtrip_ok"), F.col("payload")).otherwise(F.raise_error(F.lit("decode_error: roundtrip check failed"))))
    return files.write_containers(checked, root, d["slug"], d["extension"], stream, blocks.codec(name).wire_id, size)


def _encode_artifact(lines: DataFrame, stream: str, d: dict, root: str, level: int, block_bytes: int) -> DataFrame:
    made = artifacts.encode(lines, stream, None if d["entropy"] == "none" else d["entropy"])
    counts = lines.groupBy("session_id").agg(F.count("*").alias("line_count"), F.sum(F.octet_length("line") + 1).cast("long").alias("input_bytes"))
    written = files.write_artifacts(made, root, d["slug"], d["extension"], stream)
    return written.join(counts, "session_id").withColumn("block_count", F.lit(1).cast("long")).select(*RESULT)


def _decode_artifact(spark: SparkSession, path: str, extension: str) -> DataFrame:
    return artifacts.decode_lines(files.scan(spark, path, f"*{extension}"))


_BLOCKS = Backend(_encode_blocks, lambda spark, path, extension: files.lines_of_blocks(files.read_blocks(spark, path)))
_ARTIFACT = Backend(_encode_artifact, _decode_artifact)


def backend(pipeline_id: str) -> tuple[dict, Backend]:
    """Descriptor and backend of an id that can run; the error says why another cannot."""
    d = catalog.find(pipeline_id)
    return d, _BLOCKS if d["representation"] == "jsonl_blocks" else _ARTIFACT


def compress(lines: DataFrame, stream: str, pipeline_id: str, root: str, level: int = 3, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Writes ``<root>/<slug>/sessions/<session>/<stream><ext>`` for each session of ``lines(session_id, seq, line)``. A row for each,
    with the rates of the whole run, and a ``.metrics.json`` beside each file."""
    if stream not in STREAMS:
        raise TapeError("unsupported_stream", stream)
    d, b = backend(pipeline_id)
    if d["stream_scope"] not in ("all", stream):
        raise TapeError("unsupported_stream", f"{pipeline_id} takes {d['stream_scope']}")
    spark, clock = lines.sparkSession, Clock()
    out = b.encode(lines, stream, d, root, level, block_bytes)
    # One row for each file that was written: the run is over when they are here.
    done = spark.createDataFrame(out.select(*RESULT).collect(), ", ".join(f"{c} {'string' if c in ('session_id', 'path') else 'long'}" for c in RESULT))
    spent = F.lit(clock.lap())
    rows = done.withColumn("pipeline_id", F.lit(pipeline_id)).withColumn("profile", F.lit(d["profile"])).withColumn("stream", F.lit(stream)).withColumn("status", F.lit("ok")).withColumn("roundtrip_ok", F.lit(True))
    rows = metrics.with_rates(rows.withColumn("encode_ns", spent).withColumn("decode_ns", F.lit(0).cast("long")))
    files.write_json(rows, "path", ".metrics.json").collect()
    return rows


def decode(spark: SparkSession, root: str, pipeline_id: str) -> DataFrame:
    """session_id, seq, line of all files of a pipeline below ``root``."""
    d, b = backend(pipeline_id)
    return b.decode(spark, f"{root.rstrip('/')}/{d['slug']}", d["extension"])


def decode_and_verify(canonical: DataFrame, stream: str, pipeline_id: str, root: str, mode: str = "both", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """verify.summary of all files of a pipeline below ``root`` against canonical lines, with a ``.verify.json`` beside each file.
    The replay multiplier is the market time of a session over the time of the whole run."""
    spark, clock = canonical.sparkSession, Clock()
    d, _ = backend(pipeline_id)
    found = verify.summary(canonical, decode(spark, root, pipeline_id), stream, mode, block_bytes)
    done = spark.createDataFrame(found.collect(), found.schema)  # a row for each session
    spent = clock.lap()
    path = F.concat(F.lit(f"{root.rstrip('/')}/{d['slug']}/sessions/"), "session_id", F.lit(f"/{stream}{d['extension']}"))
    rows = done.withColumn("pipeline_id", F.lit(pipeline_id)).withColumn("stream", F.lit(stream)).withColumn("decode_ns", F.lit(spent)).withColumn("path", path)
    rows = rows.withColumn("replay_multiplier", F.col("replay_time_span_ns") / F.lit(float(spent)))
    files.write_json(rows, "path", ".verify.json").collect()
    return rows
