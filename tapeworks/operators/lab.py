"""Lab codecs: whole files through general-purpose compressors, with verification and a report beside each artifact.

The lab's rules are looser than the engine's: any JSON array of the right length is a record, blank lines are skipped,
and a depth level may have more than three elements. Results are ``lab_only`` and never ranked.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.timing import Clock
from ..schema import STREAMS, TapeError
from ..sources import files
from .blocks import CODECS, CodecSpec

MODES = ("byte_exact", "record_exact", "both")


@dataclass(frozen=True)
class LabCodec:
    """One lab codec; ``spec`` does the work and clamps the level."""

    id: str
    slug: str
    extension: str
    spec: CodecSpec

    def compress(self, raw: bytes, level: int) -> bytes:
        return self.spec.compress(raw, self.spec.level(level))

    def decompress(self, raw: bytes) -> bytes:
        try:
            return self.spec.decompress(raw)
        except Exception as e:
            raise TapeError("decode_error", f"{self.id}: {e}") from e


#: Name, block codec and extension of each lab codec.
_KNOWN = (("gzip", "gzip", ".gz"), ("bz2", "bz2", ".bz2"), ("lzma", "lzma", ".xz"), ("zlib", "zlib", ".zlib"), ("brotli", "brotli", ".br"), ("zstandard", "zstd", ".zst"), ("lz4_frame", "lz4", ".lz4"))
REGISTRY = {f"py.{n}_v1": LabCodec(f"py.{n}_v1", f"py-{n}".replace("_", "-"), ext, CODECS[c]) for n, c, ext in _KNOWN}


def find(codec_id: str, require_available: bool = True) -> LabCodec:
    if codec_id not in REGISTRY:
        raise TapeError("unsupported_pipeline", codec_id)
    if require_available and not REGISTRY[codec_id].spec.available:
        raise TapeError("dependency_unavailable", codec_id)
    return REGISTRY[codec_id]


def records(text: bytes, stream: str) -> list:
    """Values of each line under the looser rules; blank lines are skipped, a bad line is corrupt data."""
    if stream not in STREAMS:
        raise TapeError("unsupported_stream", stream)
    side = lambda v: v in (0, 1)
    level = lambda v: isinstance(v, list) and len(v) >= 3 and side(v[2])
    fits = {
        "trades": lambda v: len(v) == 4 and side(v[2]),
        "bookticker": lambda v: len(v) == 5,
        "depth": lambda v: len(v) >= 2 and isinstance(v[-1], int) and all(map(level, v[:-1])),
    }[stream]
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        if not line.strip():
            continue
        try:
            value = json.loads(line)
        except ValueError as e:
            raise TapeError("corrupt_data", f"line {n}: {e}") from e
        if not isinstance(value, list) or not fits(value):
            raise TapeError("corrupt_data", f"line {n}: no {stream} record")
        out.append(value)
    return out


def verify(decoded: bytes, canonical: bytes, stream: str, mode: str = "both") -> dict:
    """Bytes equal, lists of records equal; mismatch is the difference of lengths, or 1 where only content differs."""
    if mode not in MODES:
        raise TapeError("invalid_argument", mode)
    by_byte, by_record = mode != "record_exact", mode != "byte_exact"
    same = decoded == canonical
    ours, theirs = (records(decoded, stream), records(canonical, stream)) if by_record else ([], [])
    record_exact = by_record and ours == theirs
    ok = {"byte_exact": same, "record_exact": record_exact, "both": same and record_exact}[mode]
    field = "record" if by_record and not record_exact else "byte" if by_byte and not same else ""
    return {
        "ok": ok, "verified": True, "byte_exact": by_byte and same, "record_exact": record_exact, "decoded_record_count": len(ours), "canonical_record_count": len(theirs),
        "mismatch_bytes": 0 if same else abs(len(decoded) - len(canonical)) or 1, "first_mismatch_field": field,
    }


_RESULT = "codec_id string, stream string, session_id string, status string, input_bytes long, output_bytes long, ratio double, encode_ns long, decode_ns long, byte_exact boolean, record_exact boolean, mismatch_bytes long, record_count long, output_path string"


def compress_files(spark: SparkSession, path: str, root: str, codec_id: str, level: int = 6, mode: str = "both") -> DataFrame:
    """Compresses every canonical file at or below ``path`` to ``<root>/<slug>/sessions/<session>/<stream>.pylab<ext>``, verifies it,
    writes its report as JSON beside it, and returns a row for each. One file is held by a task."""
    codec = find(codec_id)

    def run(batches):
        for b in batches:
            for session, stream, raw in zip(*(b.column(i).to_pylist() for i in range(3))):
                clock = Clock()
                packed = codec.compress(raw, level)
                encode_ns = clock.lap()
                back = codec.decompress(packed)
                decode_ns = clock.lap()
                checked = verify(back, raw, stream, mode)
                target = files.target(root, codec.slug, session, stream, f".pylab{codec.extension}")
                files.put(target, iter([packed]))
                row = {
                    "codec_id": codec.id, "stream": stream, "session_id": session, "status": "ok" if checked["ok"] else "verification_failed", "input_bytes": len(raw), "output_bytes": len(packed),
                    "ratio": len(raw) / len(packed) if packed else 0.0, "encode_ns": encode_ns, "decode_ns": decode_ns, "byte_exact": checked["byte_exact"], "record_exact": checked["record_exact"],
                    "mismatch_bytes": checked["mismatch_bytes"], "record_count": checked["canonical_record_count"], "output_path": target,
                }
                report = {**row, **checked, "lab_only": True, "ranked": False, "verify_mode": mode}
                files.put(f"{target}.metrics.json", iter([(json.dumps(report, indent=2) + "\n").encode()]))
                yield pa.RecordBatch.from_pylist([row])

    found = files.scan(spark, path, "*.jsonl").select("session_id", "stream", "artifact")
    return found.mapInArrow(run, _RESULT)


def decode_files(spark: SparkSession, path: str, codec_id: str) -> DataFrame:
    """session_id, stream, text of the lab artifacts at or below ``path``."""
    codec = find(codec_id)

    def run(batches):
        for b in batches:
            texts = [codec.decompress(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary())], ["session_id", "stream", "text"])

    found = files.scan(spark, path, f"*.pylab{codec.extension}").select("session_id", "stream", "artifact")
    return found.mapInArrow(run, "session_id string, stream string, text binary")


def verify_files(spark: SparkSession, artifacts: str, canonical: str, codec_id: str, mode: str = "both") -> DataFrame:
    """Lab artifacts against canonical files of the same session and stream."""
    decoded = decode_files(spark, artifacts, codec_id)
    plain = files.scan(spark, canonical, "*.jsonl").select("session_id", "stream", "artifact")

    def run(batches):
        for b in batches:
            for session, stream, back, raw in zip(*(b.column(i).to_pylist() for i in range(4))):
                x = verify(back, raw, stream, mode)
                yield pa.RecordBatch.from_pylist([{"session_id": session, "stream": stream, "status": "ok" if x["ok"] else "verification_failed", "byte_exact": x["byte_exact"], "record_exact": x["record_exact"], "mismatch_bytes": x["mismatch_bytes"], "first_mismatch_field": x["first_mismatch_field"]}])

    return decoded.join(plain, ["session_id", "stream"]).mapInArrow(run, "session_id string, stream string, status string, byte_exact boolean, record_exact boolean, mismatch_bytes long, first_mismatch_field string")
