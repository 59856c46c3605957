"""Artifacts as DataFrame operators: encode sessions, decode artifacts to records, inspect, discover."""

from __future__ import annotations

import json
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coder
from ..functions import kernels as K
from ..functions.sequence import chunked
from ..schema import TapeError
from ..sources import artifacts as A
from ..sources import files
from ..sources import views as V
from ..streaming.run import shared_folder
from . import catalog, depth


def encode(text: DataFrame, stream: str, profile: str | None = None) -> DataFrame:
    """session_id, artifact, input_bytes of each session's canonical text.

    Trades are encoded and checked chunk by chunk, depth slice by slice, and a session only puts its parts together. Quotes are
    one sequence of deltas from a base: there a session is one unit. An entropy envelope is one adaptive code of an artifact.
    """
    made = {"trades": _trades, "bookticker": _quotes, "depth": _depth}[stream](text)
    return (_coded(made, stream, profile) if profile else made).select("session_id", "artifact", "input_bytes")


_MADE = "session_id string, artifact binary, input_bytes long, line_count long"


def _quotes(text: DataFrame) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        raw = "".join(x + "\n" for x in t.column("line").to_pylist()).encode()
        return pa.Table.from_pylist([{"session_id": t.column("session_id")[0].as_py(), "artifact": A.compress(raw, "bookticker"), "input_bytes": len(raw), "line_count": len(t)}])

    return text.select("session_id", "seq", "line").groupBy("session_id").applyInArrow(run, _MADE)


def _depth(text: DataFrame) -> DataFrame:
    """The levels are parsed once, into a table in the shared folder, which the steps of the encoder read."""
    names = ["session_id", "batch", "pos", "ts_ns", "side", "price_e8", "qty_e8", "bytes"]

    def parsed(batches):
        for b in batches:
            sessions, seqs, lines = (b.column(i).to_pylist() for i in range(3))
            raw = "".join(x + "\n" for x in lines).encode()
            rows = A.parse_text(raw, "depth")
            if A.to_text(rows, "depth") != raw:
                raise TapeError("decode_error", "roundtrip check failed")
            out = [(s, n, i, t, *(level[k] for k in (2, 0, 1)), 0 if i else len(x.encode()) + 1) for s, n, x, (levels, t) in zip(sessions, seqs, lines, rows) for i, level in enumerate(levels)]
            kinds = [pa.string(), *[pa.int64()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 8, kinds)], names)

    spark, place = text.sparkSession, f"{shared_folder(text.sparkSession)}/levels"
    schema = "session_id string, " + ", ".join(f"{c} long" for c in names[1:])
    text.select("session_id", "seq", "line").mapInArrow(parsed, schema).write.parquet(place)

    def whole(t: pa.Table) -> pa.Table:
        parts = t.sort_by("slice").to_pylist()
        return pa.Table.from_pylist([{"session_id": parts[0]["session_id"], "artifact": A.depth_artifact(parts), "input_bytes": sum(p["bytes"] for p in parts), "line_count": sum(p["batches"] for p in parts)}])

    return depth.encoded_slices(spark.read.schema(schema).parquet(place)).groupBy("session_id").applyInArrow(whole, _MADE)


def _trades(text: DataFrame) -> DataFrame:
    def chunk(t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        lines = t.column("line").to_pylist()
        raw = "".join(x + "\n" for x in lines).encode()
        rows = A.parse_text(raw, "trades")
        part, counts = A.encode_chunk(rows)
        if A.to_text(A.decode_chunk(part), "trades") != raw:
            raise TapeError("decode_error", "roundtrip check failed")
        row = {"session_id": t.column("session_id")[0].as_py(), "chunk": t.column("chunk")[0].as_py(), "part": part, "counts": list(counts), "records": len(rows), "bytes": len(raw), "first_ts": rows[0][3], "last_ts": rows[-1][3]}
        return pa.Table.from_pylist([row])

    def whole(t: pa.Table) -> pa.Table:
        rows = t.sort_by("chunk").to_pylist()
        if any(a["last_ts"] > b["first_ts"] for a, b in zip(rows, rows[1:])):
            raise TapeError("corrupt_data", "trades out of order")
        size, records = sum(r["bytes"] for r in rows), sum(r["records"] for r in rows)
        data = A.trades_artifact([(r["part"], r["counts"]) for r in rows], records, False, size)
        return pa.Table.from_pylist([{"session_id": rows[0]["session_id"], "artifact": data, "input_bytes": size, "line_count": records}])

    parts = chunked(text.select("session_id", "seq", "line")).groupBy("session_id", "chunk")
    parts = parts.applyInArrow(chunk, "session_id string, chunk long, part binary, counts array<long>, records long, bytes long, first_ts long, last_ts long")
    return parts.groupBy("session_id").applyInArrow(whole, _MADE)


def _coded(made: DataFrame, stream: str, profile: str) -> DataFrame:
    """Artifacts inside entropy envelopes; payloads come from the JVM's coder where there is one."""
    native = coder.register(made.sparkSession, A.ENVELOPE)
    payload = F.call_function("tape_code", F.col("artifact"), F.lit(list(K.PROFILES).index(profile))) if native else F.lit(None).cast("binary")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                session, base, size, lines, packed = (c[i].as_py() for c in b.columns)
                data = A.envelope(base, stream, profile, size, lines) if packed is None else A.enclose(base, packed, stream, profile, size, lines)
                if packed is None and A.open_envelope(data) != base:
                    raise TapeError("decode_error", "roundtrip check failed")
                yield pa.RecordBatch.from_arrays([pa.array([session]), pa.array([data], pa.binary()), pa.array([size], pa.int64()), pa.array([lines], pa.int64())], ["session_id", "artifact", "input_bytes", "line_count"])

    return made.select("session_id", "artifact", "input_bytes", "line_count", payload.alias("payload")).mapInArrow(run, _MADE)


def decode_lines(artifacts: DataFrame) -> DataFrame:
    """session_id, seq, line of every artifact. Transform artifacts are read a few thousand records at a time."""
    native = coder.register(artifacts.sparkSession, A.ENVELOPE)
    inner = F.call_function("tape_open", F.col("artifact")) if native else F.lit(None).cast("binary")

    def texts(data: bytes, base: bytes | None):
        magic = int.from_bytes(data[:4], "little") if len(data) >= 4 else 0
        if magic in (A.CONTAINER, A.RAW):
            index = A.read_index(data)
            blocks = (A.read_block(data, index, b) for b in index["blocks"])
            return ([x.decode() for x in lines] for lines in files.whole_lines(blocks))
        return A.text_flow(A.open_envelope(data, base) if magic == A.ENVELOPE else data)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                session, at = b.column(0)[i].as_py(), 0
                for lines in texts(b.column(1)[i].as_py(), b.column(2)[i].as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([session] * len(lines)), pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines, pa.string())], ["session_id", "seq", "line"])
                    at += len(lines)

    return artifacts.select("session_id", "artifact", inner.alias("inner")).mapInArrow(run, "session_id string, seq long, line string")


def inspect(artifacts: DataFrame) -> DataFrame:
    """Header fields of every artifact as JSON."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([json.dumps(A.inspect(x)) for x in b.column(1).to_pylist()])], ["session_id", "header"])

    return artifacts.select("session_id", "artifact").mapInArrow(run, "session_id string, header string")


def views(artifacts: DataFrame, kind: str, pipeline_id: str | None = None) -> DataFrame:
    """session_id and the text of one view of every artifact, by pipeline id or, without one, by the artifact's own magic:
    canonical-jsonl, encoded-json, encoded-binary or stats."""

    def run(batches):
        for b in batches:
            texts = [V.view_of(x, pipeline_id, kind) if pipeline_id else V.view(x, kind) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["session_id", "view"])

    return artifacts.select("session_id", "artifact").mapInArrow(run, "session_id string, view string")


def places(session_dir: str, stream: str, pipeline_id: str, root: str | None = None) -> list[str]:
    """Where an artifact may lie, first choice first: below the root, in the session's folder, in data folders above it."""
    d = catalog.find(pipeline_id)
    name, session = f"{stream}{d['extension']}", os.path.basename(os.path.normpath(session_dir))
    under = lambda r: [f"{r}/{d['slug']}/sessions/{session}/{name}", f"{r}/sessions/{session}/{name}", f"{r}/{session}/{name}", f"{r}/{name}"]
    out = (under(root) if root else []) + [f"{session_dir}/{name}"]
    above = os.path.dirname(os.path.normpath(session_dir))
    while above and above != os.path.dirname(above):
        out += under(f"{above}/compressedData")
        above = os.path.dirname(above)
    return out


def discover(spark: SparkSession, session_dir: str, stream: str, pipeline_id: str = "std.zstd_jsonl_blocks_v1", root: str | None = None) -> dict:
    """status, found, path and header fields of the first artifact that exists. None is ``found`` false with status ok; one
    that cannot be opened has its own status, one of another stream is corrupt_data."""
    jvm = spark.sparkContext._jvm
    for place in places(session_dir, stream, pipeline_id, root):
        path = jvm.org.apache.hadoop.fs.Path(place)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(path) or not system.getFileStatus(path).isFile():
            continue
        try:
            data = bytes(spark.read.format("binaryFile").load(place).select("content").first()[0])
            head = A.inspect(data)
            if A.STREAM_ID[stream] != (head["stream"] if isinstance(head.get("stream"), int) else A.STREAM_ID[A.stream_of(data)]):
                raise TapeError("corrupt_data", f"not of stream {stream}")
        except TapeError as e:
            return {"status": e.status, "found": False, "path": place, "error": str(e)}
        return {"status": "ok", "found": True, "path": place, **head}
    return {"status": "ok", "found": False, "path": None}


class ReplayDecoder:
    """Batches of records of one artifact through a callback that may stop the replay.

    ``source`` is the artifact's bytes, or the path of a container, which is decoded block by block: what comes after the
    batch that stops it is never read. A transform artifact is one unit.
    """

    def __init__(self, source: bytes | str, stream: str, records: int = 4096):
        if stream not in A.STREAM_ID:
            raise TapeError("invalid_argument", stream)
        self.source, self.stream, self.records = source, stream, records or 4096

    def _blocks(self):
        if isinstance(self.source, str):
            yield from files.stream_blocks(self.source)
        elif len(self.source) >= 4 and int.from_bytes(self.source[:4], "little") in (A.CONTAINER, A.RAW):
            index = A.read_index(self.source)
            yield from (A.read_block(self.source, index, b) for b in index["blocks"])
        else:
            yield A.decompress(self.source)

    def batches(self):
        return files.record_batches(self._blocks(), self.stream, self.records)

    def decode_all(self, callback) -> str:
        for batch in self.batches():
            if callback(batch) is False:
                return "callback_stopped"
        return "ok"
