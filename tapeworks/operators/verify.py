"""Verification of decoded against canonical text: by record, line by line, and by byte over the whole stream."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.kernels import FNV_START, fnv1a, record_hash
from ..functions.sequence import in_order
from ..schema import BLOCK_BYTES, SCHEMAS, TapeError
from ..sources.jsonl import parse
from .blocks import pieces

MODES = ("byte", "record", "both")


def records(canonical: DataFrame, decoded: DataFrame, stream: str) -> DataFrame:
    """Line n against line n: session_id, line_no and the first differing field, null where they agree.

    Inputs have session_id, seq and line. Field order: time, number of levels, then the named fields.
    """
    side = lambda df, p: parse(df, stream).select("session_id", "seq", F.col("line").alias(f"{p}_line"), *[F.col(c).alias(f"{p}_{c}") for c in SCHEMAS[stream]])
    both = side(canonical, "c").join(side(decoded, "d"), ["session_id", "seq"], "full_outer")
    field = F.when(F.col("c_line").isNull(), F.lit("extra_decoded_record")).when(F.col("d_line").isNull(), "missing_decoded_record")
    field = field.when(F.col("c_ts_ns").isNull(), "canonical_parse").when(F.col("d_ts_ns").isNull(), "decoded_parse").when(F.col("c_ts_ns") != F.col("d_ts_ns"), "ts_ns")
    if stream == "depth":
        field = field.when(F.size("c_levels") != F.size("d_levels"), "field_count").when(F.col("c_levels") != F.col("d_levels"), "levels")
    else:
        for c in SCHEMAS[stream][:-1]:
            field = field.when(F.col(f"c_{c}") != F.col(f"d_{c}"), c)
    return both.select("session_id", (F.col("seq") + 1).alias("line_no"), "c_line", "d_line", "c_ts_ns", "d_ts_ns", field.alias("field"))


def _preview(raw: np.ndarray, at: int) -> str:
    """32 bytes from ``at`` on; quotes, backslashes and what does not print become dots."""
    return "".join(chr(b) if 32 <= b <= 126 and b not in (34, 92) else "." for b in raw[at : at + 32].tolist())


def byte_blocks(canonical: DataFrame, decoded: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Both streams cut at the same byte positions and compared block by block: bytes of each side, differing positions,
    and the first of them with previews. Where one side ends inside a block the other's rest is not compared."""

    def text(t: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(t.sort_by("start").column("piece").to_pylist()), np.uint8)

    def run(some: pa.Table) -> pa.Table:
        c, d = (text(some.filter(pa.compute.equal(some.column("decoded"), side))) for side in (False, True))
        n = min(len(c), len(d))
        wrong = np.flatnonzero(c[:n] != d[:n])
        # A decoded stream that goes on shows its block from the start.
        at = int(wrong[0]) if len(wrong) else 0
        base = some.column("block")[0].as_py() * block_bytes
        shown = bool(len(wrong)) or len(d) > n
        row = {
            "session_id": some.column("session_id")[0].as_py(), "block": some.column("block")[0].as_py(), "canonical_bytes": len(c), "decoded_bytes": len(d), "compared_bytes": n,
            "differing_bytes": len(wrong), "first_offset": base + int(wrong[0]) if len(wrong) else None, "preview_canonical": _preview(c, at) if shown else None, "preview_decoded": _preview(d, at) if shown else None,
        }
        kind = lambda n: pa.string() if n == "session_id" or n.startswith("preview") else pa.int64()
        return pa.table({n: pa.array([v], kind(n)) for n, v in row.items()})

    schema = "session_id string, block long, canonical_bytes long, decoded_bytes long, compared_bytes long, differing_bytes long, first_offset long, preview_canonical string, preview_decoded string"
    side = lambda df, decoded: pieces(df.select("session_id", "seq", "line"), block_bytes).withColumn("decoded", F.lit(decoded))
    return side(canonical, False).unionByName(side(decoded, True)).groupBy("session_id", "block").applyInArrow(run, schema)


def bytes_summary(canonical: DataFrame, decoded: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per session: bytes of each stream, differing positions with the difference in length, and the first of them."""
    rows = byte_blocks(canonical, decoded, block_bytes)
    total = lambda c: F.sum(c).alias(c)
    shown = F.col("preview_canonical").isNotNull()
    first = lambda c: F.min_by(F.when(shown, F.col(c)), F.when(shown, F.col("block"))).alias(c)
    out = rows.groupBy("session_id").agg(*[total(c) for c in ("canonical_bytes", "decoded_bytes", "compared_bytes", "differing_bytes")], F.min("first_offset").alias("first_offset"), first("preview_canonical"), first("preview_decoded"))
    gap = F.abs(F.col("canonical_bytes") - F.col("decoded_bytes"))
    end = F.when(gap > 0, F.least("canonical_bytes", "decoded_bytes"))
    # Where the canonical stream goes on nothing is shown, and the mismatch is one of length.
    kind = F.when(F.col("first_offset").isNotNull() | (F.col("decoded_bytes") > F.col("canonical_bytes")), "byte").when(gap > 0, "length")
    return out.select(
        "session_id", "canonical_bytes", "decoded_bytes", "compared_bytes", (F.col("differing_bytes") + gap).alias("mismatch_bytes"), F.coalesce("first_offset", end, F.lit(0)).alias("first_mismatch_offset"),
        kind.alias("kind"), F.coalesce("preview_canonical", F.lit("")).alias("preview_canonical"), F.coalesce("preview_decoded", F.lit("")).alias("preview_decoded"),
    )


def records_summary(canonical: DataFrame, decoded: DataFrame, stream: str) -> DataFrame:
    """Per session: records of each side that parse, exactness, the first line that differs and its field, and the time span replayed."""
    rows = records(canonical, decoded, stream)
    return rows.groupBy("session_id").agg(
        F.count("c_ts_ns").alias("canonical_record_count"), F.count("d_ts_ns").alias("decoded_record_count"), (F.count("field") == 0).alias("record_exact"),
        F.min(F.when(F.col("field").isNotNull(), F.struct("line_no", "field"))).alias("first"), F.coalesce(F.max("d_ts_ns") - F.min("d_ts_ns"), F.lit(0)).alias("replay_time_span_ns"),
    )


def summary(canonical: DataFrame, decoded: DataFrame, stream: str, mode: str = "both", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per session the whole verification. What a mode leaves out is 0, false or empty; a record's mismatch is named before
    a byte's, records that differ decide the error text, and the percentage is of the longer stream."""
    if mode not in MODES:
        raise TapeError("invalid_argument", mode)
    by_byte, by_record = mode != "record", mode != "byte"
    out = bytes_summary(canonical, decoded, block_bytes) if by_byte else None
    if by_record:
        r = records_summary(canonical, decoded, stream)
        out = out.join(r, "session_id", "full_outer") if by_byte else r
    zero, none = lambda c: F.lit(0).cast("long").alias(c), lambda c: F.lit("").alias(c)
    held = lambda c, on: F.coalesce(F.col(c), F.lit(0)).alias(c) if on else zero(c)
    longer = F.greatest("canonical_bytes", "decoded_bytes") if by_byte else F.lit(0)
    byte_exact = F.coalesce(F.col("mismatch_bytes"), F.lit(0)) == 0 if by_byte else F.lit(False)
    record_exact = F.coalesce("record_exact", F.lit(True)) if by_record else F.lit(False)
    line, field = (F.coalesce("first.line_no", F.lit(0)), F.col("first.field")) if by_record else (zero("x"), F.lit(None).cast("string"))
    differs = (~record_exact if by_record else F.lit(False)) | (~byte_exact if by_byte else F.lit(False))
    error = F.when(~record_exact & F.lit(by_record), "decoded records differ from canonical jsonl").when(differs, "decoded bytes differ from canonical jsonl").otherwise("")
    return out.select(
        "session_id", held("canonical_bytes", by_byte), held("decoded_bytes", by_byte), held("compared_bytes", by_byte), held("mismatch_bytes", by_byte),
        (100 * S.ratio(F.col("mismatch_bytes"), longer) if by_byte else F.lit(0.0)).alias("mismatch_percent"), byte_exact.alias("byte_exact"), record_exact.alias("record_exact"),
        held("canonical_record_count", by_record), held("decoded_record_count", by_record), held("replay_time_span_ns", by_record), held("first_mismatch_offset", by_byte),
        line.cast("long").alias("first_mismatch_line"), F.coalesce(field, F.col("kind") if by_byte else F.lit(None), F.lit("")).alias("first_mismatch_field"),
        *[F.coalesce(c, F.lit("")).alias(c) if by_byte else none(c) for c in ("preview_canonical", "preview_decoded")],
        F.when(differs, "verification_failed").otherwise("ok").alias("status"), error.alias("error"), (~differs).alias("verified"),
    )


def hashes(text: DataFrame, stream: str) -> DataFrame:
    """Ordered FNV-1a hashes of bytes and records of each session, as signed longs. Order decides, so a session is one
    sequence; it is streamed in order, never held."""
    typed = parse(text.select("session_id", "seq", "line"), stream)
    fields = SCHEMAS[stream]

    def signed(h: int) -> int:
        return h - (1 << 64) if h >> 63 else h

    def run(batches):
        at, b, r = None, FNV_START, FNV_START
        row = lambda: pa.RecordBatch.from_pylist([{"session_id": at, "byte_hash": signed(b), "record_hash": signed(r)}])
        for batch in batches:
            for x in batch.to_pylist():
                if x["session_id"] != at:
                    if at is not None:
                        yield row()
                    at, b, r = x["session_id"], FNV_START, FNV_START
                b = fnv1a((x["line"] + "\n").encode(), b)
                if x["ts_ns"] is None:
                    continue
                if stream == "depth":
                    r = record_hash(r, stream, [], x["ts_ns"], [(v["price_e8"], v["qty_e8"], v["side"]) for v in x["levels"]])
                else:
                    r = record_hash(r, stream, [x[c] for c in fields[:-1]], x["ts_ns"])
        if at is not None:
            yield row()

    return in_order(typed, "seq").mapInArrow(run, "session_id string, byte_hash long, record_hash long")

