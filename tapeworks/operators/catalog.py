"""Pipelines: representation, transform and entropy stage by id, with availability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.kernels import PROFILES
from ..schema import TapeError
from .blocks import CODECS

COLUMNS = ["pipeline_id", "stream_scope", "representation", "transform", "entropy", "profile", "availability", "reason", "slug", "extension"]

#: Fixed values of the formats: names of the representations, transforms, slugs and extensions, here and in ``rows``. Ids of
#: transforms start with the engine's own family name.
_TRANSFORMS = [
    ("trades", "trades_grouped_delta_qtydict", "grouped_delta_qtydict", "gcd_scaled_timestamp_price_groups_bitflags_pgc1_qtydict", "math_v3"),
    ("bookticker", "bookticker_delta_mask", "delta_mask", "base_state_bid_spread_packed_change_mask_zigzag", "v2"),
    ("depth", "depth_ladder_offset", "ladder_offset", "side_runs_first_offset_gaps_delete_side_hotqty", "v3"),
]
_PROFILE = {"zstd": "archive", "raw": "research", "lz4": "live", "brotli": "archive", "xz": "archive", "gzip": "archive"}


def rows() -> list[tuple]:
    out = []
    for name in ("zstd", "raw", "lz4", "brotli", "xz", "gzip"):
        ok = CODECS[name].available
        out.append((f"std.{name}_jsonl_blocks_v1", "all", "jsonl_blocks", "raw_jsonl", "none" if name == "raw" else name, _PROFILE[name], "available" if ok else "dependency_unavailable", "" if ok else f"{name} module is not installed", "raw-jsonl" if name == "raw" else name, ".hfr" if name == "raw" else ".hfc"))
    for stream, base, representation, transform, version in _TRANSFORMS:
        out.append((f"tick.{base}_{version}", stream, representation, transform, "none", "replay", "available", "", f"{base}-{version}".replace("_", "-"), ".cxcef"))
    for stream, base, representation, transform, _ in _TRANSFORMS:
        for p in PROFILES:
            out.append((f"tick.{base}_{p}_v1", stream, f"{representation}_entropy", transform, p, "archive", "available", "", f"{base}-{p}".replace("_", "-"), ".cxcef"))
    for codec in ("zstandard", "lz4", "lzma"):
        out.append((f"py.{codec}_jsonl_v1", "all", "jsonl_blocks", "raw_jsonl", codec, "research", "not_implemented", "python lab runner is planned", f"py-{codec}", ""))
    planned = [("delta_varint", "delta_varint", "none", "live", "transform"), ("delta_zstd", "delta", "zstd", "archive", "delta pipeline"), ("columnar_delta_zstd", "columnar_delta", "zstd", "archive", "columnar pipeline"), ("delta_lz4", "delta", "lz4", "live", "lz4 pipeline")]
    for kind, transform, entropy, profile, what in planned:
        for short, stream in (("trade", "trades"), ("l1", "bookticker"), ("depth", "depth")):
            form = f"{short}_columnar" if kind.startswith("columnar") else f"{short}_delta"
            out.append((f"{short}.{kind}_v1", stream, form, transform, entropy, profile, "not_implemented", f"{short} {what} is planned", f"{short}-{kind}".replace("_", "-"), ""))
    return out


def frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), ", ".join(f"{c} string" for c in COLUMNS))


def find(pipeline_id: str) -> dict:
    """The descriptor of an id that can run; otherwise the status says why not."""
    for row in rows():
        if row[0] == pipeline_id:
            found = dict(zip(COLUMNS, row))
            if found["availability"] != "available":
                raise TapeError(found["availability"], found["reason"])
            return found
    raise TapeError("unsupported_pipeline", pipeline_id)

