"""Streams, statuses and record schemas."""

from __future__ import annotations

from pyspark.sql import types as T

STREAMS = ("trades", "bookticker", "depth")
#: Wire ids of the streams.
STREAM_ID = {"trades": 0, "bookticker": 1, "depth": 2}

STATUSES = (
    "ok", "invalid_argument", "io_error", "unsupported_stream", "unsupported_pipeline", "dependency_unavailable",
    "not_implemented", "corrupt_data", "decode_error", "verification_failed", "callback_stopped",
)

CHUNK_RECORDS = 16_384
BATCH_RECORDS = 4_096
BLOCK_BYTES = 1 << 20
LEAST_BLOCK_BYTES = 4_096
HOT_CAPACITIES = (16, 32, 64, 128)
DEPTH_HOT = 64

LEVEL = T.StructType([T.StructField(n, T.LongType()) for n in ("price_e8", "qty_e8", "side")])
SCHEMAS = {
    "trades": ("price_e8", "qty_e8", "side", "ts_ns"),
    "bookticker": ("bid_price_e8", "bid_qty_e8", "ask_price_e8", "ask_qty_e8", "ts_ns"),
    "depth": ("levels", "ts_ns"),
}


class TapeError(Exception):
    """A failure with one of STATUSES."""

    def __init__(self, status: str, message: str = ""):
        super().__init__(f"{status}: {message}" if message else status)
        self.status = status
