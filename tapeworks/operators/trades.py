"""Trades: gcd scales, time and price runs, quantity dictionary, stream sizes, and the way back.

Every figure belongs to one chunk of CHUNK_RECORDS records, so records are dealt out once by (session, chunk) and each
chunk goes through one numpy kernel; nothing is joined back. The logical encoding is a row of arrays for each chunk and
is decoded where it stands, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.chunk import TradesChunk
from ..functions.sequence import KEY, chunked
from ..schema import CHUNK_RECORDS

_HEAD = "session_id string, chunk long, "


def _longs(names: str) -> str:
    return _HEAD + ", ".join(f"{c} long" for c in names.split())


def _each(trades: DataFrame, columns, schema: str) -> DataFrame:
    """Rows of ``columns(chunk)`` for each chunk."""

    def run(t: pa.Table) -> pa.Table:
        c = TradesChunk(t)
        return c.rows(columns(c))

    rows = chunked(trades.select("session_id", "seq", "price_e8", "qty_e8", "side", "ts_ns"))
    return rows.groupBy(*KEY).applyInArrow(run, schema)


def scales(trades: DataFrame) -> DataFrame:
    """Per chunk: records, base time and price, and the price, quantity and time scales."""
    one = lambda c: {"records": c.records, "base_ts": c.ts[0], "base_price": c.price[0], "price_scale": c.price_scale, "qty_scale": c.qty_scale, "time_scale": c.time_scale}
    return _each(trades, one, _longs("records base_ts base_price price_scale qty_scale time_scale"))


def price_groups(trades: DataFrame) -> DataFrame:
    """Per price group: records, side, price tick, its zigzag delta to the group before and the flag bits."""
    return _each(trades, lambda c: c.price_groups, _longs("pg tg n side price_tick dp dp_zigzag dp_zero count_one"))


def time_groups(trades: DataFrame) -> DataFrame:
    """Per time group: records, price groups, time unit and its delta to the group before."""
    return _each(trades, lambda c: c.time_groups, _longs("tg n price_groups ts_unit dt price_group_count_one"))


def quantity_ranks(trades: DataFrame) -> DataFrame:
    """Histogram of quantity lots by chunk, ranked by count downwards, then lot."""
    return _each(trades, lambda c: c.ranks, _longs("lot n rank"))


def capacity_costs(trades: DataFrame) -> DataFrame:
    """Cost of each dictionary capacity by chunk: code bytes, escape bytes, two bytes an entry and one an escape."""
    return _each(trades, lambda c: c.costs, _longs("capacity records hot escapes escape_bytes bits cost"))


def hot_capacity(trades: DataFrame) -> DataFrame:
    """The cheapest capacity of each chunk; of equal costs the smallest."""
    names = "capacity bits hot escapes escape_bytes cost"
    return _each(trades, lambda c: {n: c.best[n] for n in names.split()}, _longs(names))


def hot_dictionary(trades: DataFrame) -> DataFrame:
    """Entries of each chunk's dictionary in code order."""
    return _each(trades, lambda c: c.dictionary, _longs("code lot n"))


def quantity_codes(trades: DataFrame) -> DataFrame:
    """Dictionary code of every record, the capacity itself for an escape, and the escaped lot."""

    def columns(c: TradesChunk) -> dict:
        code, escape = c.codes
        return {"seq": c.seq, "code": code, "escape_lot": pa.array(c.qty // c.qty_scale, mask=~escape)}

    return _each(trades, columns, _longs("seq code escape_lot"))


_SIZES = "records price_groups dp_zero_count count_one_count price_bytes time_groups price_group_count_one_count time_bytes hot_bits qty_escapes qty_escape_bytes hot_table_bytes flag_bytes pgc1_bytes qty_code_bytes payload_bytes"


def stream_sizes(trades: DataFrame) -> DataFrame:
    """Bytes of the nine encoded streams of each chunk."""
    return _each(trades, lambda c: c.sizes, _longs(_SIZES))


def _line_bytes(c: TradesChunk) -> int:
    """Bytes of the chunk's canonical lines: digits and signs, three commas, two brackets and a line feed."""
    digits = lambda v: np.char.str_len(v.astype(str)).sum()
    return int(digits(c.price) + digits(c.qty) + digits(c.side) + digits(c.ts)) + 6 * c.records


def stats(trades: DataFrame) -> DataFrame:
    """Per session: counts, byte totals and bytes a trade of the artifact."""
    more = "line_bytes price_scale qty_scale time_scale"
    rows = _each(trades, lambda c: {**c.sizes, "line_bytes": _line_bytes(c), "price_scale": c.price_scale, "qty_scale": c.qty_scale, "time_scale": c.time_scale}, _longs(f"{_SIZES} {more}"))
    total = lambda c: F.sum(c).alias(c)
    first = lambda c: F.min_by(c, "chunk").alias(f"first_{c}")
    out = rows.groupBy("session_id").agg(
        F.sum("records").alias("record_count"), F.count("*").alias("chunk_count"), total("time_groups"), total("price_groups"), total("qty_escapes"), total("dp_zero_count"),
        total("count_one_count"), total("price_group_count_one_count"), total("hot_table_bytes"), total("time_bytes"), total("price_bytes"), total("flag_bytes"), total("pgc1_bytes"),
        total("qty_code_bytes"), total("qty_escape_bytes"), (96 + F.sum(F.col("payload_bytes") + 160)).alias("encoded_bytes"),
        F.sum("line_bytes").alias("input_bytes"), first("price_scale"), first("qty_scale"), first("time_scale"),
    )
    return out.withColumn("bytes_per_trade", S.ratio(F.col("encoded_bytes"), F.col("record_count")))


_SCALARS = "base_ts base_price price_scale qty_scale time_scale capacity".split()
_ARRAYS = "dt tg_groups dp pg_n pg_side dictionary code escape_lot".split()


def encode(trades: DataFrame) -> DataFrame:
    """The logical encoding, one row for each chunk: bases and scales, and the deltas, counts, codes and escapes as arrays."""

    def columns(c: TradesChunk) -> dict:
        code, escape = c.codes
        p, t = c.price_groups, c.time_groups
        scalars = (c.ts[0], c.price[0], c.price_scale, c.qty_scale, c.time_scale, c.best["capacity"])
        arrays = (t["dt"], t["price_groups"], p["dp"], p["n"], p["side"], c.dictionary["lot"], code, (c.qty // c.qty_scale)[escape])
        return {**dict(zip(_SCALARS, scalars)), **{n: pa.array([v], pa.list_(pa.int64())) for n, v in zip(_ARRAYS, arrays)}}

    return _each(trades, columns, _longs(" ".join(_SCALARS)) + ", " + ", ".join(f"{c} array<long>" for c in _ARRAYS))


def decode_chunks(encoded: DataFrame) -> DataFrame:
    """Records rebuilt from the logical encoding alone: prefix sums of deltas, dictionary look-ups and escapes."""
    order = ["session_id", "chunk", *_SCALARS, *_ARRAYS]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                session, chunk, *scalars = (b.column(j)[i].as_py() for j in range(2 + len(_SCALARS)))
                base_ts, base_price, ps, qs, tsx, capacity = scalars
                dt, groups, dp, n, side, table, code, escapes = (b.column(2 + len(_SCALARS) + j)[i].values.to_numpy() for j in range(len(_ARRAYS)))
                price = np.repeat((base_price // ps + np.cumsum(dp)) * ps, n)
                ends = np.cumsum(n)
                per_time = np.diff(np.concatenate([[0], ends[np.cumsum(groups) - 1]]))
                ts = np.repeat((base_ts // tsx + np.cumsum(dt)) * tsx, per_time)
                escape = code == capacity
                lot = np.empty(len(code), np.int64)
                lot[~escape] = table[code[~escape]]
                lot[escape] = escapes
                seq = chunk * CHUNK_RECORDS + np.arange(len(code))
                columns = [pa.array([session] * len(code)), *map(pa.array, (seq, price, lot * qs, np.repeat(side, n), ts))]
                yield pa.RecordBatch.from_arrays(columns, ["session_id", "seq", "price_e8", "qty_e8", "side", "ts_ns"])

    return encoded.select(*order).mapInArrow(run, "session_id string, seq long, price_e8 long, qty_e8 long, side long, ts_ns long")


def decode(trades: DataFrame) -> DataFrame:
    """Records after a way through the logical encoding."""
    return decode_chunks(encode(trades))
