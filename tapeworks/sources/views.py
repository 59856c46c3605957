"""Views of one artifact: canonical text, the encoded form as JSON, stream sizes, and statistics.

The encoded form is derived from the decoded records and the stored headers, so a view is only given for an artifact
that decodes fully. Containers have no views but the canonical text; that and unknown views are ``not_implemented``.
"""

from __future__ import annotations

import json
import struct
from itertools import groupby

from ..functions import kernels as K
from ..functions.kernels import PROFILES
from ..operators.depth import Book
from ..schema import TapeError
from . import artifacts as A

CANONICAL = ("canonical-json", "canonical-jsonl")
VIEWS = (*CANONICAL, "encoded-json", "encoded-binary", "stats")
#: Field names of the views below are fixed values of the formats.
#: Depth batches that the encoded view shows.
SHOWN_BATCHES = 128
_STREAMS = {
    "trades": ("hot_qty_table", "time", "price", "side", "dp_zero", "count_one", "price_group_count_one", "qty_code", "qty_escape"),
    "bookticker": ("time", "mask", "bid_delta", "spread_delta", "bid_qty_delta", "ask_qty_delta"),
    "depth": ("batch", "side", "price_mode", "delete_bit", "price", "qty_code", "qty_escape"),
}


def _ratio(a: int, b: int) -> float:
    return a / b if b else 0.0


# ---- trades ----------------------------------------------------------------------------------------------------


def _chunks(data: bytes):
    """(header, offset of the header, stream sizes by name, hot table) of each chunk."""
    at = 96
    while at < len(data):
        c = A._CHUNK.unpack_from(data, at)
        time, price, side, zero, one, single, code, escape, hot = c[16:25]
        sizes = dict(zip(_STREAMS["trades"], (hot, time, price, side, zero, one, single, code, escape)))
        table = K.Varints(data[at + 160 : at + 160 + hot])
        yield c, at, sizes, [table.next() for _ in range(c[14])]
        at += 160 + sum(sizes.values())


def _trade_chunk(c: tuple, table: list[int], rows: list[tuple]) -> list:
    """[[base ts, base price, hot table], time groups], each group [dt, [[dp, side, count, codes], ...]]."""
    ps, qs, ts, cap = c[11], c[12], c[13], 1 << c[15] - 1
    code = {q: i for i, q in reversed(list(enumerate(table)))}
    t0, p0, groups = c[9], c[10], []
    for t, same_time in groupby(rows, key=lambda r: r[3] // ts):
        inside = []
        for (p, s), same in groupby(same_time, key=lambda r: (r[0] // ps, r[2])):
            codes = [code.get(r[1] // qs, cap) for r in same]
            inside.append([p - p0, s, len(codes), codes])
            p0 = p
        groups.append([t - t0, inside])
        t0 = t
    return [[c[7], c[8], table], groups]


def trades_json(data: bytes) -> dict:
    rows, chunks = A.read_trades(data), []
    for c, _, _, table in _chunks(data):
        done = sum(x[1] for x in chunks)
        chunks.append([len(chunks), c[1], _trade_chunk(c, table, rows[done : done + c[1]])])
    schema = {"chunk": "[chunk_index, record_count, encoded]", "encoded": "[[base_ts, base_price, hot_qty], [time_group...]]", "time_group": "[dt, [[dp, side, count, qty_codes]...]]"}
    return {"schema": schema, "chunks": chunks}


def trades_binary(data: bytes) -> str:
    A.check(data)
    chunks = []
    for c, at, sizes, _ in _chunks(data):
        shown = {f"{k}_stream_bytes": n for k, n in sizes.items() if k not in ("hot_qty_table", "price_group_count_one")}
        chunks.append({"chunk": len(chunks), "chunk_header_offset": at, **shown, "checksum": c[28]})
    return json.dumps({"file_header_bytes": 96, "chunks": chunks}, separators=(",", ":")) + "\n"


def trades_stats(data: bytes) -> dict:
    A.check(data)
    h, each = A._TRADES.unpack_from(data), list(_chunks(data))
    first = each[0][0]
    total = lambda i: sum(x[0][i] for x in each)
    size = {f"{k}_bytes" if k == "hot_qty_table" else f"{k}_stream_bytes": sum(x[2][k] for x in each) for k in _STREAMS["trades"]}
    return {
        "pipeline_id": "tick.trades_grouped_delta_qtydict_math_v3", "version": h[1], "record_count": h[8], "chunk_count": h[9], "input_bytes": h[6], "encoded_bytes": h[7],
        "bytes_per_trade": _ratio(h[7], h[8]), "timestamp_group_count": h[10], "price_group_count": h[11], "qty_escape_count": h[12],
        "dp_zero_count": total(25), "count_one_count": total(26), "price_group_count_one_count": total(27),
        "first_chunk_price_scale": first[11], "first_chunk_qty_scale": first[12], "first_chunk_time_scale": first[13], "first_chunk_hot_qty_bits": first[15], **size,
    }


# ---- best bid and ask ------------------------------------------------------------------------------------------


def book_json(data: bytes) -> dict:
    rows, h = A.read_book(data), A._BOOK.unpack_from(data)
    ts, ps, qs = h[6:9]
    units = [(t // ts, b // ps, (a - b) // ps, bq // qs, aq // qs) for b, bq, a, aq, t in rows]
    updates = []
    for i, (row, now) in enumerate(zip(rows, units)):
        dt, *d = (x - y for x, y in zip(now, units[max(i - 1, 0)]))
        mask = sum(1 << k for k, x in enumerate(d) if x)
        updates.append({"dt": dt, "mask": mask, "d": dict(zip(("bid", "spread", "bid_qty", "ask_qty"), d)), "state": list(row)})
    bid, bid_qty, ask, ask_qty, t = rows[0]
    base = {"ts": t, "bid": bid, "spread": ask - bid, "bid_qty": bid_qty, "ask_qty": ask_qty}
    return {"pipeline_id": f"tick.bookticker_delta_mask_v{h[1]}", "record_count": h[5], "base_state": base, "updates": updates}


def book_binary(data: bytes) -> str:
    A.check(data)
    h = A._BOOK.unpack_from(data)
    sizes = zip(("time", "mask", "bid", "spread", "bid_qty", "ask_qty"), h[14:20])
    return f"bookticker_delta_mask_v{h[1]} bytes={len(data)} header=160 " + " ".join(f"{k}={n}" for k, n in sizes) + "\n"


def book_stats(data: bytes) -> dict:
    A.check(data)
    h = A._BOOK.unpack_from(data)
    return {
        "pipeline_id": f"tick.bookticker_delta_mask_v{h[1]}", "version": h[1], "record_count": h[5], "raw_runtime_bytes": 40 * h[5], "encoded_bytes": h[4], "bytes_per_record": _ratio(h[4], h[5]),
        **dict(zip(("mask_nonzero_count", "bid_changed_count", "spread_changed_count", "bid_qty_changed_count", "ask_qty_changed_count"), h[20:25])),
        **{f"{k}_stream_bytes": n for k, n in zip(_STREAMS["bookticker"], h[14:20])},
    }


# ---- depth -----------------------------------------------------------------------------------------------------


def _heads(data: bytes, at: int, size: int, batches: int, runs: bool) -> list[tuple]:
    """(dt, levels, run mode) of each batch, from the batch stream alone."""
    v, out = K.Varints(data[at : at + size]), []
    for _ in range(batches):
        dt, count = v.next(), v.next()
        run = bool(v.next()) if runs else False
        if run:
            v.next(), v.next()
        out.append((dt, count, run))
    return out


def depth_json(data: bytes) -> dict:
    if A.depth_version(data) == 1:
        A.read_depth_v1(data)
        h = A._DEPTH_V1.unpack_from(data)
        heads = _heads(data, 160 + h[19], h[12], h[5], False)
        return {"pipeline_id": "tick.depth_ladder_offset_v1", "batch_count": h[5], "batches": [{"dt": dt, "level_count": n} for dt, n, _ in heads]}
    rows, h = A.read_depth(data), A._DEPTH.unpack_from(data)
    table = list(struct.unpack_from(f"<{h[11]}q", data, 176))
    ps, qs = h[8], h[9]
    book, best, batches = Book(), [0, 0], []
    for (levels, _), (dt, count, run) in zip(rows[:SHOWN_BATCHES], _heads(data, 176 + h[12], h[13], h[5], True)):
        shown = []
        for price, qty, side in levels:
            away = best[0] - price // ps if side == 0 else price // ps - best[1]
            shown.append({"side": side, "price": price // ps, "offset": away if run else 0, "delete": qty == 0, "qty": qty // qs})
        batches.append({"dt": dt, "level_count": count, "mode": "side_runs_offset_gaps" if run else "explicit", "best_before": {"bid": best[0], "ask": best[1]}, "levels": shown})
        for price, qty, side in levels:
            book.apply(side, price // ps, qty)
        best = [best[s] if book.best(s) is None else book.best(s) for s in (0, 1)]
    cut = h[5] > SHOWN_BATCHES
    more = {"truncated": True, "shown_batches": SHOWN_BATCHES} if cut else {"truncated": False}
    return {"pipeline_id": "tick.depth_ladder_offset_v3", "version": h[1], "batch_count": h[5], "hot_qty": {"bid": table[: h[2]], "ask": table[h[2] :]}, "batches": batches, **more}


def depth_binary(data: bytes) -> str:
    version = A.depth_version(data)
    A.check(data)
    names = ("batch", "side", "price_mode", "delete", "price", "qty_code", "qty_escape")
    if version == 1:
        h = A._DEPTH_V1.unpack_from(data)
        sizes, hot, head, names = h[12:19], h[19], 160, tuple("mode" if n == "price_mode" else n for n in names)
    else:
        h = A._DEPTH.unpack_from(data)
        sizes, hot, head = h[13:20], h[12], 176
    return f"depth_ladder_offset_v{version} bytes={len(data)} header={head} hot_qty={hot} " + " ".join(f"{k}={n}" for k, n in zip(names, sizes)) + "\n"


def depth_stats(data: bytes) -> dict:
    A.check(data)
    one = A.depth_version(data) == 1
    h = (A._DEPTH_V1 if one else A._DEPTH).unpack_from(data)
    sizes = {f"{k}_stream_bytes": n for k, n in zip(_STREAMS["depth"], h[12:19] if one else h[13:20]) if one or k != "price_mode"}
    if one:
        counts = {"delete_count": h[20], "offset_price_count": h[22], "absolute_price_count": h[23], "qty_escape_count": h[21]}
    else:
        counts = dict(zip(("delete_count", "qty_escape_count", "run_mode_batch_count", "fallback_batch_count", "offset_price_count", "absolute_price_count"), h[20:26]))
    return {
        "pipeline_id": f"tick.depth_ladder_offset_v{1 if one else 3}", "version": h[1], "batch_count": h[5], "total_level_count": h[6],
        "raw_runtime_bytes": 8 * h[5] + 32 * h[6], "encoded_bytes": h[4], "bytes_per_level": _ratio(h[4], h[6]), **counts, **sizes,
    }


# ---- dispatch --------------------------------------------------------------------------------------------------

_OF = {
    "trades": (trades_json, trades_binary, trades_stats),
    "bookticker": (book_json, book_binary, book_stats),
    "depth": (depth_json, depth_binary, depth_stats),
}


def _envelope(data: bytes, kind: str) -> str:
    if kind == "encoded-json":  # an envelope's encoded form is shown as the canonical text
        return A.decompress(data).decode()
    A.open_envelope(data)
    x = A.inspect(data)
    if kind == "encoded-binary":
        return f"entropy_tick bytes={x['output_bytes']} base_bytes={x['base_bytes']} payload={x['payload_bytes']} entropy={x['entropy']} stream={x['stream']}\n"
    names = ("stream", "entropy", "input_bytes", "base_bytes", "payload_bytes", "output_bytes")
    return json.dumps({"pipeline_family": "entropy_tick", "version": 1, **{k: x[k] for k in names}})


#: Ids that name an artifact, by how they start; older versions are read although no pipeline writes them.
_IDS = {"tick.trades_grouped_delta_qtydict_": "trades", "tick.bookticker_delta_mask_": "bookticker", "tick.depth_ladder_offset_": "depth"}


def view_of(data: bytes, pipeline_id: str, kind: str) -> str:
    """Text of a view by pipeline id; an id that does not fit the artifact is corrupt data, one without views not implemented."""
    if not pipeline_id or not kind:
        raise TapeError("invalid_argument", "pipeline id and view are needed")
    stream = next((s for start, s in _IDS.items() if pipeline_id.startswith(start)), None)
    if stream is None or kind not in VIEWS:
        raise TapeError("not_implemented", f"{pipeline_id} {kind}")
    magic = struct.unpack_from("<I", data)[0] if len(data) >= 4 else 0
    coded = any(f"_{p}_" in pipeline_id for p in PROFILES)
    if coded != (magic == A.ENVELOPE) or (A.inspect(data)["stream"] if coded else A.stream_of(data)) not in (stream, A.STREAM_ID[stream]):
        raise TapeError("corrupt_data", "the artifact is of another pipeline")
    return view(data, kind)


def view(data: bytes, kind: str) -> str:
    """Text of a view, recognised by the artifact's magic."""
    if kind not in VIEWS:
        raise TapeError("not_implemented", kind)
    magic = struct.unpack_from("<I", data)[0] if len(data) >= 4 else 0
    if magic in (A.CONTAINER, A.RAW):
        raise TapeError("not_implemented", "views of containers")
    if kind in CANONICAL:
        return A.decompress(data).decode()
    if magic == A.ENVELOPE:
        return _envelope(data, kind)
    as_json, as_binary, as_stats = _OF[A.stream_of(data)]
    if kind == "encoded-binary":
        return as_binary(data)
    return json.dumps((as_json if kind == "encoded-json" else as_stats)(data))
