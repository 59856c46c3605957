"""Binary artifacts: block containers, the three transforms and the entropy envelope.

Layouts are little-endian and fixed by the formats; readers check magic, sizes, checksums and full consumption and
raise ``corrupt_data``. One session's stream is one artifact and one task; sessions run in parallel.
"""

from __future__ import annotations

import math
import struct
from collections import Counter
from itertools import islice

import numpy as np

from ..functions import kernels as K
from ..operators.blocks import CODECS, codec
from ..operators.depth import Book
from ..schema import CHUNK_RECORDS, DEPTH_HOT, HOT_CAPACITIES, LEAST_BLOCK_BYTES, STREAM_ID, TapeError

# Fixed values of the formats.
CONTAINER, RAW, BLOCK, RAW_BLOCK = 0x31434648, 0x31524648, 0x30424648, 0x30524648
TRADES, CHUNK, BOOK, DEPTH, DEPTH_V1, ENVELOPE = 0x46435843, 0x4B484354, 0x4B544243, 0x32454443, 0x50454443, 0x31464845
_CHUNK = struct.Struct("<5I9q15I")
_TRADES = struct.Struct("<I4HI7QI")
_BOOK = struct.Struct("<IHH3Q8q6I5I")
_DEPTH = struct.Struct("<IHH4Q4q9I6I")
_DEPTH_V1 = struct.Struct("<IHH4Q4q14I")
_ENVELOPE = struct.Struct("<I4HI5Q2I")


def corrupt(why: str):
    return TapeError("corrupt_data", why)


def _scale(values) -> int:
    return abs(math.gcd(*values)) or 1


# ---- block containers ------------------------------------------------------------------------------------------


def container_head(codec_id: int, stream_id: int, block_bytes: int, input_bytes: int, output_bytes: int, lines: int, blocks: int) -> bytes:
    """The 64 bytes ahead of the blocks, with their own checksum; codec 0 is the raw layout."""
    totals = (input_bytes, output_bytes, lines, blocks)
    if codec_id == 0:
        head = lambda crc: struct.pack("<I2HI4QI", RAW, 1, stream_id, block_bytes, *totals, crc).ljust(64, b"\0")
    else:
        head = lambda crc: struct.pack("<I4HI4QI", CONTAINER, 2, codec_id, stream_id, 0, block_bytes, *totals, crc).ljust(64, b"\0")
    return head(K.crc32c(head(0)))


def block_head(raw: bool, size: int, packed: int, lines: int, offset: int, crc: int, packed_crc: int) -> bytes:
    if raw:
        return struct.pack("<4IQ2I", RAW_BLOCK, size, lines, 0, offset, crc, 0)
    return struct.pack("<4I2Q", BLOCK, size, packed, lines, offset, packed_crc | crc << 32)


def write_container(text: bytes, stream: str, name: str, level: int = 3, block_bytes: int = 1 << 20) -> bytes:
    """A container of independent blocks; ``raw`` has its own layout."""
    spec, size = codec(name), max(block_bytes, LEAST_BLOCK_BYTES)
    body = bytearray()
    count = 0
    for at in range(0, len(text), size):
        raw = text[at : at + size]
        lines = raw.count(b"\n") + (at + size >= len(text) and not raw.endswith(b"\n"))
        packed = spec.compress(raw, spec.level(level))
        body += block_head(name == "raw", len(raw), len(packed), lines, at, K.crc32c(raw), K.crc32c(packed)) + packed
        count += 1
    lines = text.count(b"\n") + (bool(text) and not text.endswith(b"\n"))
    return container_head(spec.wire_id, STREAM_ID[stream], size, len(text), 64 + len(body), lines, count) + bytes(body)


def read_head(data: bytes) -> dict:
    """The checked header of a container. Version 1 has no checksums."""
    magic = struct.unpack_from("<I", data)[0]
    if magic == RAW:
        _, version, stream, size, *totals, crc = struct.unpack_from("<I2HI4QI", data)
        name, checked, at_crc = "raw", True, 44
    elif magic == CONTAINER:
        _, version, wire, stream, _, size, *totals, crc = struct.unpack_from("<I4HI4QI", data)
        name = next((c.name for c in CODECS.values() if c.wire_id == wire and wire), None)
        checked, at_crc = version >= 2, 48
        if name is None:
            raise corrupt("codec id")
    else:
        raise corrupt("magic")
    if checked and K.crc32c(data[:at_crc] + b"\0\0\0\0" + data[at_crc + 4 : 64]) != crc:
        raise corrupt("header checksum")
    if stream not in STREAM_ID.values():
        raise corrupt("stream id")
    return {"codec": name, "version": version, "stream": stream, "block_bytes": size, "input_bytes": totals[0], "output_bytes": totals[1], "line_count": totals[2], "block_count": totals[3], "checked": checked}


def read_block_head(data: bytes, top: dict) -> dict:
    """Sizes, position and checksums of a block; its magic and its size against the container's are checked."""
    if top["codec"] == "raw":
        m, raw, lines, _, offset, crc_raw, _ = struct.unpack("<4IQ2I", data)
        packed, crcs, magic = raw, (crc_raw, crc_raw), RAW_BLOCK
    else:
        m, raw, packed, lines, offset, both = struct.unpack("<4I2Q", data)
        crcs, magic = (both & 0xFFFFFFFF, both >> 32), BLOCK
    if m != magic or raw > top["block_bytes"]:
        raise corrupt("block")
    return {"first_byte_offset": offset, "uncompressed_bytes": raw, "compressed_bytes": packed, "line_count": lines, "compressed_crc": crcs[0], "uncompressed_crc": crcs[1]}


def open_block(packed: bytes, top: dict, b: dict) -> bytes:
    """The text of a block, checked before and after decompression."""
    if top["checked"] and K.crc32c(packed) != b["compressed_crc"]:
        raise corrupt("payload checksum")
    try:
        raw = codec(top["codec"]).decompress(packed)
    except TapeError:
        raise
    except Exception as e:
        raise TapeError("decode_error", str(e)) from e
    if len(raw) != b["uncompressed_bytes"] or (top["checked"] and K.crc32c(raw) != b["uncompressed_crc"]):
        raise corrupt("block checksum")
    return raw


def read_index(data: bytes) -> dict:
    """Header and block index of a container, fully checked but not decompressed."""
    import pyarrow as pa

    from .files import block_headers

    if len(data) < 64:
        raise corrupt("short header")
    blocks = [b for _, b in block_headers(pa.BufferReader(data), len(data))]
    return {k: v for k, v in read_head(data).items() if k not in ("output_bytes", "block_count")} | {"blocks": blocks}


def read_block(data: bytes, index: dict, b: dict) -> bytes:
    return open_block(data[b["file_offset"] : b["file_offset"] + b["compressed_bytes"]], index, b)


def read_container(data: bytes) -> bytes:
    index = read_index(data)
    return b"".join(read_block(data, index, b) for b in index["blocks"])


# ---- trades ----------------------------------------------------------------------------------------------------


def hot_table(lots: list[int]) -> tuple[int, list[int]]:
    """Cheapest capacity and its entries."""
    ranked = [q for q, _ in sorted(Counter(lots).items(), key=lambda x: (-x[1], x[0]))]
    counts, best = Counter(lots), None
    for cap in HOT_CAPACITIES:
        rest = ranked[cap:]
        escapes = sum(counts[q] for q in rest)
        cost = -(-len(lots) * cap.bit_length() // 8) + sum(len(K.put_varints([q])) * counts[q] for q in rest) + 2 * min(cap, len(ranked)) + escapes
        if best is None or cost < best[0]:
            best = (cost, cap)
    return best[1], ranked[: best[1]]


def _write_chunk(rows: list[tuple]) -> tuple[bytes, tuple]:
    price, qty, side, ts = zip(*rows)
    ps, qs, ts_scale = _scale(price), _scale(qty), _scale(ts)
    lots = [q // qs for q in qty]
    cap, table = hot_table(lots)
    code = {q: i for i, q in enumerate(table)}
    times, prices, sides, zero, one, single = [], [], [], [], [], []
    last_t, last_p, i, n = ts[0] // ts_scale, price[0] // ps, 0, len(rows)
    while i < n:
        t, groups = ts[i], 0
        while i < n and ts[i] == t:
            p, s, start = price[i], side[i], i
            while i < n and (ts[i], price[i], side[i]) == (t, p, s):
                i += 1
            dp, count = p // ps - last_p, i - start
            last_p = p // ps
            sides.append(s)
            zero.append(int(dp == 0))
            one.append(int(count == 1))
            if dp:
                prices.append(K.zigzag(dp))
            if count != 1:
                prices.append(count - 2)
            groups += 1
        times.append(t // ts_scale - last_t)
        last_t = t // ts_scale
        single.append(int(groups == 1))
        if groups != 1:
            times.append(groups)
    escapes = [q for q in lots if q not in code]
    streams = [
        K.put_varints(table), K.put_varints(times), K.put_varints(prices), K.put_bits(sides), K.put_bits(zero), K.put_bits(one), K.put_bits(single),
        K.put_bits([code.get(q, cap) for q in lots], cap.bit_length()), K.put_varints(escapes),
    ]
    payload = b"".join(streams)
    hot, time_, price_, side_, zero_, one_, single_, code_, escape_ = map(len, streams)
    head = _CHUNK.pack(
        CHUNK, n, len(single), len(sides), len(escapes), ts[0], ts[-1], ts[0], price[0], ts[0] // ts_scale, price[0] // ps, ps, qs, ts_scale,
        len(table), cap.bit_length(), time_, price_, side_, zero_, one_, single_, code_, escape_, hot, sum(zero), sum(one), sum(single), K.crc32c(payload),
    ).ljust(160, b"\0")
    return head + payload, (len(single), len(sides), len(escapes))


def write_trades(rows: list[tuple], crlf: bool = False, input_bytes: int = 0) -> bytes:
    """Rows of (price, qty, side, ts) in order of time."""
    if not rows or any(p <= 0 or q <= 0 or s not in (0, 1) for p, q, s, _ in rows) or any(a[3] > b[3] for a, b in zip(rows, rows[1:])):
        raise corrupt("trades")
    return trades_artifact([_write_chunk(rows[at : at + CHUNK_RECORDS]) for at in range(0, len(rows), CHUNK_RECORDS)], len(rows), crlf, input_bytes)


def encode_chunk(rows: list[tuple]) -> tuple[bytes, tuple]:
    """One chunk of trades and its counts of time groups, price groups and escapes; order and signs are checked."""
    if not rows or any(p <= 0 or q <= 0 or s not in (0, 1) for p, q, s, _ in rows) or any(a[3] > b[3] for a, b in zip(rows, rows[1:])):
        raise corrupt("trades")
    return _write_chunk(rows)


def decode_chunk(part: bytes) -> list[tuple]:
    return _read_chunk(_CHUNK.unpack_from(part), part[160:])


def trades_artifact(parts: list[tuple[bytes, tuple]], records: int, crlf: bool, input_bytes: int) -> bytes:
    """The artifact of encoded chunks in order."""
    body, chunks = b"".join(p for p, _ in parts), len(parts)
    totals = [sum(c[i] for _, c in parts) for i in range(3)]
    head = lambda crc: _TRADES.pack(TRADES, 3, 0, 2 if crlf else 1, 0, CHUNK_RECORDS, input_bytes, 96 + len(body), records, chunks, *totals, crc).ljust(96, b"\0")
    return head(K.crc32c(head(0))) + body


def _read_chunk(h: tuple, payload: bytes) -> list[tuple]:
    _, n, tgs, pgs, escapes, _, _, _, _, t, p, ps, qs, ts_scale, hot, bits = h[:16]
    time_, price_, side_, zero_, one_, single_, code_, escape_, hot_ = h[16:25]
    parts, at = [], 0
    for size in (hot_, time_, price_, side_, zero_, one_, single_, code_, escape_):
        parts.append(payload[at : at + size])
        at += size
    v = [K.Varints(parts[i]) for i in (0, 1, 2, 8)]
    table = [v[0].next() for _ in range(hot)]
    sides, zero, one = (K.get_bits(x, pgs).tolist() for x in parts[3:6])
    single, codes = K.get_bits(parts[6], tgs).tolist(), K.get_bits(parts[7], n, bits).tolist()
    cap, out, g, used = 1 << bits - 1, [], 0, 0
    for i in range(tgs):
        t += v[1].next()
        for _ in range(1 if single[i] else v[1].next()):
            if g >= pgs:
                raise corrupt("price groups")
            p += 0 if zero[g] else K.unzigzag(v[2].next())
            for _ in range(1 if one[g] else v[2].next() + 2):
                if len(out) >= n:
                    raise corrupt("records")
                c = codes[len(out)]
                if hot <= c < cap or c > cap:
                    raise corrupt("hot code")
                used += c == cap
                out.append((p * ps, (v[3].next() if c == cap else table[c]) * qs, sides[g], t * ts_scale))
            g += 1
    if len(out) != n or g != pgs or used != escapes or not all(x.done for x in v):
        raise corrupt("chunk")
    return out


def trades_flow(data: bytes):
    """The rows of each chunk in order; one chunk is held."""
    if len(data) < 96:
        raise corrupt("short header")
    h = _TRADES.unpack_from(data)
    if h[0] != TRADES or h[1] != 3 or h[7] != len(data) or K.crc32c(_TRADES.pack(*h[:-1], 0).ljust(96, b"\0")) != h[-1]:
        raise corrupt("header")
    at, n = 96, 0
    try:
        while at < len(data):
            c = _CHUNK.unpack_from(data, at)
            size = sum(c[16:25])
            payload = data[at + 160 : at + 160 + size]
            if c[0] != CHUNK or len(payload) != size or K.crc32c(payload) != c[28]:
                raise corrupt("chunk header")
            rows = _read_chunk(c, payload)
            yield rows
            n += len(rows)
            at += 160 + size
    except (struct.error, ValueError) as e:
        raise corrupt(str(e)) from e
    if n != h[8]:
        raise corrupt("record count")


def read_trades(data: bytes) -> list[tuple]:
    return [row for rows in trades_flow(data) for row in rows]


# ---- best bid and ask ------------------------------------------------------------------------------------------


def write_book(rows: list[tuple], input_bytes: int = 0) -> bytes:
    """Rows of (bid, bid_qty, ask, ask_qty, ts) in order of time."""
    if not rows or any(a[4] > b[4] for a, b in zip(rows, rows[1:])):
        raise corrupt("bookticker")
    ps, qs, ts = _scale([x for r in rows for x in (r[0], r[2])]), _scale([x for r in rows for x in (r[1], r[3])]), _scale([r[4] for r in rows])
    units = [(t // ts, b // ps, (a - b) // ps, bq // qs, aq // qs) for b, bq, a, aq, t in rows]
    times, masks, fields = [], [], [[], [], [], []]
    for last, now in zip(units, units[1:]):
        times.append(now[0] - last[0])
        mask = 0
        for i in range(4):
            d = now[i + 1] - last[i + 1]
            if d:
                mask |= 1 << i
                fields[i].append(K.zigzag(d))
        masks.append(mask)
    streams = [K.put_varints(times), K.pack_nibbles(masks), *map(K.put_varints, fields)]
    sizes = [len(s) for s in streams]
    head = _BOOK.pack(BOOK, 2, 0, input_bytes, 160 + sum(sizes), len(rows), ts, ps, qs, *units[0], *sizes, sum(m > 0 for m in masks), *(len(f) for f in fields)).ljust(160, b"\0")
    return head + b"".join(streams)


def book_flow(data: bytes):
    """Rows in order; none is held."""
    if len(data) < 160:
        raise corrupt("short header")
    h = _BOOK.unpack_from(data)
    n, (ts, ps, qs), state, sizes = h[5], h[6:9], list(h[9:14]), h[14:20]
    if h[0] != BOOK or h[1] not in (1, 2) or not (ts and ps and qs) or 160 + sum(sizes) != len(data):
        raise corrupt("header")
    parts, at = [], 160
    for size in sizes:
        parts.append(data[at : at + size])
        at += size
    try:
        if len(parts[1]) != (n // 2 if h[1] == 2 else n - 1):
            raise ValueError("masks")
        masks = (b >> s & 15 for b in parts[1] for s in (0, 4)) if h[1] == 2 else iter(parts[1])
        v = [K.VarintFlow(parts[i]) for i in (0, 2, 3, 4, 5)]
        row = lambda s: (s[1] * ps, s[3] * qs, (s[1] + s[2]) * ps, s[4] * qs, s[0] * ts)
        yield row(state)
        for mask in islice(masks, n - 1):
            state[0] += v[0].next()
            for i in range(4):
                if mask >> i & 1:
                    state[i + 1] += K.unzigzag(v[i + 1].next())
            yield row(state)
        over = not all(x.done for x in v)
    except ValueError as e:
        raise corrupt(str(e)) from e
    if over:
        raise corrupt("streams")


def read_book(data: bytes) -> list[tuple]:
    return list(book_flow(data))


# ---- depth -----------------------------------------------------------------------------------------------------


def _runs_fit(levels, best, ps) -> bool:
    """Bids before asks, sides with a known best, offsets from zero up and not falling."""
    last_side, last = 0, {0: 0, 1: 0}
    for price, _, side in levels:
        if side < last_side or best[side] is None:
            return False
        offset = (best[0] - price if side == 0 else price - best[1]) // ps
        if offset < last[side]:
            return False
        last_side, last[side] = side, offset
    return True


def write_depth(batches: list[tuple], input_bytes: int = 0) -> bytes:
    """Batches of (levels, ts); a level is (price, qty, side)."""
    if not batches or any(not b[0] for b in batches) or any(a[1] > b[1] for a, b in zip(batches, batches[1:])):
        raise corrupt("depth")
    levels = [x for b in batches for x in b[0]]
    ps, qs, ts = _scale([x[0] for x in levels]), _scale([x[1] for x in levels]), _scale([b[1] for b in batches])
    hot = []
    for side in (0, 1):
        counts = Counter(q for _, q, s in levels if s == side and q)
        hot.append([q // qs for q, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:DEPTH_HOT]])
    codes = [{q: i for i, q in enumerate(h)} for h in hot]
    book, last_t = Book(), batches[0][1] // ts
    head_stream, sides, deletes, prices, code_stream, escapes = [], [], [], [], [], []
    runs = known = 0
    for rows, t in batches:
        best = (book.best(0), book.best(1))
        run = _runs_fit(rows, best, ps)
        runs += run
        head_stream += [t // ts - last_t, len(rows), int(run)]
        last_t = t // ts
        if run:
            head_stream += [sum(s == 0 for *_, s in rows), sum(s == 1 for *_, s in rows)]
        last = {0: 0, 1: 0}
        for price, qty, side in rows:
            known += best[side] is not None
            if best[side] is not None:
                offset = (best[0] - price if side == 0 else price - best[1]) // ps
            if run:
                prices.append(offset - last[side])
                last[side] = offset
            else:
                sides.append(side)
                prices.append(K.zigzag(offset if best[side] is not None else price // ps))
            deletes.append(int(qty == 0))
            if qty:
                c = codes[side].get(qty // qs, len(hot[side]))
                code_stream.append(c)
                if c == len(hot[side]):
                    escapes.append(qty // qs)
        for price, qty, side in rows:
            book.apply(side, price, qty)
    streams = [K.put_varints(head_stream), K.put_bits(sides), b"", K.put_bits(deletes), K.put_varints(prices), K.put_varints(code_stream), K.put_varints(escapes)]
    table = b"".join(K.le64(q) for h in hot for q in h)
    size = 176 + len(table) + sum(map(len, streams))
    head = _DEPTH.pack(
        DEPTH, 3, len(hot[0]), input_bytes, size, len(batches), len(levels), ts, ps, qs, batches[0][1] // ts, len(table) // 8, len(table), *map(len, streams),
        sum(deletes), len(escapes), runs, len(batches) - runs, known, len(levels) - known,
    ).ljust(176, b"\0")
    return head + table + b"".join(streams)


def depth_artifact(parts: list[dict]) -> bytes:
    """The artifact of a session's encoded slices in order (``depth_slice``)."""
    scales, tables = parts[0]["scales"], [parts[0]["hot_bids"], parts[0]["hot_asks"]]
    joined = lambda c: b"".join(p[c] for p in parts)
    bits = lambda c, n: np.packbits(np.concatenate([np.unpackbits(np.frombuffer(p[c], np.uint8), count=p[n], bitorder="little") for p in parts]), bitorder="little").tobytes()
    total = lambda c: sum(p[c] for p in parts)
    streams = [joined("heads"), bits("sides", "explicit"), b"", bits("deletes", "levels"), joined("prices"), joined("codes"), joined("escapes")]
    table = b"".join(K.le64(q) for h in tables for q in h)
    size, batches, levels = 176 + len(table) + sum(map(len, streams)), total("batches"), total("levels")
    head = _DEPTH.pack(
        DEPTH, 3, len(tables[0]), total("bytes"), size, batches, levels, scales[2], scales[0], scales[1], parts[0]["first_ts"] // scales[2], len(table) // 8, len(table), *map(len, streams),
        total("deleted"), total("escaped"), total("runs"), batches - total("runs"), total("known"), levels - total("known"),
    ).ljust(176, b"\0")
    return b"".join([head, table, *streams])


def depth_flow(data: bytes):
    """Batches in order; the streams' bytes, a byte for each level and the book are held."""
    if len(data) < 176:
        raise corrupt("short header")
    h = _DEPTH.unpack_from(data)
    n, total, scales, t = h[5], h[6], h[7:10], h[10]
    hot_count, hot_bytes, sizes = h[11], h[12], h[13:20]
    if h[0] != DEPTH or h[1] not in (2, 3) or hot_bytes != 8 * hot_count or h[2] > hot_count or 176 + hot_bytes + sum(sizes) != len(data):
        raise corrupt("header")
    table = list(struct.unpack_from(f"<{hot_count}q", data, 176))
    parts, at = [], 176 + hot_bytes
    for size in sizes:
        parts.append(data[at : at + size])
        at += size
    try:
        sides, deletes = K.bit_bytes(parts[1], 8 * len(parts[1])), K.bit_bytes(parts[3], total)
        yield from depth_batches(Book(), t, n, total, scales, (table[: h[2]], table[h[2] :]), sides, deletes, *(parts[i] for i in (0, 4, 5, 6)))
    except (ValueError, IndexError, TypeError) as e:
        raise corrupt(str(e)) from e


def depth_batches(book: Book, t: int, n: int, total: int, scales: tuple, hot: tuple, sides: bytes, deletes: bytes, heads: bytes, prices: bytes, codes: bytes, escapes: bytes):
    """``n`` batches from their streams, a book and the time before them; ``sides`` and ``deletes`` have a byte for each bit."""
    ts, ps, qs = scales
    v = [K.VarintFlow(x) for x in (heads, prices, codes, escapes)]
    level = side_at = 0
    for _ in range(n):
        t += v[0].next()
        count, run = v[0].next(), v[0].next()
        bids = v[0].next() if run else 0
        if run:
            v[0].next()
        best, last, rows = (book.best(0), book.best(1)), {0: 0, 1: 0}, []
        for i in range(count):
            if run:
                side = int(i >= bids)
                last[side] += v[1].next()
                offset = last[side]
            else:
                side = sides[side_at]
                side_at += 1
                offset = K.unzigzag(v[1].next())
            price = offset * ps if best[side] is None else best[0] - offset * ps if side == 0 else best[1] + offset * ps
            qty = 0
            if not deletes[level]:
                c = v[2].next()
                if c > len(hot[side]):
                    raise ValueError("hot code")
                qty = (v[3].next() if c == len(hot[side]) else hot[side][c]) * qs
            level += 1
            rows.append((price, qty, side))
        for price, qty, side in rows:
            book.apply(side, price, qty)
        yield rows, t * ts
    if level != total or not all(x.done for x in v):
        raise ValueError("streams")


def read_depth(data: bytes) -> list[tuple]:
    return list(depth_flow(data))


def read_depth_v1(data: bytes) -> list[tuple]:
    """Batches of the first depth format: side, price mode and delete bits of every level, one hot table for both sides.

    A price is an offset from the best price of its side, or absolute; a side that has emptied keeps its last best price.
    """
    if len(data) < 160:
        raise corrupt("short header")
    h = _DEPTH_V1.unpack_from(data)
    n, total, (ts, ps, qs), t, hot_count, sizes = h[5], h[6], h[7:10], h[10], h[11], h[12:19]
    if h[0] != DEPTH_V1 or h[1] != 1 or hot_count > DEPTH_HOT or h[19] != 8 * hot_count or 160 + h[19] + sum(sizes) != len(data):
        raise corrupt("header")
    hot = struct.unpack_from(f"<{hot_count}q", data, 160)
    ends = [160 + h[19] + sum(sizes[:i]) for i in range(8)]
    heads, sides, modes, deletes, prices, codes, escapes = (data[a:b] for a, b in zip(ends, ends[1:]))
    heads, prices, codes, escapes = map(K.Varints, (heads, prices, codes, escapes))
    book, best, out, level = Book(), [0, 0], [], 0
    try:
        flags = list(zip(*(K.get_bits(x, total).tolist() for x in (sides, modes, deletes))))
        for _ in range(n):
            t += heads.next()
            rows = []
            for side, relative, deleted in flags[level : level + heads.next()]:
                v = prices.next()
                price = K.unzigzag(v) if not relative else best[1] + v if side else best[0] - v
                qty = 0
                if not deleted:
                    c = codes.next()
                    qty = hot[c] if c < hot_count else escapes.next()
                rows.append((price, qty, side))
            level += len(rows)
            for price, qty, side in rows:
                book.apply(side, price, qty)
            best = [best[s] if book.best(s) is None else book.best(s) for s in (0, 1)]
            out.append(([(p * ps, q * qs, s) for p, q, s in rows], t * ts))
    except ValueError as e:
        raise corrupt(str(e)) from e
    if level != total or not all(x.done for x in (heads, prices, codes, escapes)):
        raise corrupt("streams")
    return out


def depth_version(data: bytes) -> int:
    if len(data) < 6:
        raise corrupt("short header")
    return struct.unpack_from("<IH", data)[1]


def read_any_depth(data: bytes) -> list[tuple]:
    return (read_depth_v1 if depth_version(data) == 1 else read_depth)(data)


# ---- text, entropy envelope, dispatch --------------------------------------------------------------------------

WRITERS = {"trades": write_trades, "bookticker": write_book, "depth": write_depth}


def parse_text(text: bytes, stream: str) -> list[tuple]:
    """Records of canonical text; JSON numbers must be integers."""
    import json

    out = []
    for line in text.splitlines():
        try:
            v = json.loads(line)
            flat = [x for e in v for x in (e if isinstance(e, list) else [e])]
            if any(type(x) is not int for x in flat) or len(v) < 2 or (stream != "depth" and len(v) != {"trades": 4, "bookticker": 5}[stream]) or (stream == "depth" and any(type(e) is not list or len(e) != 3 or e[2] not in (0, 1) for e in v[:-1])):
                raise ValueError("record")
        except (ValueError, TypeError) as e:
            raise corrupt(f"line {len(out) + 1}: {e}") from e
        out.append(([tuple(x) for x in v[:-1]], v[-1]) if stream == "depth" else tuple(v))
    return out


def to_text(rows: list[tuple], stream: str, end: str = "\n") -> bytes:
    if stream == "depth":
        lines = ("[" + "".join(f"[{p},{q},{s}]," for p, q, s in levels) + f"{t}]" for levels, t in rows)
    else:
        lines = ("[" + ",".join(map(str, r)) + "]" for r in rows)
    return "".join(x + end for x in lines).encode()


def compress(text: bytes, stream: str, profile: str | None = None) -> bytes:
    """Transform artifact of canonical text, inside an entropy envelope if a profile is named; checked by a round trip."""
    crlf = b"\r\n" in text[: text.find(b"\n") + 1]
    rows = parse_text(text, stream)
    base = write_trades(rows, crlf, len(text)) if stream == "trades" else WRITERS[stream](rows, len(text))
    data = base if profile is None else envelope(base, stream, profile, len(text), len(rows))
    if decompress(data) != text:
        raise TapeError("decode_error", "roundtrip check failed")
    return data


def envelope(base: bytes, stream: str, profile: str, input_bytes: int, lines: int) -> bytes:
    """An artifact inside an entropy envelope."""
    return enclose(base, K.arithmetic_encode(base, profile), stream, profile, input_bytes, lines)


def enclose(base: bytes, payload: bytes, stream: str, profile: str, input_bytes: int, lines: int) -> bytes:
    """The envelope of an artifact and its coded payload."""
    kind = list(K.PROFILES).index(profile) + 1
    head = lambda crc: _ENVELOPE.pack(ENVELOPE, 1, kind, STREAM_ID[stream] + 1, STREAM_ID[stream], crc, input_bytes, len(base), 128 + len(payload), lines, len(payload), K.crc32c(payload), K.crc32c(base)).ljust(128, b"\0")
    return head(K.crc32c(head(0))) + payload


def open_envelope(data: bytes, base: bytes | None = None) -> bytes:
    """The artifact in an envelope, checked; ``base`` is given where its payload is already decoded."""
    h = _ENVELOPE.unpack_from(data) if len(data) >= 128 else corrupt_short()
    payload = data[128:]
    if not 1 <= h[2] <= len(K.PROFILES) or h[8] != len(data) or h[10] != len(payload) or K.crc32c(_ENVELOPE.pack(*h[:5], 0, *h[6:]).ljust(128, b"\0")) != h[5] or K.crc32c(payload) != h[11]:
        raise corrupt("envelope")
    if base is None:
        base = K.arithmetic_decode(payload, h[7], list(K.PROFILES)[h[2] - 1])
    if len(base) != h[7] or K.crc32c(base) != h[12]:
        raise corrupt("decoded checksum")
    return base


def corrupt_short():
    raise corrupt("short header")


def stream_of(data: bytes) -> str:
    magic = struct.unpack_from("<I", data)[0] if len(data) >= 4 else 0
    found = {TRADES: "trades", BOOK: "bookticker", DEPTH: "depth", DEPTH_V1: "depth"}.get(magic)
    if found:
        return found
    if magic == ENVELOPE:
        return list(STREAM_ID)[struct.unpack_from("<I4H", data)[4]]
    raise corrupt("magic")


def text_flow(data: bytes, records: int = 4096):
    """The canonical text of a transform artifact, a list of lines at a time."""
    stream = stream_of(data)
    if stream == "trades":
        groups = trades_flow(data)
    else:
        rows = book_flow(data) if stream == "bookticker" else iter(read_depth_v1(data)) if depth_version(data) == 1 else depth_flow(data)
        groups = iter(lambda: list(islice(rows, records)), [])
    for some in groups:
        yield to_text(some, stream).decode().splitlines()


def check(data: bytes) -> None:
    """Reads a transform artifact to its end."""
    for _ in text_flow(data):
        pass


def decode(data: bytes) -> tuple[str, list[tuple]]:
    """Stream and records of a transform artifact or envelope."""
    if len(data) >= 4 and struct.unpack_from("<I", data)[0] == ENVELOPE:
        data = open_envelope(data)
    stream = stream_of(data)
    return stream, {"trades": read_trades, "bookticker": read_book, "depth": read_any_depth}[stream](data)


def decompress(data: bytes) -> bytes:
    """Canonical text of any artifact."""
    if len(data) >= 4 and struct.unpack_from("<I", data)[0] in (CONTAINER, RAW):
        return read_container(data)
    inner = open_envelope(data) if len(data) >= 4 and struct.unpack_from("<I", data)[0] == ENVELOPE else data
    stream, rows = decode(inner)
    crlf = stream == "trades" and struct.unpack_from("<I4H", inner)[3] == 2
    return to_text(rows, stream, "\r\n" if crlf else "\n")


def inspect(data: bytes) -> dict:
    """Header fields of an artifact by magic."""
    magic = struct.unpack_from("<I", data)[0] if len(data) >= 4 else 0
    if magic in (CONTAINER, RAW):
        index = read_index(data)
        return {k: v for k, v in index.items() if k != "blocks"} | {"block_count": len(index["blocks"])}
    if magic == ENVELOPE:
        h = _ENVELOPE.unpack_from(data)
        return {"format": "entropy", "entropy": list(K.PROFILES)[h[2] - 1], "stream": list(STREAM_ID)[h[4]], "input_bytes": h[6], "base_bytes": h[7], "output_bytes": h[8], "line_count": h[9], "payload_bytes": h[10]}
    if magic == TRADES:
        h = _TRADES.unpack_from(data)
        return {"format": "trades", "version": h[1], "input_bytes": h[6], "output_bytes": h[7], "record_count": h[8], "chunk_count": h[9], "time_groups": h[10], "price_groups": h[11], "qty_escapes": h[12]}
    if magic == BOOK:
        h = _BOOK.unpack_from(data)
        names = ["time_bytes", "mask_bytes", "bid_bytes", "spread_bytes", "bid_qty_bytes", "ask_qty_bytes", "mask_nonzero", "bid_changed", "spread_changed", "bid_qty_changed", "ask_qty_changed"]
        return {"format": "bookticker", "version": h[1], "record_count": h[5], "encoded_bytes": h[4], **dict(zip(names, h[14:25]))}
    if magic == DEPTH_V1 and len(data) >= 160:
        h = _DEPTH_V1.unpack_from(data)
        names = ["batch_bytes", "side_bytes", "price_mode_bytes", "delete_bytes", "price_bytes", "qty_code_bytes", "qty_escape_bytes", "hot_table_bytes", "delete_count", "qty_escape_count", "offset_price_count", "absolute_price_count"]
        return {"format": "depth", "version": h[1], "batch_count": h[5], "level_count": h[6], "encoded_bytes": h[4], **dict(zip(names, h[12:24]))}
    if magic == DEPTH:
        h = _DEPTH.unpack_from(data)
        names = ["batch_bytes", "side_bytes", "price_mode_bytes", "delete_bytes", "price_bytes", "qty_code_bytes", "qty_escape_bytes", "delete_count", "qty_escape_count", "run_mode_batches", "fallback_batches", "offset_price_count", "absolute_price_count"]
        return {"format": "depth", "version": h[1], "batch_count": h[5], "level_count": h[6], "encoded_bytes": h[4], "hot_table_bytes": h[12], **dict(zip(names, h[13:26]))}
    raise corrupt("magic")
