"""Byte kernels used inside Arrow functions: varints, bit streams, checksums, the adaptive coder."""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np

U64 = (1 << 64) - 1


def zigzag(v: int) -> int:
    return ((v << 1) ^ (v >> 63)) & U64


def unzigzag(z: int) -> int:
    return (z >> 1) ^ -(z & 1)


def put_varints(values) -> bytes:
    """Unsigned LEB128 of each value, one after the other."""
    out = bytearray()
    for v in values:
        v &= U64
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def varints_of(values: np.ndarray) -> bytes:
    """``put_varints`` of an array of whole numbers."""
    v = np.asarray(values).astype(np.int64).view(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << 7 * k)
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        on = size > k
        byte = v[on] >> np.uint64(7 * k) & np.uint64(127)
        out[start[on] + k] = byte.astype(np.uint8) | (size[on] > k + 1).astype(np.uint8) << 7
    return out.tobytes()


def varint_runs(raw: bytes, step: int = 1 << 16):
    """The values that ``Varints`` reads, list by list; a list and ``step`` bytes are held. Ends with ``ValueError`` inside a value."""
    at = 0
    while at < len(raw):
        b = np.frombuffer(raw, np.uint8, min(step, len(raw) - at), at)
        ends = np.flatnonzero(b < 128)
        if not len(ends):
            raise ValueError("varint")
        b = b[: ends[-1] + 1]
        starts = np.concatenate([[0], ends[:-1] + 1])
        size = ends - starts + 1
        if size.max() > 10:
            raise ValueError("varint")
        shift = (7 * (np.arange(len(b)) - np.repeat(starts, size))).astype(np.uint64)
        yield np.bitwise_or.reduceat((b & 127).astype(np.uint64) << shift, starts).tolist()
        at += len(b)


class VarintFlow:
    """``Varints`` over ``varint_runs``."""

    def __init__(self, raw: bytes):
        self._flow = chain.from_iterable(varint_runs(raw))

    def next(self) -> int:
        for v in self._flow:
            return v
        raise ValueError("varint")

    @property
    def done(self) -> bool:
        return next(self._flow, None) is None


class Varints:
    """Reads varints in order; ``ValueError`` past the end or over ten bytes."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def next(self) -> int:
        v = shift = 0
        while True:
            if self.at >= len(self.raw) or shift > 63:
                raise ValueError("varint")
            b = self.raw[self.at]
            self.at += 1
            v |= (b & 127) << shift
            if b < 128:
                return v & U64
            shift += 7

    @property
    def done(self) -> bool:
        return self.at == len(self.raw)


def put_bits(values, width: int = 1) -> bytes:
    """Values of ``width`` bits, least significant bit first."""
    a = np.asarray(list(values), np.int64)
    if not len(a):
        return b""
    bits = (a[:, None] >> np.arange(width)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def get_bits(raw: bytes, count: int, width: int = 1) -> np.ndarray:
    need = -(-count * width // 8)
    if len(raw) < need:
        raise ValueError("bits")
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: count * width].reshape(count, width)
    return bits.astype(np.int64) @ (1 << np.arange(width))


def bit_bytes(raw: bytes, count: int) -> bytes:
    """``get_bits`` of width 1, a byte for each bit."""
    if len(raw) < -(-count // 8):
        raise ValueError("bits")
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=count, bitorder="little").tobytes()


def pack_nibbles(masks) -> bytes:
    m = list(masks)
    return bytes((m[i] | (m[i + 1] if i + 1 < len(m) else 0) << 4) for i in range(0, len(m), 2))


def unpack_nibbles(raw: bytes, count: int) -> list[int]:
    if len(raw) != (count + 1) // 2:
        raise ValueError("masks")
    return [raw[i // 2] >> 4 * (i % 2) & 15 for i in range(count)]


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


_CRC = _table()


_CRC_NP = np.array(_CRC, np.uint32)
#: Bytes of one lane of a long checksum.
_LANE = 1024


@lru_cache(maxsize=1)
def _skip_tables() -> list[list[int]]:
    """What _LANE zero bytes make of a checksum register, by each of its four bytes."""
    basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(_LANE):
        basis = (basis >> np.uint32(8)) ^ _CRC_NP[basis & np.uint32(255)]
    value = np.arange(256)
    return [np.bitwise_xor.reduce(np.where(value[:, None] >> np.arange(8) & 1, basis[8 * k : 8 * k + 8], 0), axis=1).tolist() for k in range(4)]


def _crc_lanes(raw: bytes, c: int) -> tuple[int, int]:
    """The register after all whole lanes of ``raw``, and their bytes. Lanes run side by side and are joined in order."""
    n = len(raw) // _LANE
    lanes = np.frombuffer(raw, np.uint8, n * _LANE).reshape(n, _LANE)
    own = np.zeros(n, np.uint32)
    for column in np.ascontiguousarray(lanes.T):
        own = (own >> np.uint32(8)) ^ _CRC_NP[(own ^ column) & np.uint32(255)]
    t = _skip_tables()
    for x in own.tolist():
        c = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24] ^ x
    return c, n * _LANE


def crc32c(raw: bytes) -> int:
    """Castagnoli checksum."""
    c, t = 0xFFFFFFFF, _CRC
    at = 0
    if len(raw) >= 32 * _LANE:
        c, at = _crc_lanes(raw, c)
    for b in raw[at:]:
        c = c >> 8 ^ t[(c ^ b) & 255]
    return c ^ 0xFFFFFFFF


FNV_START, FNV_PRIME = 14695981039346656037, 1099511628211


def fnv1a(raw: bytes, h: int = FNV_START) -> int:
    for b in raw:
        h = (h ^ b) * FNV_PRIME & U64
    return h


def le64(v: int) -> bytes:
    return (v & U64).to_bytes(8, "little")


def record_hash(h: int, stream: str, values: list[int], ts: int, levels=None) -> int:
    """Running hash of one record: stream, time, number of values, the hash of depth levels, then up to eight values."""
    count = len(levels) if levels is not None else len(values)
    h = fnv1a(le64(count), fnv1a(le64(ts), fnv1a(stream.encode(), h)))
    if levels is not None:
        own = FNV_START
        for level in levels:
            for v in level:
                own = fnv1a(le64(v), own)
        h = fnv1a(le64(own), h)
        values = [0] * min(count, 8)
    for v in values[:8]:
        h = fnv1a(le64(v), h)
    return h


#: Profile: number of contexts, count at which a model halves, context from the previous byte and bit index.
PROFILES = {
    "ac16_ctx0": (1, 1 << 16, lambda prev, bit: 0),
    "ac16_ctx8": (256, 1 << 16, lambda prev, bit: prev),
    "ac16_ctx12": (4096, 1 << 16, lambda prev, bit: prev * 16 + bit),
    "ac32_ctx8": (256, 1 << 20, lambda prev, bit: prev),
    "range_byte_ctx8": (2048, 1 << 16, lambda prev, bit: prev * 8 + bit),
    "rans_byte_static": (4096, 1 << 16, lambda prev, bit: prev * 16 + bit),
}

_TOP, _HALF, _QUARTER = (1 << 32) - 1, 1 << 31, 1 << 30


#: Bytes of a step of the encoder.
_STEP = 1 << 15


@lru_cache(maxsize=None)
def _contexts(profile: str) -> np.ndarray:
    """Context of each previous byte and bit index."""
    context = PROFILES[profile][2]
    return np.array([[context(prev, k) for k in range(8)] for prev in range(256)], np.int64)


def _splits(bits: np.ndarray, at: np.ndarray, zero: np.ndarray, one: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and all bits that the model of each bit's context (``at``) has counted before it; counts are carried on.

    The bits of one context are taken together. Its total grows by one a bit, so it is known where counts are halved.
    """
    order = np.argsort(at, kind="stable")
    own, sorted_bits = at[order], bits[order].astype(np.int64)
    zeros, totals = np.empty(len(bits), np.int64), np.empty(len(bits), np.int64)
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(bits)]):
        c, z, o = own[i], int(zero[own[i]]), int(one[own[i]])
        while i < j:
            n = min(j - i, limit - z - o + 1)
            ones = np.cumsum(sorted_bits[i : i + n])
            k = np.arange(n)
            zeros[i : i + n] = z + k - ones + sorted_bits[i : i + n]
            totals[i : i + n] = z + o + k
            z, o, i = z + n - int(ones[-1]), o + int(ones[-1]), i + n
            if z + o > limit:
                z, o = max(1, (z + 1) // 2), max(1, (o + 1) // 2)
        zero[c], one[c] = z, o
    out = np.empty((2, len(bits)), np.int64)
    out[0, order], out[1, order] = zeros, totals
    return out[0], out[1]


def arithmetic_encode(raw: bytes, profile: str) -> bytes:
    """Counts are found ahead, step by step; only the interval is one sequence. Equal leading bits of its ends are given out
    at once, then those that straddle the middle are counted."""
    limit, table = PROFILES[profile][1], _contexts(profile)
    zero, one = np.ones(PROFILES[profile][0], np.int64), np.ones(PROFILES[profile][0], np.int64)
    low, high, pending, prev = 0, _TOP, 0, 0
    out, held, count = bytearray(), 0, 0  # ``held`` has ``count`` bits that go out next
    for start in range(0, len(raw), _STEP):
        part = np.frombuffer(raw, np.uint8, min(_STEP, len(raw) - start), start)
        bits = np.unpackbits(part)
        at = table[np.concatenate([[prev], part[:-1]])].reshape(-1)
        prev = int(part[-1])
        zeros, totals = _splits(bits, at, zero, one, limit)
        for z, t, bit in zip(zeros.tolist(), totals.tolist(), bits.tolist()):
            mid = low + (high - low + 1) * z // t
            if bit:
                low = mid
            else:
                high = mid - 1
            x = low ^ high
            if x < _HALF:
                n = 32 - x.bit_length()
                top = high >> 32 - n
                if pending:
                    # The first bit, its opposite as often as was counted, the others.
                    first = top >> n - 1
                    held = held << 1 + pending | (1 << pending if first else (1 << pending) - 1)
                    held = held << n - 1 | top & (1 << n - 1) - 1
                    count += n + pending
                    pending = 0
                else:
                    held = held << n | top
                    count += n
                low = low << n & _TOP
                high = high << n & _TOP | (1 << n) - 1
                if count > 512:
                    whole = count // 8
                    count -= 8 * whole
                    out += (held >> count).to_bytes(whole, "big")
                    held &= (1 << count) - 1
            if low >= _QUARTER and high < 3 * _QUARTER:
                # As many as ones of ``low`` and zeros of ``high`` follow their first bits.
                n = 31 - (low & ~high & _HALF - 1 ^ _HALF - 1).bit_length()
                pending += n
                low = low << n & _HALF - 1
                high = high << n & _HALF - 1 | _HALF | (1 << n) - 1
    pending += 1
    first = int(low >= _QUARTER)
    held = held << 1 + pending | (1 << pending if first else (1 << pending) - 1)
    count += 1 + pending
    return bytes(out) + (held << -count % 8).to_bytes(-(-count // 8), "big")


def arithmetic_decode(raw: bytes, size: int, profile: str) -> bytes:
    contexts, limit, _ = PROFILES[profile]
    table = _contexts(profile).tolist()
    zero, one = [1] * contexts, [1] * contexts
    # Bits come from a window of the input; zeros follow its end.
    window, left, at = 0, 0, 4
    value = int.from_bytes(raw[:4].ljust(4, b"\0"), "big")
    low, high, out = 0, _TOP, bytearray()
    row = table[0]
    for _ in range(size):
        byte = 0
        for c in row:
            z, o = zero[c], one[c]
            mid = low + (high - low + 1) * z // (z + o)
            if value >= mid:
                low = mid
                byte = byte << 1 | 1
                one[c] = o = o + 1
            else:
                high = mid - 1
                byte <<= 1
                zero[c] = z = z + 1
            if z + o > limit:
                zero[c], one[c] = max(1, (z + 1) // 2), max(1, (o + 1) // 2)
            x = low ^ high
            if x < _HALF:
                n = 32 - x.bit_length()
                if left < n:
                    window = window << 256 | int.from_bytes(raw[at : at + 32].ljust(32, b"\0"), "big")
                    left, at = left + 256, at + 32
                left -= n
                value = value << n & _TOP | window >> left
                window &= (1 << left) - 1
                low = low << n & _TOP
                high = high << n & _TOP | (1 << n) - 1
            if low >= _QUARTER and high < 3 * _QUARTER:
                n = 31 - (low & ~high & _HALF - 1 ^ _HALF - 1).bit_length()
                if left < n:
                    window = window << 256 | int.from_bytes(raw[at : at + 32].ljust(32, b"\0"), "big")
                    left, at = left + 256, at + 32
                left -= n
                value = (value - _HALF + (_HALF >> n) << n) | window >> left
                window &= (1 << left) - 1
                low = low << n & _HALF - 1
                high = high << n & _HALF - 1 | _HALF | (1 << n) - 1
        out.append(byte)
        row = table[byte]
    return bytes(out)
