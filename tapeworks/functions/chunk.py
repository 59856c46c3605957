"""Numpy kernel of one trades chunk: at most CHUNK_RECORDS records, so its memory is bounded whatever the session."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa

from ..schema import HOT_CAPACITIES

_LIMITS = np.array([1 << 7 * i for i in range(1, 10)], np.uint64)


def varint_lengths(v: np.ndarray) -> np.ndarray:
    """Bytes of unsigned LEB128 numbers; negative values are their 64-bit pattern."""
    return np.searchsorted(_LIMITS, v.astype(np.int64).view(np.uint64), side="right") + 1


def zigzag(v: np.ndarray) -> np.ndarray:
    return (v << 1) ^ (v >> 63)


def _scale(v: np.ndarray) -> int:
    g = int(np.gcd.reduce(v)) if len(v) else 0
    return g if g > 0 else 1


class TradesChunk:
    """Scales, runs, quantity ranks and dictionary costs of one chunk, each computed when first asked for."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("seq")
        column = lambda c: table.column(c).to_numpy().astype(np.int64)
        self.key = (table.column("session_id")[0].as_py(), table.column("chunk")[0].as_py())
        self.seq, self.price, self.qty, self.side, self.ts = (column(c) for c in ("seq", "price_e8", "qty_e8", "side", "ts_ns"))
        self.records = len(self.seq)

    def rows(self, columns: dict) -> pa.Table:
        """A table of the columns, with the chunk's key ahead; plain numbers are repeated."""
        n = next((len(v) for v in columns.values() if isinstance(v, np.ndarray)), 1)
        head = {"session_id": pa.array([self.key[0]] * n), "chunk": pa.array([self.key[1]] * n, pa.int64())}
        return pa.table({**head, **{c: v if isinstance(v, pa.Array) else pa.array(np.broadcast_to(np.asarray(v, np.int64), n)) for c, v in columns.items()}})

    @cached_property
    def price_scale(self) -> int:
        return _scale(self.price)

    @cached_property
    def qty_scale(self) -> int:
        return _scale(self.qty)

    @cached_property
    def time_scale(self) -> int:
        # gcd(base, ts - base) equals the gcd of the times.
        return _scale(self.ts)

    @cached_property
    def _new(self) -> tuple[np.ndarray, np.ndarray]:
        """First records of time groups and of price groups."""
        time = np.concatenate([[True], self.ts[1:] != self.ts[:-1]])
        price = np.concatenate([[True], (self.price[1:] != self.price[:-1]) | (self.side[1:] != self.side[:-1])])
        return np.flatnonzero(time), np.flatnonzero(time | price)

    @cached_property
    def price_groups(self) -> dict:
        t, p = self._new
        tick = self.price[p] // self.price_scale
        dp = np.diff(tick, prepend=self.price[0] // self.price_scale)
        n = np.diff(np.append(p, self.records))
        return {
            "pg": np.arange(len(p)), "tg": np.searchsorted(t, p, side="right") - 1, "n": n, "side": self.side[p], "price_tick": tick,
            "dp": dp, "dp_zigzag": zigzag(dp), "dp_zero": (dp == 0).astype(np.int64), "count_one": (n == 1).astype(np.int64),
        }

    @cached_property
    def time_groups(self) -> dict:
        t, p = self._new
        unit = self.ts[t] // self.time_scale
        groups = np.diff(np.append(np.searchsorted(p, t), len(p)))
        return {
            "tg": np.arange(len(t)), "n": np.diff(np.append(t, self.records)), "price_groups": groups, "ts_unit": unit,
            "dt": np.diff(unit, prepend=self.ts[0] // self.time_scale), "price_group_count_one": (groups == 1).astype(np.int64),
        }

    @cached_property
    def _ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lots and their counts by count downwards, then lot; and the rank of every record's lot."""
        lots, place, n = np.unique(self.qty // self.qty_scale, return_inverse=True, return_counts=True)
        order = np.lexsort((lots, -n))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return lots[order], n[order], rank[place]

    @cached_property
    def ranks(self) -> dict:
        lots, n, _ = self._ranked
        return {"lot": lots, "n": n, "rank": np.arange(len(lots))}

    @cached_property
    def costs(self) -> dict:
        """Each capacity: code bytes, escape bytes, two bytes an entry and one an escape."""
        lots, n, _ = self._ranked
        caps = np.array(HOT_CAPACITIES, np.int64)
        bits = np.array([c.bit_length() for c in HOT_CAPACITIES], np.int64)
        beyond = lambda v: np.array([v[c:].sum() for c in HOT_CAPACITIES], np.int64)
        escapes, escape_bytes, hot = beyond(n), beyond(n * varint_lengths(lots)), np.minimum(caps, len(lots))
        cost = (self.records * bits + 7) // 8 + escape_bytes + 2 * hot + escapes
        return {"capacity": caps, "records": self.records, "hot": hot, "escapes": escapes, "escape_bytes": escape_bytes, "bits": bits, "cost": cost}

    @cached_property
    def best(self) -> dict:
        """The cheapest capacity; of equal costs the smallest."""
        i = int(np.argmin(self.costs["cost"]))
        return {c: int(v[i]) if isinstance(v, np.ndarray) else v for c, v in self.costs.items()}

    @cached_property
    def dictionary(self) -> dict:
        lots, n, _ = self._ranked
        size = self.best["hot"]
        return {"code": np.arange(size), "lot": lots[:size], "n": n[:size]}

    @cached_property
    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """The code of every record, the capacity for an escape; and whether it is one."""
        _, _, rank = self._ranked
        escape = rank >= self.best["capacity"]
        return np.where(escape, self.best["capacity"], rank), escape

    @cached_property
    def sizes(self) -> dict:
        """Bytes of the nine encoded streams."""
        p, t, best = self.price_groups, self.time_groups, self.best
        price = varint_lengths(p["dp_zigzag"])[p["dp"] != 0].sum() + varint_lengths(p["n"] - 2)[p["n"] != 1].sum()
        time = varint_lengths(t["dt"]).sum() + varint_lengths(t["price_groups"])[t["price_groups"] != 1].sum()
        out = {
            "records": self.records, "price_groups": len(p["pg"]), "dp_zero_count": p["dp_zero"].sum(), "count_one_count": p["count_one"].sum(), "price_bytes": price,
            "time_groups": len(t["tg"]), "price_group_count_one_count": t["price_group_count_one"].sum(), "time_bytes": time, "hot_bits": best["bits"], "qty_escapes": best["escapes"],
            "qty_escape_bytes": best["escape_bytes"], "hot_table_bytes": varint_lengths(self.dictionary["lot"]).sum(), "flag_bytes": (len(p["pg"]) + 7) // 8,
            "pgc1_bytes": (len(t["tg"]) + 7) // 8, "qty_code_bytes": (self.records * best["bits"] + 7) // 8,
        }
        parts = ("hot_table_bytes", "time_bytes", "price_bytes", "pgc1_bytes", "qty_code_bytes", "qty_escape_bytes")
        return {**out, "payload_bytes": sum(int(out[c]) for c in parts) + 3 * out["flag_bytes"]}
