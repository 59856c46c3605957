"""Streaming: order book and quote deltas as stateful operators over micro-batches.

Rows of a session arrive in order of (batch, pos) or seq; an earlier time than the last one seen is late and fails
the query, as the whole input would be rejected.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.depth import Book
from ..schema import TapeError


def _book(key, frames, state):
    levels, last = state.get if state.exists else ([], -1)
    book = Book()
    for side, price, qty in levels:
        book.apply(side, price, qty)
    pdf = pd.concat(list(frames)).sort_values(["batch", "pos"], kind="stable")
    times = pdf["ts_ns"].to_numpy()
    if len(times) and (times[0] < last or (times[1:] < times[:-1]).any()):
        raise TapeError("corrupt_data", "late batch")
    out, at = [], None
    for batch, side, price, qty in zip(pdf["batch"].tolist(), pdf["side"].tolist(), pdf["price_e8"].tolist(), pdf["qty_e8"].tolist()):
        if batch != at:
            at = batch
            out.append((key[0], batch, book.best(0), book.best(1)))
        book.apply(side, price, qty)
    state.update(([(s, p, q) for s in (0, 1) for p, q in book.live[s].items()], int(pdf["ts_ns"].iloc[-1]) if len(pdf) else last))
    yield pd.DataFrame(out, columns=["session_id", "batch", "best_bid", "best_ask"]).astype({"best_bid": "Int64", "best_ask": "Int64"})


def best_before(levels: DataFrame) -> DataFrame:
    """Best bid and ask before each batch of a stream of exploded depth levels."""
    return levels.groupBy("session_id").applyInPandasWithState(
        _book, "session_id string, batch long, best_bid long, best_ask long", "levels array<struct<side:long,price:long,qty:long>>, last long", "append", GroupStateTimeout.NoTimeout
    )


_FIELDS = ["ts_ns", "bid_price_e8", "bid_qty_e8", "ask_price_e8", "ask_qty_e8"]


def _deltas(key, frames, state):
    before = state.get if state.exists else None
    pdf = pd.concat(list(frames)).sort_values("seq", kind="stable")
    rows = []
    for seq, *now in pdf[["seq", *_FIELDS]].itertuples(index=False):
        now = [int(x) for x in now]
        before = before or tuple(now)
        if now[0] < before[0]:
            raise TapeError("corrupt_data", "late quote")
        rows.append((key[0], int(seq), *(a - b for a, b in zip(now, before))))
        before = tuple(now)
    if before is not None:
        state.update(before)
    yield pd.DataFrame(rows, columns=["session_id", "seq", *(f"d_{f}" for f in _FIELDS)])


def quote_deltas(book: DataFrame) -> DataFrame:
    """Deltas of each quote to the one before, kept across micro-batches."""
    return book.groupBy("session_id").applyInPandasWithState(
        _deltas, "session_id string, seq long, " + ", ".join(f"d_{f} long" for f in _FIELDS), ", ".join(f"{f} long" for f in _FIELDS), "append", GroupStateTimeout.NoTimeout
    )
