"""Order-book depth: as-of best prices, ladder offsets, run mode, hot quantities, stream sizes and the final book.

A session is cut into slices of SLICE batches. The book at the start of a slice is relational: of every price the last
update of earlier slices, unless it deletes. So slices are walked independently and no session is one task.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import scalar as S
from ..functions.sequence import gcd_by
from ..schema import DEPTH_HOT, TapeError

SLICE = 4096


def scales(levels: DataFrame) -> DataFrame:
    g = gcd_by(levels, ["session_id"], ["price_e8", "qty_e8", "ts_ns"])
    safe = lambda c: S.safe_scale(F.abs(c))
    return g.select("session_id", safe("price_e8").alias("price_scale"), safe("qty_e8").alias("qty_scale"), safe("ts_ns").alias("time_scale"))


class Book:
    """Live levels of one session. Best prices come from heaps whose stale tops are dropped when seen."""

    def __init__(self):
        self.live: tuple[dict, dict] = ({}, {})
        self.heap: tuple[list, list] = ([], [])

    def apply(self, side: int, price: int, qty: int) -> None:
        if qty == 0:
            self.live[side].pop(price, None)
        else:
            if price not in self.live[side]:
                heapq.heappush(self.heap[side], price if side else -price)
            self.live[side][price] = qty

    def best(self, side: int):
        """Highest bid (side 0) or lowest ask (side 1); None where the side is empty."""
        heap, live = self.heap[side], self.live[side]
        while heap:
            price = heap[0] if side else -heap[0]
            if price in live:
                return price
            heapq.heappop(heap)
        return None


def sliced(levels: DataFrame, size: int = SLICE) -> DataFrame:
    """The levels with their slice, and ahead of each slice (batch null) the levels that are live at its start and, with side
    -1, the time of the batch before it."""
    rows = levels.select("session_id", F.expr(f"batch div {size}").alias("slice"), "batch", "pos", "ts_ns", "side", "price_e8", "qty_e8")
    last = rows.groupBy("session_id", "slice", "side", "price_e8").agg(F.max(F.struct("batch", "pos", "qty_e8")).alias("x"))
    # One row for each slice.
    marks = rows.groupBy("session_id", "slice").agg(F.max("ts_ns").alias("ts_ns"))
    ends = marks.groupBy("session_id").agg(F.max("slice").alias("end"))
    until = F.coalesce(F.lead("slice").over(Window.partitionBy("session_id", "side", "price_e8").orderBy("slice")), F.col("end"))
    held = last.join(ends, "session_id").withColumn("until", until).where((F.col("x.qty_e8") != 0) & (F.col("until") > F.col("slice")))
    null = lambda c: F.lit(None).cast("long").alias(c)
    # One row for each slice a level lives through.
    start = held.select("session_id", F.explode(F.sequence(F.col("slice") + 1, "until")).alias("slice"), null("batch"), null("pos"), null("ts_ns"), "side", "price_e8", F.col("x.qty_e8").alias("qty_e8"))
    zero = lambda c, v: F.lit(v).cast("long").alias(c)
    before = marks.select("session_id", (F.col("slice") + 1).alias("slice"), null("batch"), null("pos"), "ts_ns", zero("side", -1), zero("price_e8", 0), zero("qty_e8", 0))
    return rows.unionByName(start).unionByName(before)


def _time_before(t: pa.Table) -> int | None:
    """The time of the batch before the slice, None for a session's first."""
    mark = t.filter(pa.compute.equal(t.column("side"), -1)).column("ts_ns").to_pylist()
    return mark[0] if mark else None


def _book_at(t: pa.Table) -> Book:
    """The book at the start of a slice."""
    book = Book()
    held = t.filter(pa.compute.and_(pa.compute.is_null(t.column("batch")), pa.compute.greater_equal(t.column("side"), 0)))
    for side, price, qty in zip(*(held.column(c).to_pylist() for c in ("side", "price_e8", "qty_e8"))):
        book.apply(side, price, qty)
    return book


def _walked(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, list, list]:
    """The levels of a slice in order, first rows of its batches, batch number of each row, and the bests before each batch."""
    book = _book_at(t)
    t = t.filter(pa.compute.is_valid(t.column("batch"))).sort_by([("batch", "ascending"), ("pos", "ascending")])
    batch = t.column("batch").to_numpy()
    first = np.flatnonzero(np.concatenate([[True], batch[1:] != batch[:-1]])) if len(batch) else np.empty(0, np.int64)
    levels = list(zip(*(t.column(c).to_pylist() for c in ("side", "price_e8", "qty_e8"))))
    bids, asks = [], []
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(levels)]):
        bids.append(book.best(0))
        asks.append(book.best(1))
        for level in levels[i:j]:
            book.apply(*level)
    return t, first, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(batch)))), batch, bids, asks


def best_before(levels: DataFrame, size: int = SLICE) -> DataFrame:
    """Best bid and ask strictly before each batch; null where the side is empty."""

    def run(t: pa.Table) -> pa.Table:
        t, first, _, batch, bids, asks = _walked(t)
        return pa.table({"session_id": t.column("session_id").take(pa.array(first)), "batch": pa.array(batch[first], pa.int64()), "best_bid": pa.array(bids, pa.int64()), "best_ask": pa.array(asks, pa.int64())})

    return sliced(levels, size).groupBy("session_id", "slice").applyInArrow(run, "session_id string, batch long, best_bid long, best_ask long")


def _modes(t: pa.Table) -> pa.Table:
    """Of each level the best price of its side before the batch, its distance, the gap to the level before, and the batch's run mode."""
    ahead = _time_before(t)
    t, first, at, _, bids, asks = _walked(t)
    n = len(at)
    times = t.column("ts_ns").to_numpy()[first]
    before_ts = np.concatenate([[times[0] if ahead is None else ahead], times[:-1]]) if n else times
    side, price = (t.column(c).to_numpy() for c in ("side", "price_e8"))
    best = [asks[i] if s else bids[i] for i, s in zip(at.tolist(), side.tolist())]
    known = np.array([b is not None for b in best], bool)
    best = np.array([b or 0 for b in best], np.int64)
    away = np.where(side == 0, best - price, price - best)
    # The level before on the same side of the same batch: order by batch, side and position.
    order = np.lexsort((np.arange(n), side, at))
    same = np.zeros(n, bool)
    same[1:] = (at[order][1:] == at[order][:-1]) & (side[order][1:] == side[order][:-1])
    before = np.zeros(n, np.int64)
    before[order[1:]] = np.where(same[1:], away[order][:-1], 0)
    in_order = np.ones(n, bool)
    in_order[1:] = (at[1:] != at[:-1]) | (side[:-1] <= side[1:])
    fits = in_order & known & (away >= before)
    run_mode = np.minimum.reduceat(fits.astype(np.int64), first) if n else np.empty(0, np.int64)
    keep = t.select(["session_id", "batch", "pos", "ts_ns", "side", "price_e8", "qty_e8"])
    more = {"best_e8": pa.array(best, mask=~known), "away_e8": pa.array(away, mask=~known), "gap_e8": pa.array(away - before, mask=~known), "run_mode": pa.array(run_mode[at], pa.int64()), "before_ts": pa.array(before_ts[at], pa.int64())}
    for c, v in more.items():
        keep = keep.append_column(c, v)
    return keep


def encoded_slices(levels: DataFrame, size: int = SLICE) -> DataFrame:
    """A row for each slice with its part of every stream of the artifact (sources.artifacts.depth_artifact), checked by reading
    it back. ``levels`` is read several times; its column ``bytes`` is added up."""
    from ..sources import artifacts as A

    unit = lambda c: F.when(F.abs(F.col(c)) > 0, F.abs(F.col(c))).otherwise(1)
    own = gcd_by(levels, ["session_id"], ["price_e8", "qty_e8", "ts_ns"]).select("session_id", F.array(*[unit(c) for c in ("price_e8", "qty_e8", "ts_ns")]).alias("scales"))
    # One row a session, of at most 2 * DEPTH_HOT quantities.
    ranks = hot_by_side(levels).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("side", "code", "qty_e8"))).alias("hot"))
    table = lambda side: F.transform(F.filter(F.coalesce("hot", F.array()), lambda x: x["side"] == side), lambda x: F.call_function("div", x["qty_e8"], F.element_at("scales", 2)))
    known = own.join(ranks, "session_id", "left").select("session_id", "scales", table(0).alias("hot_bids"), table(1).alias("hot_asks"))
    sums = levels.groupBy("session_id", F.expr(f"batch div {size}").alias("slice")).agg(F.sum("bytes").alias("bytes"))
    head = sums.join(known, "session_id").withColumn("side", F.lit(-2).cast("long"))
    rows = sliced(levels, size).unionByName(head, allowMissingColumns=True)

    def run(t: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(_encoded(A, t), schema=_PART)

    return rows.groupBy("session_id", "slice").applyInArrow(run, ", ".join(f"{f.name} {_SPARK[f.type]}" for f in _PART))


_SPARK = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
_PART = pa.schema(
    [("session_id", pa.string()), ("slice", pa.int64())]
    + [(c, pa.list_(pa.int64())) for c in ("scales", "hot_bids", "hot_asks")]
    + [(c, pa.binary()) for c in ("heads", "sides", "deletes", "prices", "codes", "escapes")]
    + [(c, pa.int64()) for c in ("first_ts", "batches", "levels", "explicit", "deleted", "escaped", "runs", "known", "bytes")]
)


def _encoded(A, t: pa.Table) -> list[dict]:
    """The streams of one slice, and none for the mark behind a session's last slice."""
    own = t.filter(pa.compute.equal(t.column("side"), -2)).to_pylist()
    if not own:
        return []
    ps, qs, ts = own[0]["scales"]
    hot = (own[0]["hot_bids"], own[0]["hot_asks"])
    x, n = _modes(t), pa.compute.sum(pa.compute.is_valid(t.column("batch"))).as_py()
    batch, side, price, qty, times, run = (x.column(c).to_numpy() for c in ("batch", "side", "price_e8", "qty_e8", "ts_ns", "run_mode"))
    known = pa.compute.is_valid(x.column("best_e8")).to_numpy()
    away, gap = (x.column(c).fill_null(0).to_numpy() // ps for c in ("away_e8", "gap_e8"))
    first = np.flatnonzero(np.concatenate([[True], batch[1:] != batch[:-1]]))
    before = x.column("before_ts").to_numpy()[first]
    if (times[first] < before).any():
        raise TapeError("corrupt_data", "depth")
    # Heads: time step, levels, run mode and, in run mode, bids and asks.
    count, runs = np.diff(np.append(first, n)), run[first]
    bids = np.add.reduceat((side == 0).astype(np.int64), first)
    at = np.cumsum(3 + 2 * runs) - (3 + 2 * runs)
    heads = np.zeros(int((3 + 2 * runs).sum()), np.int64)
    heads[at], heads[at + 1], heads[at + 2] = times[first] // ts - before // ts, count, runs
    on = runs == 1
    heads[at[on] + 3], heads[at[on] + 4] = bids[on], (count - bids)[on]
    step = np.where(known, away, price // ps)
    prices = np.where(run == 1, gap, (step << 1) ^ (step >> 63))
    # Codes of what is not deleted; a quantity that its side's table lacks is an escape.
    live, lots = qty != 0, qty // qs
    code = np.empty(n, np.int64)
    for s in (0, 1):
        table = np.array(hot[s], np.int64)
        order = np.argsort(table)
        pos = np.minimum(np.searchsorted(table[order], lots), max(len(table) - 1, 0))
        found = np.where(table[order][pos] == lots, order[pos], len(table)) if len(table) else np.zeros(n, np.int64)
        code = np.where(side == s, found, code)
    escape = live & (code == np.where(side == 0, len(hot[0]), len(hot[1])))
    row = {
        "session_id": t.column("session_id")[0].as_py(), "slice": t.column("slice")[0].as_py(), "scales": [ps, qs, ts], "hot_bids": hot[0], "hot_asks": hot[1],
        "heads": K.varints_of(heads), "sides": K.put_bits(side[run == 0]), "deletes": K.put_bits(~live), "prices": K.varints_of(prices), "codes": K.varints_of(code[live]), "escapes": K.varints_of(lots[escape]),
        "first_ts": int(times[0]), "batches": len(first), "levels": n, "explicit": int((run == 0).sum()), "deleted": int((~live).sum()), "escaped": int(escape.sum()), "runs": int(runs.sum()), "known": int(known.sum()), "bytes": own[0]["bytes"],
    }
    sides, deletes = K.bit_bytes(row["sides"], row["explicit"]), K.bit_bytes(row["deletes"], n)
    back = A.depth_batches(_book_at(t), int(before[0]) // ts, len(first), n, (ts, ps, qs), hot, sides, deletes, *(row[c] for c in ("heads", "prices", "codes", "escapes")))
    levels, rows = list(zip(price.tolist(), qty.tolist(), side.tolist())), zip(first.tolist(), [*first[1:].tolist(), n])
    try:
        same = all((levels[i:j], int(times[i])) == x for (i, j), x in zip(rows, back, strict=True))
    except (ValueError, IndexError, TypeError):
        same = False
    if not same:
        raise TapeError("decode_error", "roundtrip check failed")
    return [row]


def with_mode(levels: DataFrame, size: int = SLICE) -> DataFrame:
    """Levels in ticks with their distance (offset) from the best price of their side before the batch, null where the
    side is empty, and the batch's run mode: bids before asks, known bests, offsets from zero up and not falling by side."""
    schema = "session_id string, batch long, pos long, ts_ns long, side long, price_e8 long, qty_e8 long, best_e8 long, away_e8 long, gap_e8 long, run_mode long, before_ts long"
    rows = sliced(levels, size).groupBy("session_id", "slice").applyInArrow(_modes, schema).join(scales(levels), "session_id")
    tick = lambda c: F.expr(f"{c} div price_scale")
    return rows.select(
        "session_id", "batch", "pos", "ts_ns", "side", tick("price_e8").alias("price_tick"), tick("best_e8").alias("best_tick"), tick("away_e8").alias("offset"),
        tick("gap_e8").alias("gap"), "run_mode", "before_ts", "qty_e8", "qty_scale", "time_scale",
    )


def offsets(levels: DataFrame) -> DataFrame:
    """Each level's distance in ticks from the best price of its side before the batch; null where the side is empty."""
    return with_mode(levels).drop("gap", "run_mode", "before_ts")


def run_modes(levels: DataFrame) -> DataFrame:
    return with_mode(levels).groupBy("session_id", "batch").agg(
        F.count("*").alias("level_count"), F.min("run_mode").alias("run_mode"), F.sum((F.col("side") == 0).cast("long")).alias("bid_count"), F.sum(F.col("side")).alias("ask_count")
    )


def offset_gaps(levels: DataFrame) -> DataFrame:
    return with_mode(levels).where("run_mode = 1").select("session_id", "batch", "pos", "side", "offset", "gap")


def hot_by_side(levels: DataFrame) -> DataFrame:
    """The 64 most frequent non-zero quantities of each side of a session, with their codes."""
    hist = levels.where("qty_e8 <> 0").groupBy("session_id", "side", "qty_e8").agg(F.count("*").alias("n"))
    code = F.row_number().over(Window.partitionBy("session_id", "side").orderBy(F.desc("n"), "qty_e8")).cast("long") - 1
    return hist.withColumn("code", code).where(F.col("code") < DEPTH_HOT)


def stats(levels: DataFrame, size: int = SLICE) -> DataFrame:
    """Per session: counters, bytes of the streams and of the artifact. Levels are added up by batch, batches by session."""
    vl, zz = S.varint_length, S.zigzag
    # One row a session: a map of at most 2 * DEPTH_HOT entries, and the size of each side's table.
    entry = F.struct(F.struct("side", "qty_e8").alias("key"), F.col("code").alias("value"))
    count = lambda side: F.sum((F.col("side") == side).cast("long"))
    tables = hot_by_side(levels).groupBy("session_id").agg(F.map_from_entries(F.collect_list(entry)).alias("codes"), count(0).alias("bids"), count(1).alias("asks"))
    rows = with_mode(levels, size).join(tables, "session_id", "left").withColumn("code", F.try_element_at("codes", F.struct("side", "qty_e8")))
    rows = rows.withColumn("table_size", F.when(F.col("side") == 0, F.col("bids")).otherwise(F.col("asks"))).withColumn("hot", F.col("bids") + F.col("asks"))
    live, run = F.col("qty_e8") != 0, F.col("run_mode") == 1
    escape = live & F.col("code").isNull()
    price = F.when(run, vl(F.col("gap"))).when(F.col("offset").isNotNull(), vl(zz(F.col("offset")))).otherwise(vl(zz(F.col("price_tick"))))
    flag = lambda c: F.sum(c.cast("long"))
    per_batch = rows.groupBy("session_id", "batch").agg(
        F.count("*").alias("level_count"), flag(~live).alias("delete_count"), flag(escape).alias("qty_escape_count"), flag(F.col("offset").isNotNull()).alias("offset_price_count"),
        flag(F.col("offset").isNull()).alias("absolute_price_count"), flag(~run).alias("explicit_levels"), F.sum(price).alias("price_bytes"),
        F.sum(F.when(live, vl(F.coalesce("code", "table_size", F.lit(0)))).otherwise(0)).alias("qty_code_bytes"),
        F.sum(F.when(escape, vl(F.expr("qty_e8 div qty_scale"))).otherwise(0)).alias("qty_escape_bytes"),
        F.min("run_mode").alias("run_mode"), flag(F.col("side") == 0).alias("bid_count"), F.sum("side").alias("ask_count"), F.min(F.expr("ts_ns div time_scale - before_ts div time_scale")).alias("dt"), F.max("hot").alias("hot"),
    )
    total = lambda c: F.sum(c).alias(c)
    out = per_batch.groupBy("session_id").agg(
        *[total(c) for c in ("level_count", "delete_count", "qty_escape_count", "offset_price_count", "absolute_price_count", "explicit_levels", "price_bytes", "qty_code_bytes", "qty_escape_bytes")],
        F.count("*").alias("batch_count"), F.sum("run_mode").alias("run_mode_batches"), F.sum(1 - F.col("run_mode")).alias("fallback_batches"),
        F.sum(vl(F.col("dt")) + vl(F.col("level_count")) + 1 + F.when(run, vl(F.col("bid_count")) + vl(F.col("ask_count"))).otherwise(0)).alias("batch_bytes"),
        (F.coalesce(F.max("hot"), F.lit(0)) * 8).alias("hot_table_bytes"),
    )
    out = out.withColumn("side_bytes", S.bit_bytes(F.col("explicit_levels"))).withColumn("delete_bytes", S.bit_bytes(F.col("level_count")))
    out = out.withColumn("raw_runtime_bytes", 8 * F.col("batch_count") + 32 * F.col("level_count"))
    whole = F.lit(176) + F.col("hot_table_bytes") + F.col("batch_bytes") + F.col("side_bytes") + F.col("delete_bytes") + F.col("price_bytes") + F.col("qty_code_bytes") + F.col("qty_escape_bytes")
    return out.drop("explicit_levels").withColumn("encoded_bytes", whole).withColumn("bytes_per_level", S.ratio(F.col("encoded_bytes"), F.col("level_count")))


def final_book(levels: DataFrame) -> DataFrame:
    """Live levels at the end of each session: the last update of each price, unless it deletes."""
    last = levels.groupBy("session_id", "side", "price_e8").agg(F.max(F.struct("batch", "pos", "qty_e8")).alias("x"))
    return last.where("x.qty_e8 <> 0").select("session_id", "side", "price_e8", F.col("x.qty_e8").alias("qty_e8"))
