"""Best bid and ask: scales, deltas, change masks, stream sizes, and the way back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.sequence import gcd_by, prefix_sums, with_previous


def scales(book: DataFrame) -> DataFrame:
    """Per session: bid and ask prices share a scale, both quantities share one, times have theirs."""
    g = gcd_by(book, ["session_id"], ["bid_price_e8", "ask_price_e8", "bid_qty_e8", "ask_qty_e8", "ts_ns"])
    both = lambda a, b: F.array(F.col(a), F.col(b))
    # One row a session is left: the gcd of two numbers by 92 steps of Euclid, enough for any two longs.
    pair = lambda a, b: F.element_at(F.aggregate(F.sequence(F.lit(1), F.lit(92)), both(a, b), lambda x, _: F.when(x[1] == 0, x).otherwise(F.array(x[1], x[0] % F.when(x[1] != 0, x[1])))), 1)
    g = g.select("session_id", pair("bid_price_e8", "ask_price_e8").alias("price"), pair("bid_qty_e8", "ask_qty_e8").alias("qty"), "ts_ns")
    safe = lambda c: S.safe_scale(F.abs(c))
    return g.select("session_id", safe("price").alias("price_scale"), safe("qty").alias("qty_scale"), safe("ts_ns").alias("time_scale"))


def ticks(book: DataFrame) -> DataFrame:
    rows = book.join(scales(book), "session_id")
    return rows.select(
        "session_id", "seq", "price_scale", "qty_scale", "time_scale",
        F.expr("ts_ns div time_scale").alias("t"), F.expr("bid_price_e8 div price_scale").alias("bid"),
        F.expr("(ask_price_e8 - bid_price_e8) div price_scale").alias("spread"),
        F.expr("bid_qty_e8 div qty_scale").alias("bid_qty"), F.expr("ask_qty_e8 div qty_scale").alias("ask_qty"),
    )


FIELDS = ["t", "bid", "spread", "bid_qty", "ask_qty"]


def deltas(book: DataFrame) -> DataFrame:
    """Deltas of each row to the one before; row 0 is the base state with deltas of zero."""
    rows = with_previous(ticks(book), FIELDS)
    return rows.select("session_id", "seq", "chunk", *[(F.col(f) - F.coalesce(F.col(f"prev_{f}"), F.col(f))).alias(f"d_{f}") for f in FIELDS])


def masks(book: DataFrame) -> DataFrame:
    """Four-bit change mask of every row after the first: bid 1, spread 2, bid quantity 4, ask quantity 8."""
    d = deltas(book).where("seq > 0")
    return d.select("session_id", "seq", S.change_mask(F.col("d_bid"), F.col("d_spread"), F.col("d_bid_qty"), F.col("d_ask_qty")).alias("mask"))


def stats(book: DataFrame) -> DataFrame:
    """Per session: counters, bytes of the six streams and of the artifact."""
    d = deltas(book)
    after = F.col("seq") > 0
    size = lambda c: F.sum(F.when(after & (F.col(c) != 0), S.varint_length(S.zigzag(F.col(c)))).otherwise(0))
    changed = lambda c: F.sum((after & (F.col(c) != 0)).cast("long"))
    mask = S.change_mask(F.col("d_bid"), F.col("d_spread"), F.col("d_bid_qty"), F.col("d_ask_qty"))
    out = d.groupBy("session_id").agg(
        F.count("*").alias("record_count"),
        F.sum((after & (mask != 0)).cast("long")).alias("mask_nonzero"),
        changed("d_bid").alias("bid_changed"), changed("d_spread").alias("spread_changed"), changed("d_bid_qty").alias("bid_qty_changed"), changed("d_ask_qty").alias("ask_qty_changed"),
        F.sum(F.when(after, S.varint_length(F.col("d_t"))).otherwise(0)).alias("time_bytes"),
        size("d_bid").alias("bid_bytes"), size("d_spread").alias("spread_bytes"), size("d_bid_qty").alias("bid_qty_bytes"), size("d_ask_qty").alias("ask_qty_bytes"),
    )
    out = out.withColumn("mask_bytes", F.floor(F.col("record_count") / 2).cast("long")).withColumn("raw_runtime_bytes", F.col("record_count") * 40)
    whole = F.lit(160) + F.col("time_bytes") + F.col("mask_bytes") + F.col("bid_bytes") + F.col("spread_bytes") + F.col("bid_qty_bytes") + F.col("ask_qty_bytes")
    return out.withColumn("encoded_bytes", whole).withColumn("bytes_per_record", S.ratio(F.col("encoded_bytes"), F.col("record_count")))


def decode(book: DataFrame) -> DataFrame:
    """Quotes rebuilt from base state and deltas by chunked prefix sums."""
    base = ticks(book).where("seq = 0").select("session_id", "price_scale", "qty_scale", "time_scale", *[F.col(f).alias(f"base_{f}") for f in FIELDS])
    summed = prefix_sums(deltas(book), {f"d_{f}": f"s_{f}" for f in FIELDS}).join(base, "session_id")
    v = lambda f: F.col(f"base_{f}") + F.col(f"s_{f}")
    return summed.select(
        "session_id", "seq", (v("bid") * F.col("price_scale")).alias("bid_price_e8"), (v("bid_qty") * F.col("qty_scale")).alias("bid_qty_e8"),
        ((v("bid") + v("spread")) * F.col("price_scale")).alias("ask_price_e8"), (v("ask_qty") * F.col("qty_scale")).alias("ask_qty_e8"), (v("t") * F.col("time_scale")).alias("ts_ns"),
    )
