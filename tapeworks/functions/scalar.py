"""Column expressions of the codecs: everything stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1))))


def varint_length(v: Column) -> Column:
    """Bytes of an unsigned LEB128 number; negative longs are their 64-bit pattern."""
    return F.floor((F.length(F.bin(v)) + 6) / 7).cast("long")


def bit_bytes(n: Column) -> Column:
    """Bytes that n packed bits take."""
    return F.floor((n + 7) / 8).cast("long")


def safe_scale(g: Column) -> Column:
    return F.when(g <= 0, F.lit(1)).otherwise(g).cast("long")


def change_mask(bid: Column, spread: Column, bid_qty: Column, ask_qty: Column) -> Column:
    bit = lambda c, w: F.when(c != 0, F.lit(w)).otherwise(F.lit(0))
    return (bit(bid, 1) + bit(spread, 2) + bit(bid_qty, 4) + bit(ask_qty, 8)).cast("long")


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / F.when(bottom != 0, bottom.cast("double")))


def mb_per_second(size: Column, ns: Column) -> Column:
    return F.when(ns == 0, F.lit(0.0)).otherwise((size / F.lit(1048576.0)) / (F.when(ns != 0, ns) / F.lit(1e9)))


def line_count(text: Column) -> Column:
    """Line feeds, and one more for an unterminated last line."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (feeds + F.when((F.length(text) > 0) & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("long")


def line_ending(text: Column) -> Column:
    """lf or crlf by the first line feed; lf where there is none."""
    at = F.instr(text, "\n")
    return F.when((at > 1) & (F.substring(text, at - 1, F.lit(1)) == "\r"), "crlf").otherwise("lf")


def preview(text: Column, offset: Column) -> Column:
    """32 characters from offset on; quotes, backslashes and what does not print become dots."""
    return F.regexp_replace(F.substring(text, offset.cast("int") + 1, F.lit(32)), r'[^ !#-\[\]-~]', ".")


def line_of(stream: str) -> Column:
    """Canonical JSONL text of a record, without spaces."""
    if stream == "trades":
        return F.concat(F.lit("["), F.concat_ws(",", "price_e8", "qty_e8", "side", "ts_ns"), F.lit("]"))
    if stream == "bookticker":
        return F.concat(F.lit("["), F.concat_ws(",", "bid_price_e8", "bid_qty_e8", "ask_price_e8", "ask_qty_e8", "ts_ns"), F.lit("]"))
    each = F.transform("levels", lambda x: F.concat(F.lit("["), F.concat_ws(",", x["price_e8"], x["qty_e8"], x["side"]), F.lit("]")))
    return F.concat(F.lit("["), F.array_join(each, ","), F.lit(","), F.col("ts_ns").cast("string"), F.lit("]"))


def stream_of_path(path: Column, any_case: bool = True) -> Column:
    """Stream by file name, or unknown."""
    base = F.element_at(F.split(path, "/"), -1)
    base = F.lower(base) if any_case else base
    out = F.lit("unknown")
    for s in ("trades", "bookticker", "depth"):
        out = F.when(base == f"{s}.jsonl", s).otherwise(out)
    return out


def session_of_path(path: Column) -> Column:
    """Parent directory; grandparent where the parent is called jsonl; manual_<stem> where there is none."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    parent = F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2))
    grand = F.when(F.size(parts) >= 3, F.get(parts, F.size(parts) - 3))
    return F.coalesce(F.when(parent == "jsonl", grand).otherwise(parent), F.concat(F.lit("manual_"), stem))
