"""Text to typed records: strict validation, replay parsing and the looser lab rules.

Grammars are anchored regular expressions, since JSON parsing by from_json accepts trailing text. Integers are checked
for the 64-bit range by try_cast; space, tab and carriage return may stand between tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S

_W = r"[ \t\r]*"
_INT = r"-?(?:0|[1-9][0-9]*)"
_SEP = f"{_W},{_W}"


def _ints(n: int) -> str:
    return rf"^{_W}\[{_W}{_SEP.join([_INT] * n)}{_W}\]{_W}$"


_LEVEL = rf"\[{_W}{_SEP.join([_INT] * 3)}{_W}\]"
GRAMMAR = {
    "trades": _ints(4),
    "bookticker": _ints(5),
    "depth": rf"^{_W}\[{_W}(?:{_LEVEL}{_SEP})+{_INT}{_W}\]{_W}$",
    # the zstd container lets a depth line without levels pass
    "depth_loose": rf"^{_W}\[{_W}(?:{_LEVEL}{_SEP})*{_INT}{_W}\]{_W}$",
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """session_id, stream, file, value of canonical files; the order inside a file is the reader's, see ``numbered``."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("_at"))
    return rows.select(S.session_of_path(F.col("file")).alias("session_id"), S.stream_of_path(F.col("file")).alias("stream"), "file", "value", "block_start", "_at")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds line_no, 1-based inside each file: splits of a file come in block order, lines in reading order."""
    from pyspark.sql import Window

    inner = Window.partitionBy("file", "block_start").orderBy("_at")
    counts = rows.groupBy("file", "block_start").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("file").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("file", "block_start", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    out = rows.withColumn("_n", F.row_number().over(inner)).join(base, ["file", "block_start"])
    return out.withColumn("line_no", (F.col("base") + F.col("_n")).cast("long")).drop("_n", "base", "block_start", "_at")


def _longs(line: Column) -> Column:
    return F.transform(F.regexp_extract_all(line, F.lit(f"({_INT})"), F.lit(1)), lambda x: x.try_cast("bigint"))


def strict_ok(line: Column, stream: str, loose_depth: bool = False, v: Column | None = None) -> Column:
    """Whether a line meets the strict grammar: arity, integers in range, sides 0 or 1. A blank line does not. ``v`` are its numbers,
    where a column has them."""
    grammar = GRAMMAR["depth_loose" if stream == "depth" and loose_depth else stream]
    v = _longs(line) if v is None else v
    in_range = ~F.exists(v, lambda x: x.isNull())
    if stream == "trades":
        sides = F.get(v, F.lit(2)).isin(0, 1)
    elif stream == "depth":
        sides = F.forall(F.transform(v, lambda x, i: F.when((i % 3 == 2) & (i < F.size(v) - 1), x).otherwise(F.lit(0))), lambda x: x.isin(0, 1))
    else:
        sides = F.lit(True)
    return F.when(line.rlike(grammar), F.coalesce(in_range & sides, F.lit(False))).otherwise(F.lit(False))


def replay_records(text: DataFrame, stream: str, line: str = "line") -> DataFrame:
    """Typed columns as a replay gives them: blank lines are skipped, a line that is no record is corrupt data."""
    some = text.where(F.length(F.trim(F.col(line))) > 0)
    bad = F.raise_error(F.concat(F.lit("corrupt_data: "), F.col(line)))
    return parse(some.withColumn(line, F.when(strict_ok(F.col(line), stream), F.col(line)).otherwise(bad)), stream, line)


def parse(text: DataFrame, stream: str, line: str = "line") -> DataFrame:
    """Typed columns of each line; all null where the line is not valid. Other columns stay.

    Numbers are extracted once, into a column of their own: inside ``transform`` the pattern would run again for every level.
    """
    rows = text.withColumn("_v", _longs(F.col(line))).withColumn("_ok", strict_ok(F.col(line), stream, v=F.col("_v")))
    ok, v = F.col("_ok"), F.col("_v")
    if stream == "depth":
        n = F.floor((F.size(v) - 1) / 3).cast("int")
        level = lambda i: F.struct(F.get(v, i * 3).alias("price_e8"), F.get(v, i * 3 + 1).alias("qty_e8"), F.get(v, i * 3 + 2).alias("side"))
        rows = rows.withColumn("levels", F.when(ok, F.transform(F.sequence(F.lit(0), n - 1), level))).withColumn("ts_ns", F.when(ok, F.element_at(v, -1)))
        return rows.drop("_v", "_ok")
    names = ["price_e8", "qty_e8", "side", "ts_ns"] if stream == "trades" else ["bid_price_e8", "bid_qty_e8", "ask_price_e8", "ask_qty_e8", "ts_ns"]
    for i, name in enumerate(names):
        rows = rows.withColumn(name, F.when(ok, F.get(v, F.lit(i))))
    return rows.drop("_v", "_ok")


def transform_problem(records: DataFrame, stream: str) -> DataFrame:
    """Per session the number of records a transform rejects: order of time, and signs for trades."""
    from ..functions.sequence import with_previous

    rows = with_previous(records, ["ts_ns"])
    bad = F.coalesce(F.col("ts_ns") < F.col("prev_ts_ns"), F.lit(False))
    if stream == "trades":
        bad = bad | (F.col("price_e8") <= 0) | (F.col("qty_e8") <= 0)
    return rows.groupBy("session_id").agg(F.count("*").alias("record_count"), F.sum(bad.cast("long")).alias("rejected"))
