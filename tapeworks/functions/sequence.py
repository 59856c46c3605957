"""Ordered-stream helpers that stay partitioned by (session, chunk).

Rows carry (session_id, seq). A chunk is a fixed run of seq, so windows run inside chunks and never over a session.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..schema import CHUNK_RECORDS

KEY = ["session_id", "chunk"]


def chunked(df: DataFrame, records: int = CHUNK_RECORDS) -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col("seq") / records).cast("long"))


def ranked(df: DataFrame, key: str, order: list[str], name: str, dense: bool = False, records: int = CHUNK_RECORDS) -> DataFrame:
    """Adds ``name``, the rank from 0 of each row in its session by ``order``, whose first column rises with the whole number ``key``.

    No window spans a session: its range of keys is cut into equal parts of about ``records`` rows, rows are numbered in
    their part, and parts start where the counts of those before them end. Rows of one key stay together. ``dense`` gives
    equal rows equal ranks.
    """
    rows = df.withColumn("_s", F.coalesce("session_id", F.lit("")))
    # One row a session.
    spans = rows.groupBy("_s").agg(F.min(key).alias("_low"), F.max(key).alias("_high"), F.count("*").alias("_n"))
    spans = spans.select("_s", "_low", F.expr(f"(_high - _low) div greatest(_n div {records}, 1) + 1").alias("_width"))
    rows = rows.join(F.broadcast(spans), "_s").withColumn("_part", F.coalesce(F.expr(f"({key} - _low) div _width"), F.lit(-1))).drop("_low", "_width")
    seen = rows.select("_s", "_part", *order).distinct() if dense else rows
    ahead = Window.partitionBy("_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = seen.groupBy("_s", "_part").agg(F.count("*").alias("_n")).select("_s", "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    rank = (F.dense_rank() if dense else F.row_number()).over(Window.partitionBy("_s", "_part").orderBy(*order))
    return rows.join(bases, ["_s", "_part"]).withColumn(name, (F.col("_base") + rank - 1).cast("long")).drop("_s", "_part", "_base")


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """Each session whole in one task, its rows in order. Rows are dealt out by a hash of the session: a repartition by a column
    that a join below has dealt out by is dropped from the plan, and adaptive execution may then read that join in pieces."""
    return df.repartition(F.xxhash64("session_id")).sortWithinPartitions("session_id", *order)


def by_chunk(*order: str):
    return Window.partitionBy(*KEY).orderBy(*(order or ("seq",)))


def with_previous(df: DataFrame, columns: list[str], records: int = CHUNK_RECORDS) -> DataFrame:
    """Adds prev_<column> of the row before in the session (null for the first).

    The last row of each chunk is handed to the next chunk as a halo row, so that no window spans a session.
    """
    own = chunked(df, records).withColumn("_halo", F.lit(False))
    halo = own.where(F.col("seq") % records == records - 1).withColumn("chunk", F.col("chunk") + 1).withColumn("_halo", F.lit(True))
    both = own.unionByName(halo)
    for c in columns:
        both = both.withColumn(f"prev_{c}", F.lag(c).over(by_chunk()))
    return both.where(~F.col("_halo")).drop("_halo")


def prefix_sums(df: DataFrame, columns: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """Inclusive running sums over a session of chunked rows: sums inside chunks plus the prefix of chunk totals."""
    keys = keys or ["session_id"]
    inner = Window.partitionBy(*keys, "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "chunk").agg(*[F.sum(c).alias(f"_t_{o}") for c, o in columns.items()])
    bases = totals.select(*keys, "chunk", *[F.coalesce(F.sum(f"_t_{o}").over(outer), F.lit(0)).cast("long").alias(f"_b_{o}") for o in columns.values()])
    out = df.join(bases, [*keys, "chunk"])
    for c, o in columns.items():
        out = out.withColumn(o, (F.sum(c).over(inner) + F.col(f"_b_{o}")).cast("long")).drop(f"_b_{o}")
    return out


@F.pandas_udf(LongType())
def gcd_agg(v: pd.Series) -> int:
    """Greatest common divisor of a group; 0 for an empty one."""
    return int(np.gcd.reduce(v.to_numpy(np.int64))) if len(v) else 0


def gcd_by(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """gcd of each column by key. Each Arrow batch gives one row a key, so only those are dealt out; gcds of gcds follow."""
    rows = df.select(*keys, *columns)

    def partial(batches):
        for b in batches:
            found = b.to_pandas().groupby(keys, sort=False)[columns].agg(lambda v: np.gcd.reduce(v.to_numpy(np.int64)))
            yield pa.RecordBatch.from_pandas(found.reset_index(), schema=b.schema, preserve_index=False)

    return rows.mapInArrow(partial, rows.schema).groupBy(*keys).agg(*[gcd_agg(c).alias(c) for c in columns])
