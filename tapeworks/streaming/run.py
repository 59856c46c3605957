"""Runs a stateful operator over a table replayed as a file stream, to the end of what is there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; in local mode below a temporary one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or tempfile.mkdtemp(prefix="tapeworks-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


#: Rows of a micro-batch: a task holds those of one session.
STEP_ROWS = 1 << 22


def replay(table: DataFrame, order: str, operator: Callable[[DataFrame], DataFrame], slices: int = 3, rows: int = STEP_ROWS) -> DataFrame:
    """Writes ``table`` in steps of ``order``, streams one step a micro-batch through ``operator`` and returns its rows. There are
    ``slices`` steps, or as many as keep a step at about ``rows`` rows."""
    spark = table.sparkSession
    base = shared_folder(spark)
    table.write.parquet(f"{base}/table")
    held = spark.read.schema(table.schema).parquet(f"{base}/table")
    top, n = held.agg(F.max(order), F.count("*")).first()
    slices = max(slices, -(-n // rows))
    width = (top or 0) // slices + 1
    # A step is dealt out in parts, so that no task holds one; steps are copied in order, as the stream takes files by age.
    cut = held.withColumn("_step", F.expr(f"{order} div {width}"))
    cut.repartition(F.col("_step"), F.pmod(F.hash(order), F.lit(8))).write.partitionBy("_step").parquet(f"{base}/steps")
    steps = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in table.schema)}, _step long").parquet(f"{base}/steps")
    for i in range(slices):
        steps.where(F.col("_step") == i).select(*table.columns).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    out = operator(stream)
    query = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")
