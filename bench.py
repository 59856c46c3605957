"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from tapeworks.plans.catalogue import QUERIES
from tapeworks.session import get_session

NAMES = ["trades_price_groups", "trades_hot_capacity_cost", "trades_stream_sizes", "bookticker_masks", "bookticker_decode", "depth_best_before", "depth_stats", "verify_records_exact", "codec_roundtrip_zstd"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session("bench", cpus, **{"spark.sql.shuffle.partitions": str(2 * cpus), "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["bookticker_masks"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in NAMES:
        began = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
