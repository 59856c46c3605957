"""Run metrics: derived rates, the latest run of each pipeline and stream, JSON and Prometheus text."""

from __future__ import annotations

import http.server
import os
import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .blocks import last_per_key

COUNTERS = ["input_bytes", "output_bytes", "lines_total", "blocks_total", "encode_ns", "decode_ns", "encode_cycles", "decode_cycles"]
RATES = ["ratio", "encode_mb_per_sec", "decode_mb_per_sec"]


def with_rates(runs: DataFrame) -> DataFrame:
    out = runs.withColumn("ratio", S.ratio(F.col("input_bytes"), F.col("output_bytes")))
    return out.withColumn("encode_mb_per_sec", S.mb_per_second(F.col("input_bytes"), F.col("encode_ns"))).withColumn("decode_mb_per_sec", S.mb_per_second(F.col("input_bytes"), F.col("decode_ns")))


def _label(text):
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def prometheus(runs: DataFrame) -> DataFrame:
    """One line of text exposition per metric of the latest run of each pipeline and stream: name, labels, value."""
    rows = with_rates(last_per_key(runs)).withColumn("success", (F.col("status") == "ok").cast("long")).withColumn("roundtrip", F.col("roundtrip_ok").cast("long"))
    named = [("success", "success"), *[(c, c) for c in COUNTERS], ("roundtrip_ok", "roundtrip")]
    values = [F.struct(F.lit(f"tape_run_{n}").alias("name"), F.col(c).cast("string").alias("value")) for n, c in named]
    values += [F.struct(F.lit(f"tape_run_{c}").alias("name"), F.format_string("%.6f", F.col(c)).alias("value")) for c in RATES]
    labels = F.concat(F.lit('{pipeline="'), _label(F.col("pipeline_id")), F.lit('",stream="'), _label(F.col("stream")), F.lit('"}'))
    out = rows.select(labels.alias("labels"), F.explode(F.array(*values)).alias("m"))
    return out.select(F.concat("m.name", "labels", F.lit(" "), "m.value").alias("line"))


def last_run(runs: DataFrame) -> DataFrame:
    """The same without labels for the latest run of all: its success, counters and rates."""
    rows = with_rates(runs.orderBy(F.desc("run_no")).limit(1)).withColumn("success", (F.col("status") == "ok").cast("long"))
    values = [F.struct(F.lit(f"tape_{n}").alias("name"), F.col(c).cast("string").alias("value")) for n, c in (("last_run_success", "success"), *((c, c) for c in COUNTERS))]
    values += [F.struct(F.lit(f"tape_{c}").alias("name"), F.format_string("%.6f", F.col(c)).alias("value")) for c in RATES]
    return rows.select(F.explode(F.array(*values)).alias("m")).select(F.concat("m.name", F.lit(" "), "m.value").alias("line"))


class MetricsServer:
    """Loopback server of /metrics and /-/ready; TAPE_METRICS_PORT (8081) and TAPE_METRICS_MODE=off."""

    def __init__(self, render, port: int | None = None):
        self.render, self.port = render, int(os.environ.get("TAPE_METRICS_PORT", 8081)) if port is None else port
        self.server: http.server.ThreadingHTTPServer | None = None

    def start(self) -> bool:
        if os.environ.get("TAPE_METRICS_MODE") == "off":
            return False
        render = self.render

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                body = {"/metrics": render, "/-/ready": lambda: "ready\n"}.get(self.path)
                self.send_response(200 if body else 404)
                self.send_header("Content-Type", "text/plain; version=0.0.4")
                self.end_headers()
                self.wfile.write((body() if body else "not found\n").encode())

            def log_message(self, *args):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", self.port), Handler)
        self.port = self.server.server_address[1]
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return True

    def stop(self) -> None:
        if self.server:
            self.server.shutdown()
            self.server.server_close()
