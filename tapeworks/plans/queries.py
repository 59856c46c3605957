"""Queries over the derived streams, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.kernels import PROFILES
from ..operators import artifacts, blocks, bookticker, catalog, depth, lab, metrics, pipelines, trades, verify
from ..schema import STATUSES
from ..sources import derive, files, jsonl
from ..streaming import book as streamed
from ..streaming.run import replay, shared_folder

BLOCK = 65_536


def _t(s: SparkSession, d: str) -> DataFrame:
    return derive.trades(s, d)


def _b(s: SparkSession, d: str) -> DataFrame:
    return derive.bookticker(s, d)


def _l(s: SparkSession, d: str) -> DataFrame:
    return derive.depth_levels(s, d)


def _lines(s: SparkSession, d: str, stream: str) -> DataFrame:
    return blocks.lines(derive.stream(s, d, stream), stream)


def _dirty(s: SparkSession) -> DataFrame:
    """Valid and invalid lines of each stream."""
    rows = [
        ("trades", "[1,2,1,100]"), ("trades", "[ 1 ,\t2, 0,100 ]\r"), ("trades", "[1,2,2,100]"), ("trades", "[1,2,1]"), ("trades", "[1,2,1,100,5]"), ("trades", "[1,2.5,1,100]"),
        ("trades", '["1",2,1,100]'), ("trades", "[1,2,1,100] x"), ("trades", ""), ("trades", "[+1,2,1,100]"), ("trades", "[-1,2,1,100]"), ("trades", "[9223372036854775808,2,1,100]"), ("trades", "[01,2,1,100]"),
        ("bookticker", "[100,10,110,20,1000]"), ("bookticker", "[100,10,110,20]"), ("bookticker", "[100,-10,110,20,1000]"),
        ("depth", "[[100,10,0],[110,20,1],1000]"), ("depth", "[123]"), ("depth", "[]"), ("depth", "[[100,10,2],1000]"), ("depth", "[[[100,1,0,0]],[[101,2,1,0]],123]"), ("depth", "[[100,10],1000]"), ("depth", "[[100,0,0], [99,7,0],\t1002]"),
    ]
    return s.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, stream string, line string")


def jsonl_strict_validation(s: SparkSession, d: str) -> DataFrame:
    """The dirty lines, and all canonical lines of the three streams."""
    rows = _dirty(s).select(F.lit("dirty").alias("origin"), "id", "stream", "line")
    for stream in ("trades", "bookticker", "depth"):
        rows = rows.unionByName(_lines(s, d, stream).select(F.col("session_id").alias("origin"), F.col("seq").alias("id"), F.lit(stream).alias("stream"), "line"))
    ok, loose = F.lit(False), F.lit(False)
    for stream in ("trades", "bookticker", "depth"):
        ok = F.when(F.col("stream") == stream, jsonl.strict_ok(F.col("line"), stream)).otherwise(ok)
        loose = F.when(F.col("stream") == stream, jsonl.strict_ok(F.col("line"), stream, loose_depth=True)).otherwise(loose)
    return rows.select("origin", "id", "stream", "line", ok.alias("strict_ok"), loose.alias("zstd_ok"))


def trades_parse_roundtrip(s: SparkSession, d: str) -> DataFrame:
    return jsonl.parse(_lines(s, d, "trades"), "trades").drop("line")


def depth_parse_levels(s: SparkSession, d: str) -> DataFrame:
    return derive.explode_levels(jsonl.parse(_lines(s, d, "depth"), "depth"))


def trades_monotonic_check(s: SparkSession, d: str) -> DataFrame:
    return jsonl.transform_problem(_t(s, d), "trades")


def trades_qty_histogram(s: SparkSession, d: str) -> DataFrame:
    return trades.quantity_ranks(_t(s, d))


def blocks_layout(s: SparkSession, d: str) -> DataFrame:
    return blocks.block_table(_lines(s, d, "trades"), BLOCK)


def replay_batches(s: SparkSession, d: str) -> DataFrame:
    return blocks.replay_batches(_lines(s, d, "trades"))


def replay_time_span(s: SparkSession, d: str) -> DataFrame:
    each = [blocks.time_span(derive.stream(s, d, x)).select(F.lit(x).alias("stream"), "session_id", "time_span_ns") for x in ("trades", "bookticker", "depth")]
    return each[0].unionByName(each[1]).unionByName(each[2])


def _mutated(lines: DataFrame) -> DataFrame:
    """A later time on every thousandth line, spaces on others, and each session's first line gone from the end."""
    stamp = F.regexp_replace("line", r"000\]$", "001]")
    line = F.when(F.col("seq") % 1000 == 7, stamp).when(F.col("seq") % 1000 == 11, F.replace("line", F.lit(","), F.lit(", "))).otherwise(F.col("line"))
    return lines.select("session_id", "seq", line.alias("line"))


def verify_records_exact(s: SparkSession, d: str) -> DataFrame:
    canonical = _lines(s, d, "trades")
    return verify.summary(canonical, blocks.lines(trades.decode(_t(s, d)), "trades"), "trades", block_bytes=BLOCK)


def verify_records_mutated(s: SparkSession, d: str) -> DataFrame:
    canonical = _lines(s, d, "trades")
    return verify.records(canonical, _mutated(canonical), "trades").where("field is not null").select("session_id", "line_no", "field")


def _verify_bytes(stream: str):
    """Whole streams with later times, spaces and, in ``_mutated``, all bytes behind them moved."""

    def query(s: SparkSession, d: str) -> DataFrame:
        canonical = _lines(s, d, stream)
        return verify.summary(canonical, _mutated(canonical), stream, block_bytes=BLOCK)

    return query


def verify_modes(s: SparkSession, d: str) -> DataFrame:
    """One pair of streams under the three modes; the decoded one lacks its last tenth."""
    canonical = _lines(s, d, "bookticker")
    short = canonical.join(canonical.groupBy("session_id").agg(F.count("*").alias("n")), "session_id").where(F.col("seq") * 10 < F.col("n") * 9).drop("n")
    each = [verify.summary(canonical, short, "bookticker", mode, BLOCK).withColumn("mode", F.lit(mode)) for mode in verify.MODES]
    return each[0].unionByName(each[1]).unionByName(each[2])


def verify_missing_extra(s: SparkSession, d: str) -> DataFrame:
    canonical = _lines(s, d, "bookticker")
    decoded = canonical.where("seq % 97 <> 5").unionByName(canonical.where("seq % 89 = 3").withColumn("seq", F.col("seq") + 1_000_000))
    return verify.records(canonical, decoded, "bookticker").where("field is not null").groupBy("session_id", "field").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


def pipeline_catalog(s: SparkSession, d: str) -> DataFrame:
    return catalog.frame(s)


def pipeline_availability(s: SparkSession, d: str) -> DataFrame:
    return catalog.frame(s).groupBy("availability").agg(F.count("*").alias("n"))


def status_strings(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame(list(enumerate(STATUSES)), "code long, status string")


def _runs(s: SparkSession, d: str) -> DataFrame:
    """Runs made from orders: one run an order, two pipelines by key, three streams by priority."""
    o = s.read.parquet(f"{d}/orders.parquet")
    pipeline = F.when(F.col("o_orderkey") % 2 == 0, "std.zstd_jsonl_blocks_v1").otherwise("std.gzip_jsonl_blocks_v1")
    stream = F.element_at(F.array(F.lit("trades"), F.lit("bookticker"), F.lit("depth")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    k = F.col("o_orderkey")
    return o.select(
        k.alias("run_no"), pipeline.alias("pipeline_id"), stream.alias("stream"), F.when(k % 11 == 0, "decode_error").otherwise("ok").alias("status"),
        (k * 1000).alias("input_bytes"), (k % 7 * 100).alias("output_bytes"), k.alias("lines_total"), (k % 5).alias("blocks_total"), (k % 13 * 1_000_000).alias("encode_ns"),
        (k % 17 * 1_000_000).alias("decode_ns"), (k * 3).alias("encode_cycles"), (k * 2).alias("decode_cycles"), (k % 11 != 0).alias("roundtrip_ok"),
    )


def run_matrix_latest(s: SparkSession, d: str) -> DataFrame:
    out = metrics.with_rates(blocks.last_per_key(_runs(s, d)))
    return out.select("pipeline_id", "stream", "run_no", "status", "input_bytes", "output_bytes", *[F.round(c, 6).alias(c) for c in metrics.RATES])


def prometheus_lines(s: SparkSession, d: str) -> DataFrame:
    return metrics.prometheus(_runs(s, d))


def _codec(name: str):
    """Blocks of all three streams."""

    def query(s: SparkSession, d: str) -> DataFrame:
        each = [_lines(s, d, x).withColumn("session_id", F.concat("session_id", F.lit(f"/{x}"))) for x in ("trades", "bookticker", "depth")]
        out = blocks.compress_blocks(each[0].unionByName(each[1]).unionByName(each[2]), name, 3, BLOCK)
        return out.groupBy("session_id").agg(F.count("*").alias("block_count"), F.sum("uncompressed_bytes").alias("input_bytes"), F.sum("line_count").alias("line_count"), F.min("roundtrip_ok").alias("roundtrip_ok"))

    query.__name__ = f"codec_roundtrip_{name}"
    return query


def _artifact(stream: str):
    """Records of a stream after a way through its transform artifact."""

    def query(s: SparkSession, d: str) -> DataFrame:
        return artifacts.decode_lines(artifacts.encode(_lines(s, d, stream), stream))

    return query


def _entropy(stream: str, profile: str):
    """Per session: lines and bytes of the text that comes back from the entropy envelope, and whether it is the same."""

    def query(s: SparkSession, d: str) -> DataFrame:
        lines = _lines(s, d, stream)
        back = artifacts.decode_lines(artifacts.encode(lines, stream, profile)).withColumnRenamed("line", "back")
        both = lines.join(back, ["session_id", "seq"], "full_outer")
        return both.groupBy("session_id").agg(F.count("back").alias("line_count"), F.sum(F.octet_length("back") + 1).cast("long").alias("input_bytes"), F.min(F.col("line").eqNullSafe(F.col("back"))).alias("exact"))

    return query


def _inspect(stream: str):
    """Header counters of each session's artifact; they equal what the relational form counts."""
    fields = {"trades": ["record_count", "chunk_count", "time_groups", "price_groups", "qty_escapes"], "bookticker": ["record_count", "encoded_bytes", "mask_nonzero", "time_bytes", "mask_bytes", "bid_bytes"], "depth": ["batch_count", "level_count", "encoded_bytes", "delete_count", "run_mode_batches", "price_bytes"]}[stream]

    def query(s: SparkSession, d: str) -> DataFrame:
        out = artifacts.inspect(artifacts.encode(_lines(s, d, stream), stream))
        return out.select("session_id", *[F.get_json_object("header", f"$.{f}").cast("long").alias(f) for f in fields])

    return query


def _hashes(stream: str):
    return lambda s, d: verify.hashes(_lines(s, d, stream), stream)


def stream_book(s: SparkSession, d: str) -> DataFrame:
    return replay(_l(s, d), "batch", streamed.best_before)


def stream_delta(s: SparkSession, d: str) -> DataFrame:
    return replay(_b(s, d), "seq", streamed.quote_deltas)


def _root(s: SparkSession) -> str:
    return shared_folder(s)


def _containers(s: SparkSession, d: str, stream: str, codec: str) -> tuple[DataFrame, str]:
    """Containers of a stream written below a new shared folder: a row for each, and the folder."""
    root, row = _root(s), catalog.find(f"std.{codec}_jsonl_blocks_v1")
    packed = blocks.compress_blocks(_lines(s, d, stream), codec, 3, BLOCK).drop("roundtrip_ok")
    out = files.write_containers(packed, root, row["slug"], row["extension"], stream, blocks.CODECS[codec].wire_id, BLOCK)
    done = s.createDataFrame(out.collect(), out.schema)  # a row for each file that was written
    return done, root


def _container(stream: str, codec: str):
    """Canonical lines after a way through container files and the block source."""

    def query(s: SparkSession, d: str) -> DataFrame:
        _, root = _containers(s, d, stream, codec)
        return files.lines_of_blocks(files.read_blocks(s, root))

    return query


def container_files(s: SparkSession, d: str) -> DataFrame:
    """What the writer reports and what the headers say."""
    done, _ = _containers(s, d, "trades", "raw")
    heads = files.scan(s, done.first()["path"].split("/raw-jsonl/")[0], "*.hfr").select("session_id", "artifact")
    head = artifacts.inspect(heads).select("session_id", *[F.get_json_object("header", f"$.{c}").cast("long").alias(f"head_{c}") for c in ("input_bytes", "line_count", "block_count")])
    return done.select("session_id", "input_bytes", "output_bytes", "line_count", "block_count").join(head, "session_id")


def container_block_index(s: SparkSession, d: str) -> DataFrame:
    """The index of all blocks but each session's first; the filter reaches the source, payloads are not read."""
    _, root = _containers(s, d, "trades", "zstd")
    return files.read_blocks(s, root, payload=False).where("block >= 1").select("session_id", "stream", "codec", "block", "first_byte_offset", "uncompressed_bytes", "line_count")


def container_replay(s: SparkSession, d: str) -> DataFrame:
    """Record batches of containers that are streamed block by block, lines carried over block ends."""
    done, _ = _containers(s, d, "trades", "gzip")
    return files.replayed(done, "trades").select("session_id", "batch", "record_count", "first_line_number", (F.col("last_ts") - F.col("first_ts")).alias("span_ns"))


def _pipeline(stream: str, pipeline_id: str):
    """A pipeline by id from canonical lines to files, and the files verified against the lines."""

    def query(s: SparkSession, d: str) -> DataFrame:
        root, canonical = _root(s), _lines(s, d, stream)
        made = pipelines.compress(canonical, stream, pipeline_id, root, block_bytes=BLOCK).select("session_id", "pipeline_id", "line_count", "input_bytes")
        checked = pipelines.decode_and_verify(canonical, stream, pipeline_id, root, block_bytes=BLOCK)
        return made.join(checked.select("session_id", "status", "byte_exact", "record_exact", "decoded_record_count", "decoded_bytes", "mismatch_bytes", "verified"), "session_id")

    return query


def _artifact_files(stream: str):
    """Canonical lines after transform artifacts were written as files and read back by Spark's binary scan."""

    def query(s: SparkSession, d: str) -> DataFrame:
        root, row = _root(s), next(r for r in map(dict, (zip(catalog.COLUMNS, x) for x in catalog.rows())) if r["stream_scope"] == stream and r["entropy"] == "none" and r["extension"])
        files.write_artifacts(artifacts.encode(_lines(s, d, stream), stream), root, row["slug"], row["extension"], stream).collect()
        return artifacts.decode_lines(files.scan(s, f"{root}/{row['slug']}", "*.cxcef"))

    return query


def _text_files(s: SparkSession, d: str, stream: str) -> str:
    root = _root(s)
    files.write_text(_lines(s, d, stream), root, stream).collect()
    return root


def text_files(s: SparkSession, d: str) -> DataFrame:
    """Canonical files written and read again: session and stream from the path, line numbers from the reader."""
    rows = jsonl.numbered(jsonl.read_lines(s, _text_files(s, d, "bookticker") + "/*/*.jsonl"))
    return rows.select("session_id", "stream", "line_no", F.col("value").alias("line"))


def _lab(codec_id: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        root = _text_files(s, d, "bookticker")
        out = lab.compress_files(s, root, f"{root}/lab", codec_id)
        back = lab.verify_files(s, f"{root}/lab", root, codec_id) if out.count() else None
        return back.select("session_id", "stream", "status", "byte_exact", "record_exact", "mismatch_bytes").join(out.select("session_id", "input_bytes", "record_count"), "session_id")

    return query


def line_functions(s: SparkSession, d: str) -> DataFrame:
    """Line counts, line endings and previews of whole documents (their ASCII part) and of text with other line ends."""
    docs = s.read.parquet(f"{d}/documents.parquet")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7f]", "")
    text = F.when(F.col("doc_id") % 2 == 0, F.replace(plain, F.lit("\n"), F.lit("\r\n"))).otherwise(plain)
    rows = docs.select("doc_id", text.alias("x"))
    return rows.select("doc_id", S.line_count(F.col("x")).alias("line_count"), S.line_ending(F.col("x")).alias("line_ending"), S.preview(F.col("x"), F.col("doc_id") % 50).alias("preview"))


def last_run_lines(s: SparkSession, d: str) -> DataFrame:
    return metrics.last_run(_runs(s, d))


def _stats_view(stream: str):
    """Fields of the statistics view, by pipeline id."""
    ids = {"trades": "tick.trades_grouped_delta_qtydict_math_v3", "bookticker": "tick.bookticker_delta_mask_v2", "depth": "tick.depth_ladder_offset_v3"}
    fields = {"trades": ["record_count", "chunk_count", "encoded_bytes", "dp_zero_count"], "bookticker": ["record_count", "encoded_bytes", "raw_runtime_bytes"], "depth": ["batch_count", "total_level_count", "encoded_bytes", "delete_count"]}[stream]

    def query(s: SparkSession, d: str) -> DataFrame:
        shown = artifacts.views(artifacts.encode(_lines(s, d, stream), stream), "stats", ids[stream])
        return shown.select("session_id", F.get_json_object("view", "$.pipeline_id").alias("pipeline_id"), *[F.get_json_object("view", f"$.{f}").cast("long").alias(f) for f in fields])

    return query


PIPELINE_RUNS = (
    ("zstd", "trades", "std.zstd_jsonl_blocks_v1"), ("gzip", "depth", "std.gzip_jsonl_blocks_v1"), ("raw", "bookticker", "std.raw_jsonl_blocks_v1"),
    ("transform", "trades", "tick.trades_grouped_delta_qtydict_math_v3"), ("transform", "bookticker", "tick.bookticker_delta_mask_v2"), ("transform", "depth", "tick.depth_ladder_offset_v3"),
)


def _named(name: str, f) -> tuple:
    return name, f


QUERIES = dict([
    _named("trades_canonical", lambda s, d: _lines(s, d, "trades")),
    _named("bookticker_canonical", lambda s, d: _lines(s, d, "bookticker")),
    _named("depth_canonical", lambda s, d: _lines(s, d, "depth")),
    _named("trades_chunk_scales", lambda s, d: trades.scales(_t(s, d))),
    _named("trades_time_groups", lambda s, d: trades.time_groups(_t(s, d))),
    _named("trades_price_groups", lambda s, d: trades.price_groups(_t(s, d))),
    _named("trades_hot_capacity_cost", lambda s, d: trades.capacity_costs(_t(s, d))),
    _named("trades_hot_capacity", lambda s, d: trades.hot_capacity(_t(s, d))),
    _named("trades_hot_dictionary", lambda s, d: trades.hot_dictionary(_t(s, d))),
    _named("trades_qty_codes", lambda s, d: trades.quantity_codes(_t(s, d))),
    _named("trades_stream_sizes", lambda s, d: trades.stream_sizes(_t(s, d))),
    _named("trades_stats", lambda s, d: trades.stats(_t(s, d))),
    _named("trades_decode_prefix_sum", lambda s, d: trades.decode(_t(s, d))),
    _named("bookticker_scales", lambda s, d: bookticker.scales(_b(s, d))),
    _named("bookticker_deltas", lambda s, d: bookticker.deltas(_b(s, d))),
    _named("bookticker_masks", lambda s, d: bookticker.masks(_b(s, d))),
    _named("bookticker_stats", lambda s, d: bookticker.stats(_b(s, d))),
    _named("bookticker_decode", lambda s, d: bookticker.decode(_b(s, d))),
    _named("depth_exploded", lambda s, d: derive.explode_levels(derive.assemble(_l(s, d)))),
    _named("depth_scales", lambda s, d: depth.scales(_l(s, d))),
    _named("depth_best_before", lambda s, d: depth.best_before(_l(s, d))),
    _named("depth_offsets", lambda s, d: depth.offsets(_l(s, d)).select("session_id", "batch", "pos", "side", "price_tick", "best_tick", "offset")),
    _named("depth_run_mode", lambda s, d: depth.run_modes(_l(s, d))),
    _named("depth_offset_gaps", lambda s, d: depth.offset_gaps(_l(s, d))),
    _named("depth_hot_by_side", lambda s, d: depth.hot_by_side(_l(s, d))),
    _named("depth_stats", lambda s, d: depth.stats(_l(s, d))),
    _named("depth_book_final", lambda s, d: depth.final_book(_l(s, d))),
    *[(f.__name__, f) for f in (
        jsonl_strict_validation, trades_parse_roundtrip, depth_parse_levels, trades_monotonic_check, trades_qty_histogram, blocks_layout, replay_batches, replay_time_span,
        verify_records_exact, verify_records_mutated, verify_modes, verify_missing_extra, pipeline_catalog, pipeline_availability, status_strings, run_matrix_latest, prometheus_lines,
    )],
    *[(f"stream_hashes_{x}", _hashes(x)) for x in ("trades", "bookticker", "depth")], *[(f"verify_bytes_{x}", _verify_bytes(x)) for x in ("trades", "bookticker", "depth")],
    ("stream_book", stream_book), ("stream_delta", stream_delta),
    *[(f"container_roundtrip_{x}", _container(x, c)) for x, c in (("trades", "zstd"), ("bookticker", "xz"), ("depth", "raw"))],
    *[(f.__name__, f) for f in (container_files, container_block_index, container_replay, text_files, line_functions, last_run_lines)],
    *[(f"pipeline_run_{n}_{x}", _pipeline(x, p)) for n, x, p in PIPELINE_RUNS],
    *[(f"artifact_files_{x}", _artifact_files(x)) for x in ("trades", "bookticker", "depth")],
    *[(f"lab_roundtrip_{n}", _lab(f"py.{n}_v1")) for n in ("gzip", "bz2", "lzma", "zlib", "zstandard")],
    *[(f"inspect_stats_view_{x}", _stats_view(x)) for x in ("trades", "bookticker", "depth")],
    *[(f"artifact_roundtrip_{x}", _artifact(x)) for x in ("trades", "bookticker", "depth")],
    *[(f"inspect_{x}", _inspect(x)) for x in ("trades", "bookticker", "depth")],
    *[(f"entropy_roundtrip_{p}_{x}", _entropy(x, p)) for x in ("trades", "bookticker", "depth") for p in PROFILES],
    *[(f"codec_roundtrip_{n}", _codec(n)) for n in ("zstd", "gzip", "xz", "bz2", "zlib", "raw")],
])
