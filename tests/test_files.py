"""Files of artifacts, replay, discovery, the lab, metrics and timing on small inputs."""

import json
import urllib.error
import urllib.request

import pytest

from tapeworks.functions.timing import Clock, replay_multiplier
from tapeworks.operators import artifacts, lab, metrics, pipelines, verify
from tapeworks.schema import TapeError
from tapeworks.sources import artifacts as A
from tapeworks.sources import files, jsonl, views

# Small canonical inputs.
TRADES = b"[1,2,1,100]\n[2,3,0,200]\n"
QUOTES = b"[100,10,110,20,1000]\n[100,9,110,20,1001]\n[101,9,111,22,1001]\n"


def many(n):
    return b"".join(b"[%d,%d,%d,%d]\n" % (100 + i % 7, 1 + i % 13, i % 2, 1000 + i // 3) for i in range(n))


def at(tmp_path, data, name="trades.hfc", session="s1"):
    folder = tmp_path / session
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data)
    return str(folder / name)


@pytest.mark.parametrize("codec", ["zstd", "gzip", "xz", "raw"])
def test_blocks_stream_and_prune(spark, tmp_path, codec):
    text = many(3000)
    path = at(tmp_path, A.write_container(text, "trades", codec, 3, 4096), "trades.hfr" if codec == "raw" else "trades.hfc")
    blocks = list(files.stream_blocks(path))
    assert b"".join(blocks) == text and len(blocks) > 5 and max(map(len, blocks)) <= 4096
    rows = files.read_blocks(spark, str(tmp_path))
    assert b"".join(bytes(r.raw) for r in sorted(rows.collect(), key=lambda r: r.block)) == text
    some = rows.where("block >= 2 and block < 4")
    assert sorted(r.block for r in some.collect()) == [2, 3]
    reader = files._Reader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, StringContains

    assert list(reader.pushFilters([EqualTo(("block",), 3), StringContains(("path",), "x")])) == [StringContains(("path",), "x")]
    assert [r[4] for p in reader.partitions() for r in reader.read(p)] == [3]
    lines = files.lines_of_blocks(rows).orderBy("seq").collect()
    assert [r.line for r in lines] == text.decode().splitlines() and [r.seq for r in lines] == list(range(3000))


def test_corrupt_containers(spark, tmp_path):
    good = A.write_container(TRADES, "trades", "zstd")
    flip = lambda i, x: good[:i] + bytes([good[i] ^ x]) + good[i + 1 :]
    for bad in (good[:8], flip(64, 1), good[:-1], flip(len(good) - 1, 0x5A), good + b"x", flip(20, 1), b""):
        path = at(tmp_path, bad)
        with pytest.raises(TapeError) as e:
            list(files.stream_blocks(path))
        assert e.value.status in ("corrupt_data", "decode_error")
        with pytest.raises(TapeError):
            A.read_container(bad)
        with pytest.raises(Exception, match="corrupt_data|decode_error"):
            files.read_blocks(spark, str(tmp_path)).collect()
    first = bytearray(good)
    first[4:6] = (1).to_bytes(2, "little")  # version 1 has no checksums
    assert b"".join(files.stream_blocks(at(tmp_path, bytes(first)))) == TRADES
    with pytest.raises(TapeError, match="io_error"):
        files.listed(str(tmp_path / "nowhere"))


def test_replay_carries_lines(tmp_path):
    text = many(2000)
    path = at(tmp_path, A.write_container(text, "trades", "zstd", 3, 4096))
    whole = A.parse_text(text, "trades")
    for source in (path, A.write_container(text, "trades", "zstd", 3, 4096), A.compress(text, "trades")):
        got = list(artifacts.ReplayDecoder(source, "trades", 300).batches())
        assert [b["first_line_number"] for b in got] == [1, 301, 601, 901, 1201, 1501, 1801] and sum((b["records"] for b in got), []) == whole
    seen = []
    assert artifacts.ReplayDecoder(path, "trades", 300).decode_all(lambda b: seen.append(b) or len(seen) < 2) == "callback_stopped" and len(seen) == 2
    assert list(files.whole_lines(iter([b"a\r\nb", b"c\n", b"", b"d"]))) == [[b"a"], [b"bc"], [], [], [b"d"]]
    assert [b["records"] for b in files.record_batches(iter([b"\n[1,2,1,100]\n\n"]), "trades")] == [[(1, 2, 1, 100)]]
    with pytest.raises(TapeError, match="corrupt_data"):
        list(files.record_batches(iter([b"[1,2,1]\n"]), "trades"))
    with pytest.raises(TapeError, match="invalid_argument"):
        artifacts.ReplayDecoder(path, "unknown")


def test_discovery(spark, tmp_path):
    session = tmp_path / "data" / "s1"
    session.mkdir(parents=True)
    look = lambda stream="trades", **more: artifacts.discover(spark, str(session), stream, **more)
    assert look() == {"status": "ok", "found": False, "path": None}
    root = tmp_path / "out"
    wanted = files.target(str(root), "zstd", "s1", "trades", ".hfc")
    files.put(wanted, iter([A.write_container(TRADES, "trades", "zstd")]))
    (session / "trades.hfc").write_bytes(A.write_container(many(10), "trades", "zstd"))
    assert look(root=str(root))["path"] == wanted and look(root=str(root))["line_count"] == 2
    assert look()["line_count"] == 10 and look()["found"]
    (session / "bookticker.hfc").write_bytes(A.write_container(TRADES, "trades", "zstd"))
    assert look("bookticker")["status"] == "corrupt_data" and not look("bookticker")["found"]
    (session / "trades.hfc").write_bytes(b"short")
    assert look()["status"] == "corrupt_data"
    with pytest.raises(TapeError, match="unsupported_pipeline"):
        look(pipeline_id="no.such_v1")
    with pytest.raises(TapeError, match="not_implemented"):
        look(pipeline_id="trade.delta_varint_v1")


def test_views_by_pipeline_id():
    trades, coded = A.compress(TRADES, "trades"), A.compress(TRADES, "trades", "ac16_ctx8")
    assert views.view_of(trades, "tick.trades_grouped_delta_qtydict_math_v3", "canonical-jsonl") == TRADES.decode()
    assert json.loads(views.view_of(trades, "tick.trades_grouped_delta_qtydict_v1", "stats"))["record_count"] == 2
    assert views.view_of(coded, "tick.trades_grouped_delta_qtydict_ac16_ctx8_v1", "canonical-jsonl") == TRADES.decode()
    for data, name, kind, status in (
        (trades, "std.zstd_jsonl_blocks_v1", "stats", "not_implemented"), (trades, "tick.trades_grouped_delta_qtydict_math_v3", "other", "not_implemented"), (trades, "", "stats", "invalid_argument"),
        (trades, "tick.bookticker_delta_mask_v2", "stats", "corrupt_data"), (coded, "tick.trades_grouped_delta_qtydict_math_v3", "stats", "corrupt_data"), (b"", "tick.depth_ladder_offset_v3", "stats", "corrupt_data"),
    ):
        with pytest.raises(TapeError) as e:
            views.view_of(data, name, kind)
        assert e.value.status == status, (name, kind)


def test_lab_rules(spark, tmp_path):
    assert lab.records(b"\n[1,2,1,100]\n \n", "trades") == [[1, 2, 1, 100]] and lab.records(b'["a",2,1,0.5]', "trades")
    assert lab.records(b"[[1,2,0,9],5]", "depth") == [[[1, 2, 0, 9], 5]]
    for stream, bad in (("trades", b"[1,2,2,100]"), ("trades", b"{}"), ("bookticker", b"[1]"), ("depth", b"[[1,2],5]"), ("depth", b"[5]"), ("trades", b"x"), ("other", b"[1]")):
        with pytest.raises(TapeError):
            lab.records(bad, stream)
    spaced = TRADES.replace(b",", b", ")
    assert lab.verify(spaced, TRADES, "trades") | {"ok": 0} == {"ok": 0, "verified": True, "byte_exact": False, "record_exact": True, "decoded_record_count": 2, "canonical_record_count": 2, "mismatch_bytes": 6, "first_mismatch_field": "byte"}
    assert lab.verify(TRADES.replace(b"100", b"101"), TRADES, "trades")["mismatch_bytes"] == 1
    assert lab.verify(spaced, TRADES, "trades", "record_exact")["ok"] and not lab.verify(spaced, TRADES, "trades", "byte_exact")["ok"]
    with pytest.raises(TapeError, match="unsupported_pipeline"):
        lab.find("py.none_v1")
    with pytest.raises(TapeError, match="dependency_unavailable"):
        lab.find("py.brotli_v1")
    assert lab.find("py.brotli_v1", require_available=False).slug == "py-brotli"
    at(tmp_path, TRADES, "trades.jsonl", "s9")
    row = lab.compress_files(spark, str(tmp_path / "s9"), str(tmp_path / "out"), "py.gzip_v1", 99).collect()[0]
    assert row.status == "ok" and row.output_path == f"{tmp_path}/out/py-gzip/sessions/s9/trades.pylab.gz" and row.ratio == len(TRADES) / row.output_bytes
    report = json.loads(open(row.output_path + ".metrics.json").read())
    assert report["lab_only"] and not report["ranked"] and report["decoded_record_count"] == 2
    assert [bytes(r.text) for r in lab.decode_files(spark, str(tmp_path / "out"), "py.gzip_v1").collect()] == [TRADES]


def lines(spark, text, session="s"):
    return spark.createDataFrame([(session, i, x) for i, x in enumerate(text.decode().splitlines())], "session_id string, seq long, line string")


def test_verify_cases(spark, tmp_path):
    canonical = lines(spark, TRADES)
    check = lambda text, mode="both": verify.summary(canonical, lines(spark, text), "trades", mode, 4096).first()
    r = check(TRADES.replace(b"200", b"201"))
    assert (r.status, r.first_mismatch_line, r.first_mismatch_field, r.mismatch_bytes, r.first_mismatch_offset) == ("verification_failed", 2, "ts_ns", 1, 21)
    assert r.error == "decoded records differ from canonical jsonl" and r.preview_decoded == "1]." and r.preview_canonical == "0]."
    r = check(TRADES.replace(b",", b", "))
    assert (r.record_exact, r.byte_exact, r.first_mismatch_field, r.error) == (True, False, "byte", "decoded bytes differ from canonical jsonl")
    assert check(TRADES.replace(b",", b", "), "record").status == "ok" and check(TRADES).verified
    r = check(TRADES + b"[3,3,1,300]\n")
    assert (r.first_mismatch_line, r.first_mismatch_field, r.mismatch_bytes, r.first_mismatch_offset) == (3, "extra_decoded_record", 12, 24)
    assert check(TRADES + b"[3,3,1,300]\n", "byte").first_mismatch_field == "byte"
    r = check(TRADES[:12])
    assert (r.first_mismatch_line, r.first_mismatch_field, r.mismatch_percent) == (2, "missing_decoded_record", 50.0)
    assert check(TRADES[:12], "byte").first_mismatch_field == "length"
    with pytest.raises(TapeError, match="invalid_argument"):
        verify.summary(canonical, canonical, "trades", "other")
    rows = verify.summary(canonical, canonical, "trades").crossJoin(spark.createDataFrame([(str(tmp_path / "trades.hfc"),)], "path string"))
    written = files.write_json(rows, "path", ".verify.json").collect()
    assert json.loads(open(written[0].path).read())["status"] == "ok" and written[0].path.endswith("trades.verify.json")


def test_pipelines_by_id(spark, tmp_path):
    made = pipelines.compress(lines(spark, TRADES), "trades", "std.zstd_jsonl_blocks_v1", str(tmp_path)).first()
    assert made.path == f"{tmp_path}/zstd/sessions/s/trades.hfc" and (made.input_bytes, made.line_count, made.block_count) == (24, 2, 1)
    report = json.loads(open(str(tmp_path / "zstd/sessions/s/trades.metrics.json")).read())
    assert report["status"] == "ok" and report["ratio"] == 24 / made.output_bytes and report["encode_ns"] > 0
    changed = lines(spark, TRADES.replace(b"200", b"201"))
    assert pipelines.decode_and_verify(changed, "trades", "std.zstd_jsonl_blocks_v1", str(tmp_path)).first().first_mismatch_field == "ts_ns"
    report = json.loads(open(str(tmp_path / "zstd/sessions/s/trades.verify.json")).read())
    assert report["status"] == "verification_failed" and report["replay_multiplier"] > 0
    for stream, name, status in (
        ("trades", "std.brotli_jsonl_blocks_v1", "dependency_unavailable"), ("trades", "trade.delta_varint_v1", "not_implemented"), ("trades", "x", "unsupported_pipeline"),
        ("other", "std.zstd_jsonl_blocks_v1", "unsupported_stream"), ("depth", "tick.bookticker_delta_mask_v2", "unsupported_stream"),
    ):
        with pytest.raises(TapeError) as e:
            pipelines.compress(lines(spark, TRADES), stream, name, str(tmp_path))
        assert e.value.status == status


def test_replay_records(spark):
    rows = jsonl.replay_records(lines(spark, b"[1,2,1,100]\n\n \n[2,3,0,200]\n"), "trades").collect()
    assert [(r.price_e8, r.ts_ns) for r in rows] == [(1, 100), (2, 200)]
    with pytest.raises(Exception, match="corrupt_data"):
        jsonl.replay_records(lines(spark, b"[1,2,1]\n"), "trades").collect()


def test_late_rows_fail(spark):
    import pandas as pd

    from tapeworks.streaming import book

    class State:
        exists = False

        def update(self, value):
            self.value = value

    frame = lambda times: pd.DataFrame({"session_id": "s", "batch": range(len(times)), "pos": 0, "ts_ns": times, "side": 0, "price_e8": 5, "qty_e8": 1})
    assert len(next(book._book(("s",), [frame([1, 2, 2])], State()))) == 3
    with pytest.raises(TapeError, match="corrupt_data"):
        next(book._book(("s",), [frame([1, 3, 2])], State()))


def test_depth_slices(spark, sf):
    """Slices of any size give what one slice gives: the book and the time before each are right."""
    from tapeworks.operators import depth
    from tapeworks.sources import derive

    levels = derive.depth_levels(spark, sf)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(depth.best_before(levels, 7)) == rows(depth.best_before(levels, 1 << 20))
    assert rows(depth.stats(levels, 7)) == rows(depth.stats(levels, 1 << 20))


def test_names_from_paths(spark):
    from tapeworks.functions import scalar as S

    paths = ["/a/s1/trades.jsonl", "/a/s1/Trades.JSONL", "/a/s2/jsonl/depth.jsonl", "bookticker.jsonl", "/a/s1/trades.json"]
    F = S.F
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(S.stream_of_path(F.col("p")), S.stream_of_path(F.col("p"), any_case=False), S.session_of_path(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [("trades", "trades", "s1"), ("trades", "unknown", "s1"), ("depth", "depth", "s2"), ("bookticker", "bookticker", "manual_bookticker"), ("unknown", "unknown", "s1")]


def test_metrics_server():
    server = metrics.MetricsServer(lambda: "a 1\n", port=0)
    assert server.start()
    get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{server.port}{p}").read()
    assert get("/metrics") == b"a 1\n" and get("/-/ready") == b"ready\n"
    with pytest.raises(urllib.error.HTTPError, match="404"):
        get("/x")
    server.stop()


def test_metrics_server_off(monkeypatch):
    monkeypatch.setenv("TAPE_METRICS_MODE", "off")
    assert not metrics.MetricsServer(lambda: "").start()


def test_timing():
    clock = Clock()
    assert clock.lap() >= 0 and replay_multiplier(10, 4) == 2.5 and replay_multiplier(10, 0) == 0.0
