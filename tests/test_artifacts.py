"""Round trips, golden values and the corruption matrix of the binary formats."""

import json
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeworks.functions import kernels as K
from tapeworks.operators import artifacts as ops
from tapeworks.schema import TapeError
from tapeworks.sources import artifacts as A
from tapeworks.sources import views as V

V1 = b"[1,2,1,100]\n[2,3,0,200]\n"
V2 = b"[100,10,110,20,1000]\n[100,9,110,20,1001]\n[101,9,111,22,1001]\n"
V3 = b"[[100,10,0],[110,20,1],1000]\n[[100,9,0],[111,22,1],1001]\n[[100,0,0],[99,7,0],1002]\n"
TEXT = {"trades": V1, "bookticker": V2, "depth": V3}


def test_checksums():
    assert K.crc32c(b"123456789") == 0xE3069283
    assert K.fnv1a(b"") == K.FNV_START


@given(st.lists(st.integers(-(2**63) + 1, 2**63 - 1)))
def test_varints(values):
    v = K.Varints(K.put_varints(map(K.zigzag, values)))
    assert [K.unzigzag(v.next()) for _ in values] == values and v.done


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=200), st.sampled_from(sorted(K.PROFILES)))
def test_arithmetic(raw, profile):
    assert K.arithmetic_decode(K.arithmetic_encode(raw, profile), len(raw), profile) == raw


@pytest.mark.parametrize("stream", sorted(TEXT))
@pytest.mark.parametrize("profile", [None, *K.PROFILES])
def test_transform(stream, profile):
    data = A.compress(TEXT[stream], stream, profile)
    assert A.decompress(data) == TEXT[stream]
    assert A.inspect(data)
    with pytest.raises(TapeError):
        A.decompress(data[:-1])
    with pytest.raises(TapeError):
        A.decompress(data + b"\0")


def test_crlf_kept_for_trades_only():
    crlf = V1.replace(b"\n", b"\r\n")
    assert A.decompress(A.compress(crlf, "trades")) == crlf
    with pytest.raises(TapeError) as e:
        A.compress(V2.replace(b"\n", b"\r\n"), "bookticker")
    assert e.value.status == "decode_error"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 300), st.integers(0, 1), st.integers(0, 3)), min_size=1, max_size=400))
def test_trades_property(rows):
    t, out = 0, []
    for p, q, s, d in rows:
        t += d
        out.append((p * 5, q * 3, s, t * 7))
    assert A.read_trades(A.write_trades(out)) == out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 12), st.integers(0, 4), st.integers(0, 1)), min_size=1, max_size=5), min_size=1, max_size=60))
def test_depth_property(batches):
    rows = [([(p * 10, q * 2, s) for p, q, s in b], i // 2) for i, b in enumerate(batches)]
    assert A.read_depth(A.write_depth(rows)) == rows


@pytest.mark.parametrize("name", ["zstd", "gzip", "xz", "raw"])
def test_container(name):
    text = V1 * 600
    data = A.write_container(text, "trades", name, block_bytes=1)
    index = A.read_index(data)
    assert A.read_container(data) == text and len(index["blocks"]) == -(-len(text) // 4096)
    assert sum(b["line_count"] for b in index["blocks"]) == 1200
    for bad in (data[:8], data[:64] + bytes([data[64] ^ 1]) + data[65:], data[:-1], data[:-1] + bytes([data[-1] ^ 0x5A]), data + b"x"):
        with pytest.raises(TapeError):
            A.read_container(bad)
    assert A.read_container(A.write_container(b"", "trades", name)) == b""


def test_replay_stops():
    seen = []
    decoder = ops.ReplayDecoder(A.write_container(V1, "trades", "zstd"), "trades", 1)
    assert decoder.decode_all(lambda b: seen.append(b) or False) == "callback_stopped" and len(seen) == 1
    assert decoder.decode_all(lambda b: True) == "ok"


def test_rejects():
    for bad in (b"[0,2,1,100]\n", b"[1,2,1,200]\n[1,2,1,100]\n", b"[1,2.5,1,100]\n", b""):
        with pytest.raises(TapeError):
            A.compress(bad, "trades")
    with pytest.raises(TapeError):
        A.compress(b"[[[100,1,0,0]],[[101,2,1,0]],123]\n", "depth")


def _first_depth_format(rows):
    """Artifact of the first depth format, unit scales: offsets where the side has a best price."""
    book, best, known = [{}, {}], [0, 0], [False, False]
    heads, sides, modes, deletes, prices, codes, escapes, last = [], [], [], [], [], [], [], rows[0][1]
    hot = [7, 10]
    for levels, t in rows:
        heads += [t - last, len(levels)]
        last = t
        for p, q, s in levels:
            away = p - best[1] if s else best[0] - p
            relative = known[s] and away >= 0
            sides.append(s)
            modes.append(int(relative))
            deletes.append(int(q == 0))
            prices.append(away if relative else K.zigzag(p))
            if q:
                codes.append(hot.index(q) if q in hot else 2)
                escapes += [] if q in hot else [q]
        for p, q, s in levels:
            book[s].pop(p, None)
            if q:
                book[s][p] = q
        for s, pick in ((0, max), (1, min)):
            best[s], known[s] = (pick(book[s]), True) if book[s] else (best[s], False)
    parts = [K.put_varints(heads), K.put_bits(sides), K.put_bits(modes), K.put_bits(deletes), K.put_varints(prices), K.put_varints(codes), K.put_varints(escapes)]
    body = struct.pack("<2q", *hot) + b"".join(parts)
    n = len(sides)
    counts = (sum(deletes), len(escapes), sum(modes), n - sum(modes), n)
    return A._DEPTH_V1.pack(A.DEPTH_V1, 1, 0, 0, 160 + len(body), len(rows), n, 1, 1, 1, rows[0][1], 2, *map(len, parts), 16, *counts).ljust(160, b"\0") + body


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 12), st.sampled_from([0, 7, 10, 13]), st.integers(0, 1)), min_size=1, max_size=5), min_size=1, max_size=40))
def test_first_depth_format(batches):
    rows = [(b, i // 2) for i, b in enumerate(batches)]
    data = _first_depth_format(rows)
    assert A.read_depth_v1(data) == rows and A.decompress(data) == A.to_text(rows, "depth")
    assert [(b["dt"], b["level_count"]) for b in json.loads(V.view(data, "encoded-json"))["batches"]] == [(int(i % 2 == 0 and i > 0), len(b)) for i, b in enumerate(batches)]
    assert json.loads(V.view(data, "stats"))["total_level_count"] == sum(map(len, batches)) == A.inspect(data)["level_count"]
    assert V.view(data, "encoded-binary").startswith(f"depth_ladder_offset_v1 bytes={len(data)} header=160 hot_qty=16 batch=")
    for bad in (data[:-1], data + b"\0", data[:100]):
        with pytest.raises(TapeError):
            A.decompress(bad)


def test_views_of_trades():
    text = b"[10,6,1,100]\n[10,4,1,100]\n[20,2,0,100]\n[20,2,0,300]\n"
    data = A.compress(text, "trades")
    shown = json.loads(V.view(data, "encoded-json"))
    assert shown["chunks"] == [[0, 4, [[100, 10, [1, 2, 3]], [[0, [[0, 1, 2, [2, 1]], [1, 0, 1, [0]]]], [2, [[0, 0, 1, [0]]]]]]]]
    stats = json.loads(V.view(data, "stats"))
    assert (stats["record_count"], stats["timestamp_group_count"], stats["price_group_count"], stats["first_chunk_qty_scale"]) == (4, 2, 3, 2)
    assert len(stats) == 26
    assert json.loads(V.view(data, "encoded-binary"))["chunks"][0]["chunk_header_offset"] == 96


def test_views_of_bookticker_and_depth():
    shown = json.loads(V.view(A.compress(V2, "bookticker"), "encoded-json"))
    assert [u["mask"] for u in shown["updates"]] == [0, 4, 9]
    assert shown["updates"][2]["state"] == [101, 9, 111, 22, 1001] and shown["base_state"]["spread"] == 10
    shown = json.loads(V.view(A.compress(V3, "depth"), "encoded-json"))
    assert [b["mode"] for b in shown["batches"]] == ["explicit", "side_runs_offset_gaps", "side_runs_offset_gaps"]
    assert shown["batches"][1]["best_before"] == {"bid": 100, "ask": 110}
    assert [x["offset"] for x in shown["batches"][2]["levels"]] == [0, 1] and shown["truncated"] is False
    many = b"".join(b"[[%d,5,0],%d]\n" % (100 + i, i) for i in range(200))
    shown = json.loads(V.view(A.compress(many, "depth"), "encoded-json"))
    assert len(shown["batches"]) == shown["shown_batches"] == 128 and shown["truncated"]


@pytest.mark.parametrize("stream", sorted(TEXT))
def test_views_of_envelopes_and_containers(stream):
    data = A.compress(TEXT[stream], stream, "ac16_ctx0" if "ac16_ctx0" in K.PROFILES else next(iter(K.PROFILES)))
    for kind in ("canonical-json", "canonical-jsonl", "encoded-json"):
        assert V.view(data, kind).encode() == TEXT[stream]
    assert json.loads(V.view(data, "stats"))["stream"] == stream and V.view(data, "encoded-binary").endswith(f"stream={stream}\n")
    for bad, kind in ((data, "other"), (A.write_container(TEXT[stream], stream, "raw"), "stats")):
        with pytest.raises(TapeError) as e:
            V.view(bad, kind)
        assert e.value.status == "not_implemented"
