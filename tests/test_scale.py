"""What only shows at size, on small inputs: plans that adaptive execution changes, and sessions walked in parts."""

import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeworks.functions import coder
from tapeworks.functions import kernels as K
from tapeworks.functions.sequence import ranked
from tapeworks.operators import artifacts, blocks, depth
from tapeworks.sources import artifacts as A
from tapeworks.sources import derive, files, jsonl
from tapeworks.streaming import book as streamed
from tapeworks.streaming.run import replay


def _set(spark, **conf):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    return lambda: [spark.conf.unset(k) if v is None else spark.conf.set(k, v) for k, v in old.items()]


def test_containers_are_whole_when_a_join_is_read_in_pieces(spark, tmp_path):
    """Totals that turn out small make the join ahead of the writer a broadcast, whose other side is read by mapper: sessions
    are dealt out once more behind it."""
    line = F.format_string("[%d,2,1,%d]", "seq", "seq")
    lines = spark.range(6000, numPartitions=8).select(F.format_string("s%d", F.col("id") % 6).alias("session_id"), F.expr("id div 6").alias("seq")).withColumn("line", line)
    back = _set(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"})
    try:
        packed = blocks.compress_blocks(lines, "raw", 0, 4096).drop("roundtrip_ok")
        out = files.write_containers(packed, str(tmp_path), "raw", ".hfr", "trades", 0, 4096)
        steps = [x.strip(" +-:*") for x in out._jdf.queryExecution().executedPlan().toString().splitlines()]
        at = next(i for i, x in enumerate(steps) if x.startswith("SortMergeJoin"))
        assert any(x.startswith("Exchange") for x in steps[:at]), steps[:at]
        done = out.collect()
    finally:
        back()
    assert len(done) == 6
    for row in done:
        with open(row["path"], "rb") as f:
            text = A.read_container(f.read())
        assert text == b"".join(b"[%d,2,1,%d]\n" % (i, i) for i in range(1000)) and os.path.getsize(row["path"]) == row["output_bytes"]


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_depth_slices_make_the_artifact_of_a_whole_session(spark, size):
    rnd = random.Random(size)
    sides = lambda n: sorted(rnd.randrange(2) for _ in range(n)) if rnd.random() < 0.5 else [rnd.randrange(2) for _ in range(n)]
    level = lambda s: ((100 - rnd.randrange(9) if s == 0 else 99 + rnd.randrange(9)) * 50, rnd.choice([0, 0, *range(2, 200, 2)]), s)
    made = {x: [([level(s) for s in sides(rnd.randrange(1, 5))], 1000 + 10 * (i // 3)) for i in range(n)] for x, n in (("a", 120), ("b", 1), ("c", 7))}
    rows = [(x, i, j, t, s, p, q, 5) for x, batches in made.items() for i, (levels, t) in enumerate(batches) for j, (p, q, s) in enumerate(levels)]
    frame = spark.createDataFrame(rows, "session_id string, batch long, pos long, ts_ns long, side long, price_e8 long, qty_e8 long, bytes long")
    parts = [r.asDict() for r in depth.encoded_slices(frame, size).collect()]
    for x, batches in made.items():
        own = sorted((p for p in parts if p["session_id"] == x), key=lambda p: p["slice"])
        assert len(own) == -(-len(batches) // size)
        assert A.depth_artifact(own) == A.write_depth(batches, 5 * sum(len(b) for b, _ in batches))


def test_depth_out_of_order_and_odd_text_fail(spark):
    for lines, why in ((["[[1,1,0],5]", "[[1,1,0],4]"], "corrupt_data"), (["[[1,1,0], 5]"], "decode_error"), (["[5]"], "corrupt_data")):
        text = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "session_id string, seq long, line string")
        with pytest.raises(Exception, match=why):
            artifacts.encode(text, "depth").collect()


@pytest.mark.parametrize("stream", ["trades", "bookticker", "depth"])
def test_decoding_never_holds_a_session(stream):
    n = 40_000
    rows = {"trades": [(5 + i % 3, 1 + i % 9, i % 2, i) for i in range(n)], "bookticker": [(5 + i % 3, 1, 9, 1 + i % 9, i) for i in range(n)], "depth": [([(5 + i % 3, i % 4, i % 2)], i) for i in range(n)]}[stream]
    text, data = A.to_text(rows, stream), A.WRITERS[stream](rows)
    parts = list(A.text_flow(data))
    assert "".join(x + "\n" for p in parts for x in p).encode() == text and max(map(len, parts)) <= 16_384 < n


@pytest.mark.parametrize("number", range(len(K.PROFILES)))
def test_coder_of_the_jvm(spark, number):
    profile, rnd = list(K.PROFILES)[number], random.Random(number)
    assert coder.register(spark, A.ENVELOPE)
    texts = [b"", b"\0", b"\xff" * 20_000, bytes(int(rnd.gauss(128, 20)) & 255 for _ in range(20_000))]
    rows = spark.createDataFrame([(x, A.envelope(x, "depth", profile, 1, 1)) for x in texts], "base binary, data binary").selectExpr("base", "data", f"tape_code(base, {number}) AS packed", "tape_open(data) AS back").collect()
    for r in rows:
        assert bytes(r.back) == bytes(r.base) and bytes(r.packed) == bytes(r.data)[128:] == K.arithmetic_encode(bytes(r.base), profile)
    assert [r[0] for r in spark.createDataFrame([(texts[3],), (A.envelope(b"abc", "depth", profile, 1, 1)[:-1],)], "x binary").selectExpr("tape_open(x)").collect()] == [None, None]


@pytest.mark.parametrize("dense", [False, True])
def test_ranks_without_a_window_over_a_session(spark, dense):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(-50, 900)]), rnd.randrange(3)) for _ in range(2000)]
    frame = spark.createDataFrame(rows, "session_id string, k long, x long").withColumn("id", F.monotonically_increasing_id())
    order = ["k", "x"] if dense else ["k", "x", "id"]
    wanted = (F.dense_rank() if dense else F.row_number()).over(Window.partitionBy("session_id").orderBy(*order)) - 1
    out = ranked(frame, "k", order, "seq", dense, records=50)
    assert sorted(out.select("id", "seq").collect()) == sorted(frame.select("id", wanted.cast("long")).collect())
    keys = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Window" in x and "rank" in x.lower()]
    assert all("_part" in x for x in keys)


def test_lines_are_parsed_once(spark):
    lines = ["[[1,2,0],[3,4,1],5]", "[[1,2,0], [3,4,1],6]", "[7]", "x", None]
    text = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "session_id string, seq long, line string")
    out = derive.explode_levels(jsonl.parse(text, "depth"))
    assert sorted((r.batch, r.pos, r.ts_ns, r.price_e8, r.qty_e8, r.side) for r in out.collect()) == [(0, 0, 5, 1, 2, 0), (0, 1, 5, 3, 4, 1), (1, 0, 6, 1, 2, 0), (1, 1, 6, 3, 4, 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_replay_bounds_a_micro_batch(spark):
    """Steps follow from the rows, and give what one step gives."""
    rows = [(s, i, j, i, (5 + (i * 7 + j) % 4) * 10, (i + j) % 3, j % 2) for s in ("a", "b") for i in range(60) for j in range(3)]
    table = spark.createDataFrame(rows, "session_id string, batch long, pos long, ts_ns long, price_e8 long, qty_e8 long, side long")
    some, one = (sorted(map(tuple, replay(table, "batch", streamed.best_before, 1, n).collect()), key=str) for n in (90, 1000))
    assert some == one and len(one) == 120
    folder = spark.conf.get("spark.checkpoint.dir")
    steps = sorted(len([f for f in os.listdir(f"{folder}/{x}/in") if f.endswith(".parquet")]) for x in os.listdir(folder) if os.path.isdir(f"{folder}/{x}/in") and table.columns == spark.read.parquet(f"{folder}/{x}/in").columns)
    assert steps[0] == 1 and steps[-1] == 4
