"""SimHash near-duplicate classes by bit-sliced comparison.

A document's fingerprint takes, for each of 64 bits, the majority over XXH64 hashes of its word shingles.
Equal fingerprints collapse first. Distinct ones meet in buckets: the 64 bits form ``radius + 2`` bands and two
fingerprints within the radius agree on at least two of them, so each pair of bands is one bucket key and no link
is missed. Inside a bucket fingerprints lie vertically (one machine word holds one bit of 64 fingerprints);
carry-save counters add up 64 distances at a time and a block is abandoned once every lane is over the radius.
Large buckets are split into cells of block pairs, so no bucket meets in one task. Each cell emits a spanning forest
of its links, and alternating large-star / small-star rounds join the forests to components.

Defined cases: null or word-less text has fingerprint zero, which links like any other; a text of fewer words than
a shingle is one shingle; repeated rows keep their own output row; a null doc_id never names a component unless all
members are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
_ONES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the 64-bit hashes.

    Bit t of each byte is masked into eight byte-wide counters held in one word; up to 255 words are added before
    the counters are widened.
    """
    n = len(hashes)
    if n == 0:
        return 0
    out = 0
    starts = np.arange(0, n, 255)
    for t in range(8):
        lanes = (hashes >> np.uint64(t)) & _ONES
        counts = np.add.reduceat(lanes, starts).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > n):
            out |= 1 << (8 * int(byte) + t)
    return out


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    last = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(words[i : i + width]), SEED) for i in range(last)), np.uint64, last)


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """Unsigned fingerprint of UTF-8 text; lower-cases A-Z only and splits at ASCII white space."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, uid: str, width: int = 4) -> DataFrame:
    """(uid, doc_id, fp) of every row; fp is the bit pattern as a signed long."""

    def run(batches):
        for b in common.parts(batches, 2):
            fps = np.fromiter((fingerprint(t, width) for t in common.utf8(b.column(2))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["uid", "doc_id", "fp"])

    rows = docs.select(F.col(uid).alias("uid"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(common.tidy(run), "uid long, doc_id long, fp long")


def bands(radius: int) -> list[int]:
    """Bit masks of the pairs of bands; two values within the radius agree on at least one of them."""
    n = radius + 2
    edges = [round(i * 64 / n) for i in range(n + 1)]
    one = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(n)]
    return [a | b for a, b in combinations(one, 2)]


def planes(values: np.ndarray) -> np.ndarray:
    """Transpose n fingerprints to 64 rows of ceil(n / 64) words: lane i of plane k is bit k of value i."""
    n = len(values)
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    rows = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    padded = np.zeros((64, -(-n // 64) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.view(np.uint64)


def within(difference, shape: tuple, radius: int, valid: np.ndarray, bits: int = 64) -> np.ndarray:
    """Lanes whose distance is at most radius. ``difference(k)`` gives plane k of the xor of two sides.

    Carry-save counters: bit j of all distances lives in ``count[j]``; a carry out of the top bit marks a lane as over.
    ``valid`` has the lanes that stand for a pair; the block is abandoned once none of them can still be within.
    """
    width = max(1, (radius + 1).bit_length())
    count = [np.zeros(shape, np.uint64) for _ in range(width)]
    over = np.zeros(shape, np.uint64)
    for k in range(bits):
        carry = difference(k)
        for j in range(width):
            count[j], carry = count[j] ^ carry, count[j] & carry
        over |= carry
        if k % 8 == 7 and k >= radius:
            above = over | _exceeds(count, radius)
            if not np.any(valid & ~above):
                return np.zeros(shape, np.uint64)
    return valid & ~(over | _exceeds(count, radius))


def _exceeds(count: list, radius: int):
    """Lanes whose counter is over radius: the comparison runs from the top bit down."""
    greater = np.zeros_like(count[0])
    equal = ~np.zeros_like(count[0])
    for j in range(len(count) - 1, -1, -1):
        if radius >> j & 1:
            equal = equal & count[j]
        else:
            greater = greater | (equal & count[j])
            equal = equal & ~count[j]
    return greater


def lane_flags(mask: np.ndarray, n: int) -> np.ndarray:
    """One flag for each of the first n lanes."""
    return np.unpackbits(mask.view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def lane_mask(flags: np.ndarray) -> np.ndarray:
    """Words with one lane for each flag."""
    n = len(flags)
    out = np.zeros(-(-n // 64) * 8, np.uint8)
    packed = np.packbits(flags, bitorder="little")
    out[: len(packed)] = packed
    return out.view(np.uint64)


def forest_of_small(values: np.ndarray, group: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links in many small groups at once: lane i of round d compares rows i and i + d where both are in one group."""
    links, d = [], 1
    here = np.arange(len(values))
    while True:
        here = here[here + d < len(values)]
        here = here[group[here] == group[here + d]]
        if not len(here):
            return links
        left, right = planes(values[here]), planes(values[here + d])
        valid = lane_mask(np.ones(len(here), bool))
        near = lane_flags(within(lambda k: left[k] ^ right[k], valid.shape, radius, valid), len(here))
        links += [(int(values[i]), int(values[i + d])) for i in here[near]]
        d += 1


def forest_of_large(values: np.ndarray, radius: int, block: int = 64) -> list[tuple[int, int]]:
    """Spanning forest of one large group: blocks of queries against the vertical planes of the group."""
    n = len(values)
    side = planes(values)
    valid = np.broadcast_to(lane_mask(np.ones(n, bool)), (block, side.shape[1]))
    label = np.arange(n)
    links = []
    for start in range(0, n, block):
        q = values[start : start + block]
        bit = [np.where(q >> np.uint64(k) & np.uint64(1), ~np.uint64(0), np.uint64(0))[:, None] for k in range(64)]
        near = lane_flags(within(lambda k: side[k][None, :] ^ bit[k], (len(q), side.shape[1]), radius, valid[: len(q)]), n)
        for row in range(len(q)):
            i = start + row
            found = np.unique(label[near[row]])
            if len(found) > 1:
                low = found[0]
                for other in found[1:]:
                    links.append((int(values[low]), int(values[other])))
                label[np.isin(label, found)] = low
            assert label[i] <= i
    return links


def _compare(radius: int, large: int = 64):
    """Reads rows sorted by cell; a cell is compared as a whole, many small cells together."""

    def flush(cells: np.ndarray, values: np.ndarray):
        change = np.flatnonzero(np.any(cells[1:] != cells[:-1], axis=1)) + 1
        edges = np.concatenate([[0], change, [len(values)]])
        group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        sizes = np.diff(edges)
        small = sizes[group] < large
        links = forest_of_small(values[small], group[small], radius)
        for g in np.flatnonzero(sizes >= large):
            links += forest_of_large(np.unique(values[edges[g] : edges[g + 1]]), radius)
        if links:
            pairs = np.array(links, np.uint64).view(np.int64).reshape(-1, 2)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], ["a", "b"])

    def run(batches):
        held_cells, held_values = np.empty((0, 4), np.int64), np.empty(0, np.uint64)
        for b in batches:
            cells = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
            values = b.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
            cells, values = np.concatenate([held_cells, cells]), np.concatenate([held_values, values])
            if not len(values):
                continue
            last = np.flatnonzero(np.any(cells != cells[-1], axis=1))
            done = int(last[-1]) + 1 if len(last) else 0
            held_cells, held_values = cells[done:], values[done:]
            if done:
                yield from flush(cells[:done], values[:done])
        if len(held_values):
            yield from flush(held_cells, held_values)

    return run


def links(nodes: DataFrame, radius: int = 4, cell: int = 2048) -> DataFrame:
    """(a, b) spanning links, a > b, among distinct fingerprints ``nodes(fp)``: every two within the radius end up connected."""
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("m")) for i, m in enumerate(bands(radius))])
    keyed = nodes.select("fp", F.explode(keys).alias("key")).select("fp", F.col("key.k").cast("long").alias("k"), F.col("key.m").alias("m"))
    sizes = keyed.groupBy("k", "m").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(sizes, ["k", "m"])
    blocks = F.ceil(F.col("n") / F.lit(cell)).cast("long")
    own = F.pmod(F.xxhash64(F.col("fp")), blocks)
    cells = (
        met.withColumn("blocks", blocks)
        .withColumn("own", own)
        .select("fp", "k", "m", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        .select("k", "m", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    ready = cells.repartition("k", "m", "i", "j").sortWithinPartitions("k", "m", "i", "j", "fp")
    return ready.mapInArrow(common.tidy(_compare(radius)), "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(fp, root) for every node of ``edges(a, b)`` but the roots; root is the smallest node reachable. Alternating stars."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        linked = both.join(low, "a")
        if large:
            return linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        moved = linked.where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        return moved.union(low.select("a", F.col("low").alias("b"))).distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = common.cut(edges)
    before = mark(edges)
    for _ in range(most_rounds if before[0] else 0):
        edges = common.cut(star(star(edges, True), False))
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))


def classes(docs: DataFrame, uid: str, width: int = 4, radius: int = 4, cell: int = 2048) -> DataFrame:
    """(uid, doc_id, fp, component_id, keeper) of every row; keeper is the uid of the row that stands for its class."""
    marked = common.save(fingerprints(docs, uid, width), "simhash")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "uid")).alias("first"))
    nodes = common.cut(nodes)
    roots = components(links(nodes.select("fp"), radius, cell))
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = common.save(placed, "placed")
    # Written first, so that the join deals out both sides itself and can split the rows of a giant component.
    tops = common.save(placed.groupBy("root").agg(F.min("low").alias("component_id"), F.min("first").alias("first")), "tops")
    named = placed.select("fp", "root").join(tops, "root").select("fp", "component_id", F.col("first.uid").alias("keeper"))
    return marked.join(named, "fp").select("uid", "doc_id", "fp", "component_id", "keeper")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    uid = common.free_name(docs, "uid")
    found = classes(common.with_uid(docs, uid), uid, width, radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
