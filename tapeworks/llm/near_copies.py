"""SimHash near-dedup at a given Jaccard similarity: wide fingerprints, compared bit-sliced, and an exact check.

A document is the set of XXH64 hashes of its word shingles; equal sets collapse first, to one node each. A pair of
similarity 0.8 differs in about 10 of 64 fingerprint bits and often in more, so a node has 128 bits and the radius is 44:
a pair of similarity 0.8 is beyond it with probability below 0.0001, two unrelated ones are within it about as often.
No bands of bits are lossless at such a radius. Nodes meet in buckets of min-hash bands instead: with 16 bands of 4 minima
a pair of similarity 0.8 shares a bucket with probability 0.9998. Inside a bucket bit planes and carry-save counters
find the pairs within the radius. Their components are then checked: the similarity is computed from the whole
sets, sent once for each node, so every link of the result is exact.

No group meets in one task. A large one is split into blocks; each block is compared within itself and with a pivot
block. Only nodes that are still apart from their group's largest component meet the other blocks after that, so a
huge group of copies costs a few passes over its members instead of all pairs of blocks, and no link is lost.

Defined cases: null and word-less texts have the empty set and are one class; a text of fewer words than a shingle is
one shingle; a null doc_id stands for its class only if all members are null; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

BANDS, ROWS = 16, 4
_RNG = np.random.default_rng(42)
_MIX = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_ODD = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
#: The second half of a fingerprint is that of the hashes mixed once more.
_AGAIN = np.uint64(0xD6E8FEB86659FD93)
RADIUS = 44


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(simhash.shingle_hashes(text, width))


def wide(members: np.ndarray) -> bytes:
    """The 128-bit fingerprint of a set of hashes."""
    again = (members ^ (members >> np.uint64(32))) * _AGAIN
    return np.array([simhash.majority(members), simhash.majority(again ^ (again >> np.uint64(29)))], "<u8").tobytes()


def band_keys(members: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band; none for the empty set."""
    if not len(members):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(members), 512):
        mixed = (members[start : start + 512, None] ^ _MIX) * _ODD
        low = np.minimum(low, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    keys = [xxhash.xxh64_intdigest(low[i * ROWS : (i + 1) * ROWS].tobytes()) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketches(docs: DataFrame, uid: str, width: int) -> DataFrame:
    """(uid, doc_id, high, low, size, print, bands) of every row; high and low are the hash of the set."""

    def run(batches):
        for b in batches:
            for start, rows in common.slices(b.column(2), 1000):
                part = b.slice(start, rows)
                high, low, size, prints, bands = [], [], [], [], []
                for t in common.utf8(part.column(2)):
                    s = shingles(t, width)
                    h = xxhash.xxh3_128_intdigest(s.tobytes())
                    high.append(h >> 64)
                    low.append(h & (1 << 64) - 1)
                    size.append(len(s))
                    prints.append(wide(s))
                    bands.append(band_keys(s))
                long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), long(high), long(low), pa.array(size, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["uid", "doc_id", "high", "low", "size", "print", "bands"],
                )

    rows = docs.select(F.col(uid).alias("uid"), F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(common.tidy(run), "uid long, doc_id long, high long, low long, size long, print binary, bands array<long>")


def sets(rows: DataFrame, width: int) -> DataFrame:
    """(node, members) of ``rows(node, text)``; members are the bytes of the sorted hashes."""

    def run(batches):
        for b in batches:
            for start, n in common.slices(b.column(1), 1000):
                part = b.slice(start, n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t, width).tobytes() for t in common.utf8(part.column(1))], pa.binary())], ["node", "members"])

    return rows.mapInArrow(common.tidy(run), "node long, members binary")


def _planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints of several words."""
    return np.concatenate([simhash.planes(np.ascontiguousarray(values[:, i])) for i in range(values.shape[1])])


def _large(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links (places) of one cell: blocks of queries against the vertical bit planes of the cell."""
    n, bits, side = len(values), 64 * values.shape[1], _planes(values)
    lanes = simhash.lane_mask(np.ones(n, bool))
    label, out = np.arange(n), []
    for start in range(0, n, 64):
        q = values[start : start + 64]
        bit = [np.where(q[:, k // 64] >> np.uint64(k % 64) & np.uint64(1), ~np.uint64(0), np.uint64(0))[:, None] for k in range(bits)]
        valid = np.broadcast_to(lanes, (len(q), side.shape[1]))
        near = simhash.lane_flags(simhash.within(lambda k: side[k][None, :] ^ bit[k], valid.shape, radius, valid, bits), n)
        for row in range(len(q)):
            found = np.unique(label[near[row]])
            if len(found) > 1:
                out += [(int(found[0]), int(x)) for x in found[1:]]
                label[np.isin(label, found)] = found[0]
    return out


def near_prints(held: list[bytes], edges: list[int], radius: int, large: int = 64) -> list[tuple[int, int]]:
    """Links (places) inside cells that start at ``edges``: small cells together, lane i of round d comparing i and i + d."""
    values = np.frombuffer(b"".join(held), "<u8").reshape(len(held), -1)
    sizes = np.diff([*edges, len(held)])
    group, out, d = np.repeat(np.arange(len(sizes)), sizes), [], 1
    for g in np.flatnonzero(sizes >= large):
        out += [(edges[g] + i, edges[g] + j) for i, j in _large(values[edges[g] : edges[g] + sizes[g]], radius)]
    here = np.flatnonzero(sizes[group] < large)
    while True:
        here = here[here + d < len(values)]
        here = here[group[here] == group[here + d]]
        if not len(here):
            return out
        left, right = _planes(values[here]), _planes(values[here + d])
        valid = simhash.lane_mask(np.ones(len(here), bool))
        near = simhash.lane_flags(simhash.within(lambda k: left[k] ^ right[k], valid.shape, radius, valid, len(left)), len(here))
        out += [(int(i), int(i) + d) for i in here[near]]
        d += 1


def near_sets(held: list[bytes], edges: list[int], similarity: float) -> list[tuple[int, int]]:
    """Spanning links (places) of each cell."""
    return [(a + i, a + j) for a, b in zip(edges, [*edges[1:], len(held)]) if b - a > 1 for i, j in _linked_sets(held[a:b], similarity)]


def _linked_sets(held: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """A set is compared with all that are not yet linked, until none is left."""
    members = [np.frombuffer(m, np.uint64) for m in held]
    sizes = np.array([len(m) for m in members])
    _, code = np.unique(np.concatenate(members), return_inverse=True)
    part = np.split(code, np.cumsum(sizes)[:-1])
    seen = np.zeros(int(code.max()) + 1, bool)
    rest, flat, out = np.arange(1, len(held)), code[sizes[0] :], []
    queue = [0]
    while len(rest):
        if not queue:
            queue.append(int(rest[0]))
            rest, flat = rest[1:], flat[sizes[rest[0]] :]
            continue
        i = queue.pop()
        seen[part[i]] = True
        starts = np.cumsum(sizes[rest]) - sizes[rest]
        shared = np.add.reduceat(seen[flat].astype(np.int64), starts)
        seen[part[i]] = False
        near = shared >= similarity * (sizes[rest] + sizes[i] - shared) - 1e-9
        if near.any():
            out += [(i, int(j)) for j in rest[near]]
            queue += rest[near].tolist()
            flat = flat[np.repeat(~near, sizes[rest])]
            rest = rest[~near]
    return out


def _compared(cells: DataFrame, compare) -> DataFrame:
    """(a, b) links, a > b, of ``cells(g, i, j, node, payload)``; one large cell, or a few thousand nodes in small ones, are held at a time."""

    def links(nodes, held, edges):
        found = compare(held, edges) if len(held) > 1 else []
        if found:
            pairs = np.array(nodes, np.int64)[np.array(found)]
            yield pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], ["a", "b"])

    def run(batches):
        cell, nodes, held, edges, size = None, [], [], [], 0
        for b in batches:
            for *key, node, payload in zip(*(b.column(i).to_pylist() for i in range(5))):
                if key != cell:
                    if len(held) >= 4096 or size >= 1 << 23:
                        yield from links(nodes, held, edges)
                        nodes, held, edges, size = [], [], [], 0
                    cell = key
                    edges.append(len(held))
                elif nodes[-1] == node:
                    continue
                nodes.append(node)
                held.append(payload)
                size += len(payload)
        yield from links(nodes, held, edges)

    ready = cells.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "node")
    return ready.mapInArrow(common.tidy(run), "a long, b long").distinct()


def linked(groups: DataFrame, compare) -> DataFrame:
    """(node, root) of the nodes that have a link; ``groups(g, blocks, node, payload)`` says which nodes meet.

    Groups of more than one block take two rounds, as the module describes.
    """
    placed = groups.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    pivot = F.when((F.col("own") == 0) & (F.col("blocks") > 1), F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.col("own")))
    first = common.cut(_compared(placed.select("g", F.lit(0).alias("i"), F.explode(pivot).alias("j"), "node", "payload"), compare))
    split = groups.where("blocks > 1")
    if split.isEmpty():
        return _named(first)
    roots = _named(first)
    marked = placed.where("blocks > 1").select("g", "blocks", "own", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    marked = common.save(marked, "marked")
    parts = marked.groupBy("g", "root").agg(F.count("*").alias("n"))
    largest = parts.groupBy("g").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"), F.max("n").alias("n"))
    # Written first, so that the joins below deal out the rows of a large group themselves.
    largest = common.save(largest.where(F.col("all") > F.col("n")).select("g", F.col("top.root").alias("top")), "largest")
    if largest.isEmpty():
        return roots
    apart = common.cut(marked.join(largest, "g").where("root <> top").select("g", "own", "node"))
    #: Blocks of a group that have nodes apart: at most the group's number of blocks.
    with_some = apart.select("g", F.col("own").alias("i")).distinct()
    load = marked.join(with_some, "g").select("g", "i", F.col("own").alias("j"), "node")
    load = load.unionByName(apart.join(marked.select("g", F.col("own").alias("j")).distinct(), "g").select("g", F.col("own").alias("i"), "j", "node"))
    more = load.join(groups.select("g", "node", "payload"), ["g", "node"]).select("g", "i", "j", "node", "payload")
    return _named(common.cut(first.union(_compared(more, compare)).distinct()))


def _named(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links, roots included."""
    found = common.cut(simhash.components(links))
    return found.union(found.select(F.col("root").alias("fp"), "root").distinct()).withColumnRenamed("fp", "node")


def classes(docs: DataFrame, uid: str, nodes: DataFrame, width: int, similarity: float, radius: int = RADIUS, cell: int = 512, cell_shingles: int = 500_000) -> DataFrame:
    """(node, root) of the nodes of ``nodes(node, size, print, bands)`` in a class of two or more; a node is the uid of its first row."""
    keyed = nodes.select("node", "print", F.posexplode("bands").alias("k", "m"))
    buckets = keyed.groupBy("k", "m").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    # Copies share most of their bands: of the buckets with the same members one is enough.
    chosen = buckets.where("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct("k", "m")).alias("key")).select("n", "key.k", "key.m")
    chosen = common.save(chosen.select("k", "m", F.xxhash64("k", "m").alias("g"), F.ceil(F.col("n") / F.lit(cell)).cast("long").alias("blocks")), "buckets")
    met = common.save(keyed.join(chosen, ["k", "m"]).select("g", "blocks", "node", F.col("print").alias("payload")), "met")
    close = common.save(linked(met, lambda held, edges: near_prints(held, edges, radius)).join(nodes.select("node", "size"), "node"), "close")

    wanted = close.select(F.col("node").alias(uid))
    members = common.save(sets(docs.join(wanted, uid, "left_semi").select(F.col(uid).alias("node"), F.col("text").cast("string").alias("text")), width), "shingles")
    loads = close.groupBy(F.col("root").alias("g")).agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(cell)), F.ceil(F.col("total") / F.lit(cell_shingles))).cast("long")
    loads = common.save(loads.select("g", blocks.alias("blocks")), "loads")
    groups = close.select("node", F.col("root").alias("g")).join(loads, "g").join(members.withColumnRenamed("members", "payload"), "node")
    return linked(common.save(groups.select("g", "blocks", "node", "payload"), "groups"), lambda held, edges: near_sets(held, edges, similarity))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, **how) -> DataFrame:
    """The rows of ``docs`` that stand for their class, all columns unchanged."""
    uid = common.free_name(docs, "uid")
    own = common.with_uid(docs, uid)
    marked = sketches(own, uid, width)
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "uid")
    # The first row of equal sets is the node; other rows of the set go whatever its class.
    nodes = marked.groupBy("high", "low").agg(F.min(place).alias("first"), *[F.min(c).alias(c) for c in ("size", "print", "bands")])
    nodes = common.save(nodes.select(F.col("first.uid").alias("node"), "first", "size", "print", "bands"), "nodes")
    with common.scope(docs.sparkSession):
        roots = common.save(classes(own, uid, nodes, width, similarity, **how), "roots", outlive=True)
    joined = nodes.select("node", "first").join(roots, "node", "left")
    alone = joined.where("root is null").select("first")
    top = joined.where("root is not null").groupBy("root").agg(F.min("first").alias("first")).select("first")
    return own.join(alone.union(top).select(F.col("first.uid").alias(uid)), uid, "left_semi").drop(uid)
