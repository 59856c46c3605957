"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts are lower-cased words of letters and digits, each hashed to 64 bits. A fixed mask selects some positions of a
short window and ignores the others; the selected word hashes make one seed. Seeds of every text position join the
seeds of the benchmark, and each hit is verified along its diagonal: among all windows of ``window`` words (the whole
item if shorter) the best must agree in at least ``share`` of its words, so substituted words are tolerated.

At the default share no overlap is lost: whichever words of a window of 20, or of an item of 9 to 19 words, are
substituted, one of the masks meets unchanged words only (tests/llm checks every pattern). Items under
``least_tolerant`` words match word by word, through a mask of their own length, and so does a one-word item.

Positions are exploded inside one code-generated stage: seeds are computed from the array of word hashes, probed, and
only hits leave the stage, so no text is shuffled. Items are cut into segments of at most ``segment`` words that overlap by
a window less one word; segments are broadcast in blocks of at most ``block_seeds`` seeds or one segment's, one pass over
the texts for each block. Their number is counted first.

Defined cases: null, empty and word-less texts or items match nothing; repeated rows are reported each; null ids stay
null; of an item of several segments the best one counts, and matched_words those inside it; an empty table or benchmark
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed masks: 1 selects a word, 0 ignores it.
MASKS = ("110111", "11010011", "11111")


def word_hashes(text):
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(hashes, at, masks=MASKS):
    """An array of (mask, seed) at position ``at``; seed is null where the window would pass the end."""
    each = []
    for i, mask in enumerate(masks):
        chosen = [F.get(hashes, at + o) for o, c in enumerate(mask) if c == "1"]
        fits = at + F.lit(len(mask)) <= F.size(hashes)
        each.append(F.struct(F.lit(i).alias("mask"), F.when(fits, F.xxhash64(F.lit(i), *chosen)).alias("seed")))
    return F.array(*each)


def positions(rows: DataFrame, masks=MASKS) -> DataFrame:
    """One row per position and mask of ``rows(.., h)``: adds at, mask, seed."""
    shortest = min(map(len, masks))
    at = rows.where(F.size("h") >= shortest).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("h") - shortest)))
    keyed = at.withColumn("key", F.explode(seeds(F.col("h"), F.col("at"), masks)))
    return keyed.select(*rows.columns, "at", F.col("key.mask").alias("mask"), F.col("key.seed").alias("seed")).where("seed is not null")


def segments(benchmark: DataFrame, window: int, segment: int) -> DataFrame:
    """(piece, item, item_id, n, base, b): pieces of each item; every window of the item lies in one of them whole."""
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("all")).where("size(all) > 0")
    items = items.withColumn("n", F.size("all")).withColumn("base", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)), F.lit(segment - window + 1))))
    cut = items.select("item", "item_id", "n", "base", F.slice("all", F.col("base") + 1, F.lit(segment)).alias("b"))
    return cut.withColumn("piece", F.monotonically_increasing_id())


def matches(docs: DataFrame, uid: str, benchmark: DataFrame, window: int = 20, share: float = 0.8, block_seeds: int = 2_000_000, least_tolerant: int = 9, segment: int = 20_000) -> DataFrame:
    """(uid, doc_id, item_id, item_words, matched_words, window_words, window_matched, doc_start) per row and item: its best diagonal."""
    pieces = common.cut(segments(benchmark, window, segment))
    # One bounded row: how many words there are, and which lengths are under least_tolerant.
    total, lengths = pieces.agg(F.sum(F.size("b")), F.collect_set(F.when(F.col("n") < least_tolerant, F.col("n")))).first()
    masks = (*MASKS, *("1" * n for n in sorted(lengths)))
    #: The one mask of an item under least_tolerant words is as long as the item.
    of_item = F.when(F.col("n") < least_tolerant, F.length(F.element_at(F.array(*map(F.lit, masks)), F.col("mask") + 1)) == F.col("n")).otherwise(F.col("mask") < len(MASKS))
    blocks = max(1, math.ceil((total or 0) * len(MASKS) / block_seeds))
    texts = docs.select(F.col(uid).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), word_hashes(F.col("text")).alias("h"))
    found = None
    for block in range(blocks):
        part = pieces.where(F.pmod(F.xxhash64("piece"), F.lit(blocks)) == block)
        # Every position of a seed that an item repeats: each is on a diagonal of its own.
        keys = positions(part.withColumnRenamed("b", "h"), masks).where(of_item).select("mask", "seed", "piece", F.col("at").alias("j"))
        #: Both sides hold about block_seeds seeds' worth of pieces, or one piece.
        probe = positions(texts, masks).join(F.broadcast(keys), ["mask", "seed"]).join(F.broadcast(part), "piece")
        hits = _verified(probe, window, share, masks)
        found = hits if found is None else found.union(hits)
    best = F.max(F.struct("window_matched", "matched_words", (-F.col("doc_start")).alias("back"), "window_words", "item_words")).alias("best")
    out = found.groupBy("uid", "doc_id", "item", "item_id").agg(best)
    return out.select("uid", "doc_id", "item_id", "best.item_words", "best.matched_words", "best.window_words", "best.window_matched", (-F.col("best.back")).alias("doc_start"))


def _verified(probe: DataFrame, window: int, share: float, masks) -> DataFrame:
    h, b, at, j = F.col("h"), F.col("b"), F.col("at"), F.col("j")
    # A run of hits on one diagonal is verified once: where the seed one word earlier agrees too, that hit stands for it.
    # It is in the probe, which has every position of the text and of the item.
    goes_on = F.lit(False)
    for i, mask in enumerate(masks):
        same = F.lit(True)
        for o, c in enumerate(mask):
            if c == "1":
                same = same & (F.get(h, at - 1 + F.lit(o)) == F.get(b, j - 1 + F.lit(o)))
        goes_on = goes_on | ((F.col("mask") == i) & (at > 0) & (j > 0) & F.coalesce(same, F.lit(False)))
    first = probe.where(~goes_on)
    words = F.size(b)
    agree = F.transform(F.sequence(F.lit(0), words - 1), lambda t: F.coalesce(F.get(h, F.col("start") + t) == F.get(b, t), F.lit(False)).cast("int"))
    rows = first.withColumn("start", at - j).withColumn("agree", agree).withColumn("w", F.least(words, F.lit(window)))
    sums = F.transform(
        F.sequence(F.lit(1), words - F.col("w") + 1),
        lambda s: F.aggregate(F.slice("agree", s, F.col("w")), F.lit(0), lambda a, x: a + x),
    )
    rows = rows.select(
        "uid", "doc_id", "item", "item_id",
        F.col("n").cast("long").alias("item_words"),
        F.aggregate("agree", F.lit(0), lambda a, x: a + x).cast("long").alias("matched_words"),
        F.col("w").cast("long").alias("window_words"),
        F.array_max(sums).cast("long").alias("window_matched"),
        (F.col("start") - F.col("base")).cast("long").alias("doc_start"),
    )
    return rows.where(F.col("window_matched") >= F.lit(share) * F.col("window_words"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row per document row and benchmark item it overlaps."""
    uid = common.free_name(docs, "uid")
    return matches(common.with_uid(docs, uid), uid, benchmark, **how).drop("uid")


def keep_unseen(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows that overlap no benchmark item, all columns unchanged."""
    uid = common.free_name(docs, "uid")
    own = common.with_uid(docs, uid)
    hit = matches(own, uid, benchmark, **how).select(F.col("uid").alias(uid)).distinct()
    return own.join(hit, uid, "left_anti").drop(uid)
