"""Substring deduplication by sliding sentence spans.

Every run of ``run`` consecutive sentences is hashed, whatever its words; a longer run that repeats is covered by the
runs inside it. Hashes join globally, and a sentence goes if any run that covers it is not the first occurrence of its
hash. First is the smallest (doc_id, row, position). Sentences end at a line feed or at ``.``, ``!`` or ``?`` before
white space; they are compared lower-cased with white space folded. Hashes are 128 bits wide.

The default is three sentences: two short ones in a row repeat by chance (at sf0.1 runs of two touch 2661 of 8457
documents that share no 51 words with another, runs of three 708, most for lines of their own). Passages that hold fewer
whole sentences, or none, have no run. With ``words`` spans of words slide too, over the same folded words and across
sentence ends: of the WINDOW stretches inside any ``words`` consecutive words the one of least hash is taken (winnowing).
So a passage of ``words`` words that repeats always has a stretch in common with its first occurrence, and what goes
repeats in at least ``words - WINDOW + 1`` words. Stretches join by their hashes with the runs and cut sentences where the
passage ends; up to WINDOW - 1 words at either end of a passage stay if no run covers them.

Counts aggregate before the shuffle and the join back to the runs has one row per repeated hash, so a passage shared
by a third of all texts is split by adaptive execution, never collected.

Defined cases: null text stays null and has no sentences; an empty text stays empty; a repeated row is a later copy
and loses its runs; texts with fewer sentences than a run keep all but passages of ``words`` words; null doc_ids come last; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_SAID = re.compile(r"\S+")
_END = re.compile(r"(?<=[.!?])\s+|\n\s*")
#: So many stretches in a row have one that is hashed.
WINDOW = 21
#: What the place of a stretch is lowered by, so that it is no sentence's.
_WORD = 1 << 31
#: Stretches are hashed in blocks of about so many words.
_BLOCK = 1 << 17
#: An odd multiplier, and codes of the bytes for the two halves of a hash.
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.array([[xxhash.xxh3_64_intdigest(bytes([b]), half) for b in range(256)] for half in (1, 2)], np.uint64)


def pieces(text: str) -> list[str]:
    """Sentences with the white space that follows each; joined they are the text."""
    out, at = [], 0
    for m in _END.finditer(text):
        if text[at : m.start()].strip():
            out.append(text[at : m.end()])
            at = m.end()
    if at < len(text):
        out.append(text[at:])
    return out


def run_hashes(text: str, run: int) -> list[tuple[int, int, int]]:
    """(first sentence, high hash, low hash) of every run of ``run`` consecutive sentences."""
    flat = [" ".join(p.lower().split()).encode("utf-8", "surrogatepass") for p in pieces(text)]
    out = []
    for i in range(len(flat) - run + 1):
        h = xxhash.xxh3_128_intdigest(b"\n".join(flat[i : i + run]))
        out.append((i, h >> 64, h & (1 << 64) - 1))
    return out


def _hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Hash of the codes from each start to its end: differences of prefix sums of code * base ** i, divided by the power they start with."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def stretch_hashes(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, high hash, low hash) of the stretches that stand for every ``words`` consecutive words.

    A stretch has ``words - WINDOW + 1`` words. Of the WINDOW stretches inside ``words`` consecutive words the first of least
    hash is taken, so equal words have a stretch in common wherever they stand.
    """
    out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2]
    said: list[list[str]] = []
    place: list[tuple[int, int]] = []
    held = 0
    for row, text in enumerate(texts):
        whole = text.lower().split()
        for at in range(0, len(whole) - words + 1, _BLOCK):
            said.append(whole[at : at + _BLOCK + words - 1])
            place.append((row, at))
            held += len(said[-1])
            if held >= _BLOCK:
                out.append(_stretches(said, place, words))
                said, place, held = [], [], 0
    if said:
        out.append(_stretches(said, place, words))
    return tuple(np.concatenate(x) for x in zip(*out))


def _stretches(said: list[list[str]], place: list[tuple[int, int]], words: int):
    sizes, length = np.array([len(s) for s in said]), words - WINDOW + 1
    last, owner = np.repeat(np.cumsum(sizes), sizes), np.repeat(np.arange(len(said)), sizes)
    raw = np.frombuffer(" ".join(chain.from_iterable(said)).encode("utf-8", "surrogatepass"), np.uint8)
    gaps = np.flatnonzero(raw == 32)
    start, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    powers = np.full((2, len(raw)), [[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64)
    powers[:, 0] = 1
    up, down = np.cumprod(powers, axis=1, dtype=np.uint64)
    first = np.arange(len(start) - length + 1)
    high, low = (_hashes(_hashes(codes[raw], start, end, up, down), first, first + length, up, down) for codes in _BYTES)
    least = np.lib.stride_tricks.sliding_window_view(high, WINDOW).argmin(axis=1)
    first = first[: len(least)]
    taken = np.unique((first + least)[first + words <= last[: len(least)]])
    row, at = np.array(place, np.int64)[owner[taken]].T
    return row, at + taken - (last - sizes[owner])[taken], high[taken], low[taken]


def spans(docs: DataFrame, uid: str, run: int, words: int | None = None) -> DataFrame:
    """(uid, doc_id, at, high, low): runs by their first sentence, stretches by their first word less ``_WORD``."""

    def hashed(batches):
        for b in batches:
            for start, rows in common.slices(b.column(2), 256, 1 << 21):
                part = b.slice(start, rows)
                texts = [t or "" for t in part.column(2).to_pylist()]
                who, first, high, low = [], [], [], []
                for row, text in enumerate(texts):
                    for i, h, l in run_hashes(text, run):
                        who.append(row)
                        first.append(i)
                        high.append(h)
                        low.append(l)
                found = [(np.array(who, np.int64), np.array(first, np.int64), np.array(high, np.uint64), np.array(low, np.uint64))]
                if words:
                    who, first, high, low = stretch_hashes(texts, words)
                    found.append((who, first - _WORD, high, low))
                for who, first, high, low in found:
                    at = pa.array(who)
                    long = lambda x: pa.array(x.view(np.int64))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(first.astype(np.int32)), long(high), long(low)], ["uid", "doc_id", "at", "high", "low"])

    rows = docs.select(F.col(uid).alias("uid"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(common.tidy(hashed), "uid long, doc_id long, at int, high long, low long")


def covered(docs: DataFrame, uid: str, run: int = 3, words: int | None = None) -> DataFrame:
    """(uid, runs): for each row the places of its runs and stretches that are not the first of their hash."""
    found = common.save(spans(docs, uid, run, words), "spans")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "uid", "at")
    repeated = found.groupBy("high", "low").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("high", "low", "first")
    # Written first, so that the join deals out both sides itself and can split the rows of a very common run.
    repeated = common.save(repeated, "repeated")
    later = found.join(repeated, ["high", "low"]).where((F.col("uid") != F.col("first.uid")) | (F.col("at") != F.col("first.at")))
    return later.groupBy("uid").agg(F.collect_set("at").alias("runs"))


def without(text: str, found: list[int], run: int, length: int) -> tuple[int, int, str]:
    """Number of sentences, of those that lose words, and the text without the found runs and stretches."""
    edges = [0, *accumulate(len(p) for p in pieces(text))]
    sentences = {i for at in found if at >= 0 for i in range(at, at + run)}
    cuts = [(edges[i], edges[i + 1]) for i in sentences]
    if min(found) < 0:
        starts = [m.start() for m in _SAID.finditer(text)] + [len(text)]
        cuts += [(starts[at + _WORD], starts[at + _WORD + length]) for at in found if at < 0]
    left, done, touched = [], 0, set()
    for a, b in sorted(cuts):
        if b > done:
            left.append(text[done:a])
            touched.update(range(bisect_right(edges, max(a, done)) - 1, bisect_left(edges, b)))
            done = b
    return len(edges) - 1, len(touched), "".join(left) + text[done:]


def remove_repeats(docs: DataFrame, run: int = 3, words: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_sentences, n_removed (sentences that lose words), text without what repeats earlier text.

    Runs of ``run`` sentences go, and with ``words`` also passages of so many words or more, whatever their sentences.
    """
    if words is not None and words <= WINDOW:
        raise ValueError(f"words must be over {WINDOW}")
    uid = common.free_name(docs, "uid")
    own = common.with_uid(docs, uid)
    marks = covered(own, uid, run, words).withColumnRenamed("uid", uid)
    joined = own.select(uid, F.col("doc_id").cast("long"), F.col("text").cast("string")).join(marks, uid, "left").select("doc_id", "text", "runs")
    length = (words or 0) - WINDOW + 1

    def rebuilt(batches):
        for b in batches:
            rows = []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                rows.append(without(text, found, run, length) if found else (len(pieces(text or "")), 0, text))
            n, gone, texts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_sentences", "n_removed", "text"])

    return joined.mapInArrow(common.tidy(rebuilt), "doc_id long, n_sentences long, n_removed long, text string")
