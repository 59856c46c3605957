"""Concatenate and cut: documents end to end, cut into windows of fixed length.

Pass one tokenises each partition once, writes the ids with their running offset inside the partition to the shared
folder and adds up partition totals. A prefix sum over those totals gives every document its global offset. Pass two
cuts each document at the window boundaries it crosses and emits one boundary record per piece. Only the last window
can be short. Order is the scan order of the table.

Defined cases: null or empty text is the closing id alone; repeated rows are packed again; a null doc_id stays null;
an empty table gives no pieces; other columns are ignored. A text with characters outside the plain range, or with a
special token's string, goes through the tokenizer whole; other texts go word by word through a bounded cache, which
gives the same ids since the tokenizer never joins across white space.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Printable ASCII, tab, line feed, carriage return and Latin-1 letters and signs; anything else takes the whole path.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]")
_LOADED: dict = {}


class WordTokenizer:
    """Ids of texts under a tokenizers file with end-of-word tokens, by a cache of white-space separated words.

    The cache has a young and an old half; a full young half replaces the old one and words met again move on, so at
    most ``most`` words and one slice's are held and common ones stay.

    Unknown words are cut as the tokenizer's own pattern cuts them, encoded together in one call and told apart by the
    tokens that end a word. Ids are little-endian, 16 bits wide if the vocabulary fits.
    """

    #: Fixed value: the file's split pattern, for text inside the plain range.
    _CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\sa-z0-9\xaa\xb5\xba\xb2\xb3\xb9\xbc-\xbe\xdf-\xf6\xf8-\xff]+")

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        vocabulary = self.model.get_vocab()
        top = max(vocabulary.values()) + 1
        self.kind = "<u2" if top <= 1 << 16 else "<u4"
        self.ends = np.zeros(top, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.most = most
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _learn(self, words: list[str]) -> None:
        find = self._CUT.findall
        # most words are letters, or letters and one closing sign
        cut = [(w,) if w.isalpha() else (w[:-1], w[-1]) if w[-1] in ".,|" and w[:-1].isalpha() else find(w) for w in words]
        known, old = self.known, self.old
        fresh = [p for p in {p for c in cut for p in c} if p not in known and p not in old]
        part = {}
        for at in range(0, len(fresh), 8192):  # the tokenizer's working memory is some hundred bytes a piece
            some = fresh[at : at + 8192]
            ids = self._ids(" ".join(some))
            edges = np.flatnonzero(self.ends[ids]) + 1
            if len(edges) != len(some):
                raise ValueError("the tokenizer does not mark the ends of words")
            raw, width = ids.tobytes(), ids.itemsize
            bounds = [0, *(edges * width).tolist()]
            part.update((p, raw[bounds[i] : bounds[i + 1]]) for i, p in enumerate(some))
        get = lambda p: part.get(p) or known.get(p) or old[p]
        known.update([(w, get(c[0]) if len(c) == 1 else b"".join([get(p) for p in c])) for w, c in zip(words, cut)])

    def _by_word(self, texts: list[str]) -> list[bytes]:
        """Texts of the plain range: split and coded in Arrow, distinct words looked up once, ids gathered in numpy."""
        split = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
        coded = pc.list_flatten(split).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        held = list(map(self.known.get, words))
        new = []
        for i in [i for i, h in enumerate(held) if h is None]:
            ids = held[i] = self.old.get(words[i])
            if ids is None:
                new.append(i)
            else:
                self.known[words[i]] = ids
        if new:
            self._learn([words[i] for i in new])
            for i in new:
                held[i] = self.known[words[i]]
        if 2 * len(self.known) > self.most:
            self.old, self.known = self.known, {"": b""}
        width = np.dtype(self.kind).itemsize
        flat = np.frombuffer(b"".join(held), self.kind)
        sizes = np.fromiter(map(len, held), np.int32, len(held)) // np.int32(width)
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        index = coded.indices.to_numpy()
        n = sizes[index]
        ends = np.cumsum(n, dtype=np.int32)
        at = np.repeat(starts[index] - ends + n, n)
        at += np.arange(len(at), dtype=np.int32)
        raw = flat[at].tobytes()
        bounds = (np.concatenate([[0], ends])[split.offsets.to_numpy()].astype(np.int64) * width).tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; words new to the cache are learnt once for all texts."""
        whole = [bool(_UNUSUAL.search(t)) or any(s in t for s in self.special) for t in texts]
        plain = iter(self._by_word([t for t, w in zip(texts, whole) if not w]))
        return [self._ids(t).tobytes() if w else next(plain) for t, w in zip(texts, whole)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def tokenizer(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, part, before, n, ids): ids as little-endian 16-bit words if they fit, else 32-bit; before = ids earlier in the partition."""

    def run(batches):
        model, part, before = tokenizer(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], model.kind).tobytes()
        width = len(end)
        for b in batches:
            for start, rows in common.slices(b.column(1)):
                ids = [x + end for x in model.encode_all([t or "" for t in b.column(1).slice(start, rows).to_pylist()])]
                n = np.fromiter((len(x) // width for x in ids), np.int64, len(ids))
                ahead = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(start, rows), pa.array(np.full(len(ids), part, np.int64)), pa.array(ahead), pa.array(n), pa.array(ids, pa.binary())],
                    ["doc_id", "part", "before", "n", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(common.tidy(run), "doc_id long, part long, before long, n long, ids binary")


def offsets(tokens: DataFrame) -> DataFrame:
    """(part, base): prefix sums of partition totals; one row per partition of the scan."""
    from pyspark.sql import Window

    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(w), F.lit(0)).cast("long").alias("base"))


def pieces(placed: DataFrame, window: int) -> DataFrame:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc, at, n, raw in zip(*(b.column(i).to_pylist() for i in range(4))):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(window - offset, n - start)
                    row = (doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), n, sequence, offset)
                    for column, value in zip(out, row):
                        column.append(value)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    return placed.mapInArrow(common.tidy(run), ", ".join(f"{c} long" for c in names))


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = common.save(tokenised(docs, path, end_id), "tokens")
    base = offsets(tokens)
    #: One 16-byte row per partition of the scan, so the broadcast is bounded by the number of tasks.
    placed = tokens.join(F.broadcast(base), "part")
    return pieces(placed.select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "ids"), window)
