"""Cross-entropy difference of two matched word bigram models.

Tokens are the white-space separated words of the lower-cased text. Target and background share one vocabulary: the
commonest words of all texts, ``most_words`` at most, with one more token for every other word and a start mark ahead of
each text, so no text is out of vocabulary. Words are taken by count, down to the last 64th of a power of two that fits whole. The target model counts the target texts, the background model all texts, and
both use the same smoothing: a bigram share with a Dirichlet prior on the smoothed unigram share. A text's score is the
mean over its tokens of the target loss minus the background loss, in nats: lower is closer to the target.

The vocabulary and its unigram counts are bounded by ``most_words``; the bigram table grows with the texts and is
never gathered. Texts are held as slices of token numbers. Each slice counts its own bigrams and sends each distinct
one, once, to the bucket of its hash; the bucket adds up the counts of all slices and answers every slice that asked.
A bigram found everywhere thus has one row for each slice, not for each text, and a bucket holds a bounded number of rows.

Defined cases: null and empty texts have no tokens and score 0.0; without any target text the target model is the
uniform one; repeated rows count each time; a null doc_id has no label, so it is background only; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Token numbers are 16 bits wide: 0 is any other word, the last is the start mark.
OTHER, START, V = 0, 0xFFFF, 1 << 16
#: Weight of the prior, in tokens.
PRIOR = 20.0
#: Rows of one slice at most, as a power of two.
ROWS_BITS = 12
_ODD = np.uint64(0x9E3779B97F4A7C15)


def coded(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of the texts end to end, dictionary coded, and the number of words of each text."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat = split.flatten()
    some = pc.not_equal(flat, "")
    ahead = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    edges = split.offsets.to_numpy()
    return flat.filter(some).dictionary_encode(), np.diff(ahead[edges - edges[0]])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of ``texts(text)``, every word of every text."""

    def run(batches):
        for b in batches:
            for start, rows in common.slices(b.column(0)):
                counted = pc.value_counts(coded(b.column(0).slice(start, rows))[0])
                values, n = counted.field("values"), counted.field("counts")
                values = values.dictionary.take(values.indices) if isinstance(values, pa.DictionaryArray) else values
                yield pa.RecordBatch.from_arrays([values.cast(pa.string()), n.cast(pa.int64())], ["word", "n"])

    return texts.mapInArrow(common.tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counted: DataFrame, most_words: int) -> pa.Array:
    """The words in whole ranks from the top, a rank being a 64th of a power of two; so no ties need an order."""
    rank = F.floor(F.log2("n") * 64)
    # At most 64 * 64 ranks.
    sizes = counted.groupBy(rank.alias("rank")).agg(F.count("*").alias("words")).orderBy(F.desc("rank")).collect()
    held, least = 0, None
    for r in sizes:
        held += r["words"]
        if held > most_words:
            break
        least = r["rank"]
    if least is None:
        return pa.array([], pa.large_string())
    #: At most most_words words.
    words = counted.where(rank >= least).select("word").toArrow().column("word").combine_chunks()
    return words.cast(pa.large_string()).sort()


def token_slices(rows: DataFrame, words) -> DataFrame:
    """(sid, first, ids, sizes, tokens) of ``rows(uid, doc_id, text)``: runs of rows as token numbers end to end."""

    def run(batches):
        known = words.value
        for b in batches:
            sid = b.column(0).to_numpy() >> ROWS_BITS
            edges = [0, *(np.flatnonzero(np.diff(sid)) + 1).tolist(), b.num_rows]
            for low, high in zip(edges, edges[1:]):
                for at, n in common.slices(b.column(2).slice(low, high - low)):
                    part = b.slice(low + at, n)
                    flat, sizes = coded(part.column(2))
                    number = pc.add(pc.fill_null(pc.index_in(flat.dictionary, value_set=known), -1), 1).to_numpy(zero_copy_only=False)
                    tokens = number.astype("<u2")[flat.indices.to_numpy()] if len(flat) else np.empty(0, "<u2")
                    ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(1))
                    uid = part.column(0)[0].as_py()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uid >> ROWS_BITS]), pa.array([uid & (1 << ROWS_BITS) - 1]), ids, pa.array([sizes.astype("<u4").tobytes()], pa.binary()), pa.array([tokens.tobytes()], pa.binary())],
                        ["sid", "first", "ids", "sizes", "tokens"],
                    )

    return rows.mapInArrow(common.tidy(run), "sid long, first long, ids array<long>, sizes binary, tokens binary")


class Slice:
    """One slice: bigram keys (context << 16 | token) and whether each is in a target text."""

    def __init__(self, first: int, sizes: bytes, tokens: bytes, targets: list | None):
        self.sizes = np.frombuffer(sizes, "<u4").astype(np.int64)
        self.tokens = np.frombuffer(tokens, "<u2")
        ends = np.cumsum(self.sizes)
        self.context = np.concatenate([[START], self.tokens[:-1]]).astype(np.uint32) if len(self.tokens) else np.empty(0, np.uint32)
        self.context[(ends - self.sizes)[self.sizes > 0]] = START
        self.keys = self.context << np.uint32(16) | self.tokens
        aim = np.zeros(len(self.sizes), bool)
        place = np.array(targets or [], np.int64) - first
        aim[place[(place >= 0) & (place < len(aim))]] = True
        self.target = np.repeat(aim, self.sizes)

    def asked(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order of bucket and key, the bucket of each, and the place of each token's key."""
        distinct, place = np.unique(self.keys, return_inverse=True)
        bucket = ((distinct.astype(np.uint64) * _ODD >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return distinct[order], bucket[order], rank[place]


def _slices_of(batch, names: str):
    """(row number, Slice) of each row."""
    columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names.split()]
    for row, (first, sizes, tokens, targets) in enumerate(zip(*columns)):
        yield row, Slice(first, sizes, tokens, targets)


_OF = "first sizes tokens targets"


def unigrams(held: DataFrame) -> np.ndarray:
    """Rows of counts by token number: background and target as token, background and target as context."""

    def run(batches):
        total = np.zeros((4, V), np.int64)
        for b in batches:
            for _, s in _slices_of(b, _OF):
                for i, x in enumerate((s.tokens, s.tokens[s.target], s.context, s.context[s.target])):
                    total[i] += np.bincount(x, minlength=V)
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(t[some]) for t in total]], ["token", "b", "t", "cb", "ct"])

    rows = held.select(*_OF.split()).mapInArrow(common.tidy(run), "token long, b long, t long, cb long, ct long")
    table = rows.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("b", "t", "cb", "ct")]).toArrow()
    out = np.zeros((4, V), np.int64)
    for i, c in enumerate(("b", "t", "cb", "ct")):
        out[i][table.column("token").to_numpy()] = table.column(c).to_numpy()
    return out


def losses(keys: np.ndarray, pairs: np.ndarray, tokens: np.ndarray, contexts: np.ndarray, size: int) -> np.ndarray:
    """Loss in nats of each bigram key under one model. ``size`` is the number of tokens a text can have."""
    total = tokens.sum()
    word, context = keys & 0xFFFF, keys >> 16
    lower = (tokens[word] + 1.0) / (total + size)
    if not total:
        return np.full(len(keys), math.log(size))
    return -np.log((pairs + PRIOR * lower) / (contexts[context] + PRIOR))


def asks(held: DataFrame, buckets: int) -> DataFrame:
    """(bucket, sid, first, keys, b, t): the counts of a slice's distinct bigrams, by bucket."""

    def run(batches):
        for b in batches:
            for row, s in _slices_of(b, _OF):
                keys, bucket, place = s.asked(buckets)
                if not len(keys):
                    continue
                n = [np.bincount(p, minlength=len(keys)).astype("<u4") for p in (place, place[s.target])]
                edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(keys)]
                cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(edges, edges[1:])], pa.binary())
                same = pa.array(np.full(len(edges) - 1, row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[edges[:-1]]), b.column(0).take(same), b.column(1).take(same), cut(keys.astype("<u4")), cut(n[0]), cut(n[1])], ["bucket", "sid", "first", "keys", "b", "t"]
                )

    return held.select("sid", *_OF.split()).mapInArrow(common.tidy(run), "bucket long, sid long, first long, keys binary, b binary, t binary")


def answers(asked: DataFrame) -> DataFrame:
    """(bucket, sid, first, b, t): for each slice's keys the counts over all slices. Holds one bucket at a time."""

    def add(held):
        sizes = [len(r[3]) // 4 for r in held]
        distinct, place = np.unique(np.frombuffer(b"".join(r[3] for r in held), "<u4"), return_inverse=True)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        out = []
        for c in (4, 5):
            # sums below 2**53 are exact
            total = np.bincount(place, np.frombuffer(b"".join(r[c] for r in held), "<u4"), len(distinct))
            got = total[place].astype("<u8")
            out.append(pa.array([got[i:j].tobytes() for i, j in zip(edges, edges[1:])], pa.binary()))
        head = [pa.array([r[i] for r in held], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*head, *out], ["bucket", "sid", "first", "b", "t"])

    def run(batches):
        held: list = []
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(6))):
                if held and r[0] != held[0][0]:
                    yield from add(held)
                    held = []
                held.append(r)
        if held:
            yield from add(held)

    return asked.repartition("bucket").sortWithinPartitions("bucket", "sid", "first").mapInArrow(common.tidy(run), "bucket long, sid long, first long, b binary, t binary")


def score(docs: DataFrame, labels: DataFrame, target: str = "quality = 1", most_words: int = 65_000, bucket_tokens: int = 2_000_000) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, ce_target_minus_background of every row; target texts are those whose label meets ``target``."""
    spark = docs.sparkSession
    uid = common.free_name(docs, "uid")
    own = common.with_uid(docs, uid).select(F.col(uid).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    top = vocabulary(common.save(word_counts(own.select("text")), "words"), min(most_words, START - 1))
    words = spark.sparkContext.broadcast(top)

    wanted = labels.where(target).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    in_slice = own.select("uid", "doc_id").join(wanted, "doc_id").groupBy(F.shiftright("uid", ROWS_BITS).alias("sid"))
    targets = in_slice.agg(F.collect_list(F.col("uid").bitwiseAND(F.lit((1 << ROWS_BITS) - 1))).alias("targets"))
    held = common.save(token_slices(own, words).join(targets, "sid", "left"), "slices")

    counts = unigrams(held)
    size = len(top) + 1
    model = spark.sparkContext.broadcast(counts)
    buckets = max(1, math.ceil(int(counts[0].sum()) / bucket_tokens))
    replies = answers(asks(held, buckets)).groupBy("sid", "first").agg(F.sort_array(F.collect_list(F.struct("bucket", "b", "t"))).alias("got"))

    def run(batches):
        one = model.value
        for b in batches:
            got = b.column(b.schema.get_field_index("got")).to_pylist()
            ids = b.column(b.schema.get_field_index("ids"))
            for row, s in _slices_of(b, _OF):
                keys, _, place = s.asked(buckets)
                both = [np.frombuffer(b"".join(g[c] for g in got[row] or []), "<u8").astype(np.float64) for c in ("b", "t")]
                ends = np.cumsum(s.sizes)
                mean = []
                for i in (0, 1):
                    loss = losses(keys, both[i], one[i], one[2 + i], size)
                    ahead = np.concatenate([[0.0], np.cumsum(loss[place])])
                    mean.append(np.divide(ahead[ends] - ahead[ends - s.sizes], s.sizes, out=np.zeros(len(ends)), where=s.sizes > 0))
                yield pa.RecordBatch.from_arrays(
                    [ids[row].values if ids[row].values is not None else pa.array([], pa.int64()), pa.array(s.sizes), pa.array(mean[1]), pa.array(mean[0]), pa.array(mean[1] - mean[0])],
                    ["doc_id", "n_tokens", "loss_target", "loss_background", "ce_target_minus_background"],
                )

    joined = held.join(replies, ["sid", "first"], "left").select("ids", *_OF.split(), "got")
    return joined.mapInArrow(common.tidy(run), "doc_id long, n_tokens long, loss_target double, loss_background double, ce_target_minus_background double")
