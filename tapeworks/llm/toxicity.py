"""Toxicity by non-negative positive-unlabelled learning.

A linear model over word presence is fitted with numpy from confirmed toxic texts (P) and unlabelled texts (U). With
class prior p the risk is ``p R+(P) + max(0, R-(U) - p R-(P))``: the second part estimates the risk on clean texts and
is kept non-negative, so the model cannot explain U away. Features are words in at least ``support`` of P, chosen
against U by a two-proportion z score, and every text is scored whole.

The fit reads at most ``most_positive`` and ``most_unlabelled`` texts, picked by the hash of their id; the class prior
comes from all labels of the training fold. Labels of the held-out fold (crc32 of the id as text, mod 4, is 2) are never read.

Defined cases: a text without a telling word, null and empty ones included, gets the score of the bias alone, which is
0.25 at most, so nothing is rejected without evidence; without a positive example the
score is 0.0 for all; repeated rows are scored each; a null doc_id is in no fold (held_out false) and never used to
fit; an empty table gives no rows; other columns are ignored, or passed on by ``keep_clean``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Every ASCII byte that is not a letter ends a word; bytes of other scripts belong to words.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def word_set(text: bytes | None) -> set[bytes]:
    return set((text or b"").lower().translate(_LETTERS).split())


@dataclass
class Model:
    bias: float = -50.0
    weights: dict[bytes, float] = field(default_factory=dict)

    def score(self, text: bytes | None) -> float:
        found = self.weights.keys() & word_set(text)
        z = self.bias + sum(self.weights[w] for w in sorted(found))
        return 0.0 if z < -40 else float(1 / (1 + np.exp(-min(z, 40.0))))


def fit(side: np.ndarray, x: np.ndarray, words: list[bytes], prior: float, rounds: int = 600, rate: float = 0.1, decay: float = 2e-4) -> Model:
    """Non-negative PU fit with the logistic loss and Adam; deterministic. ``side`` is 1 for confirmed and 0 for unlabelled rows of ``x``."""
    n_p, n_u = int(side.sum()), int((side == 0).sum())
    if not n_p:
        return Model()
    if not n_u:
        return Model(bias=float(np.log(0.25 / 0.75)))
    base = float(np.log(prior / (1 - prior)))
    highest = float(np.log(0.25 / 0.75))
    if not words:
        return Model(bias=min(base, highest))
    xp, xu = x[side == 1], x[side == 0]
    w, bias = np.zeros(len(words)), base
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    sig = lambda t: 1 / (1 + np.exp(-np.clip(t, -40, 40)))
    for step in range(1, rounds + 1):
        narrow = w.astype(np.float32)
        zp, zu = (xp @ narrow).astype(float) + bias, (xu @ narrow).astype(float) + bias
        p_neg, u_neg = sig(zp), sig(zu)
        clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g = np.append(xu.T @ u_neg.astype(np.float32) / n_u - prior * (xp.T @ p_neg.astype(np.float32)) / n_p, u_neg.mean() - prior * p_neg.mean())
        if clean >= 0:
            g = g + np.append(prior * (xp.T @ (p_neg - 1).astype(np.float32)) / n_p, prior * (p_neg - 1).mean())
        else:  # the corrected risk fell below zero: step back up
            g = -g
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - change[:-1], bias - change[-1]
    return Model(min(float(bias), highest), {c: float(w[i]) for i, c in enumerate(words) if abs(w[i]) > 1e-3})


def train(docs: DataFrame, labels: DataFrame, most_positive: int = 4000, most_unlabelled: int = 8000, features: int = 1000, support: float = 0.02) -> Model:
    spark = docs.sparkSession
    fold = common.crc_fold(F.col("doc_id"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold != 2))
    total, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic:
        return Model()
    prior = min(0.9, max(1e-4, toxic / total))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    positive = known.where("toxic = 1").select("doc_id").distinct().orderBy(*order).limit(most_positive)
    pool = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & (fold != 2))
    unlabelled = pool.distinct().orderBy(*order).limit(most_unlabelled)
    picked = positive.withColumn("p", F.lit(1)).unionByName(unlabelled.withColumn("p", F.lit(0)))
    #: At most most_positive + most_unlabelled rows of one id each; one text of an id that repeats.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id", "p").agg(F.min("text").alias("text")).select("p", "text")

    def worded(batches):
        for b in common.parts(batches, 1):
            words = [sorted(word_set(t)) for t in common.utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.binary()))], ["p", "words"])

    with common.scope(spark):
        rows = common.save(texts.mapInArrow(common.tidy(worded), "p int, words array<binary>"), "words")
        n_p, n_u = rows.agg(F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum(1 - F.col("p")), F.lit(0))).first()
        if not n_p or not n_u:
            return fit(np.repeat([1, 0], [n_p, n_u]), np.zeros((n_p + n_u, 0), np.float32), [], prior)
        # Word counts stay in the cluster; the telling words and their places in each text come to the driver.
        counted = rows.select("p", F.explode("words").alias("word")).groupBy("word").agg(F.sum("p").alias("a"), F.sum(1 - F.col("p")).alias("b"))
        pooled = (F.col("a") + F.col("b") + 1) / F.lit(n_p + n_u + 2)
        z = (F.col("a") / n_p - F.col("b") / n_u) / F.sqrt(pooled * (1 - pooled) * F.lit(1 / n_p + 1 / n_u))
        able = counted.withColumn("z", z).where((F.col("a") >= max(5, support * n_p)) & (F.col("z") >= 5))
        chosen = sorted(bytes(r["word"]) for r in able.orderBy(F.desc("z"), "word").limit(features).collect())
        #: At most ``features`` words.
        column = spark.sparkContext.broadcast({w: i for i, w in enumerate(chosen)})

        def placed(batches):
            for b in batches:
                out = [np.array(sorted(column.value[w] for w in ws if w in column.value), "<i4").tobytes() for ws in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["p", "places"])

        found = rows.mapInArrow(common.tidy(placed), "p int, places binary").toArrow()
        # Sums in single precision depend on the order of rows: that of their own content.
        held = sorted(zip(found.column("p").to_pylist(), found.column("places").to_pylist()))
        x = np.zeros((len(held), len(chosen)), np.float32)
        for i, (_, places) in enumerate(held):
            x[i, np.frombuffer(places, "<i4")] = 1
        return fit(np.array([p for p, _ in held]), x, chosen, prior)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches):
        for b in common.parts(batches, 1):
            score = np.fromiter((model.score(t) for t in common.utf8(b.column(1))), np.float64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= 0.3).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(common.tidy(run), "doc_id long, score double, predicted int")
    held = F.coalesce(common.crc_fold(F.col("doc_id")) == 2, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, model: Model, reject_at: float = 0.3) -> DataFrame:
    """The rows whose text scores below ``reject_at``, all columns unchanged."""
    at = docs.columns.index("text")

    def run(batches):
        for b in common.parts(batches, at):
            keep = [model.score(t) < reject_at for t in common.utf8(b.column(at))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(common.tidy(run), docs.schema)
