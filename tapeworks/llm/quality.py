"""Quality rules by learned decision lists.

Text statistics come from one pass over whole texts. The learner is sequential covering in the manner of incremental
reduced-error pruning: for the class "low" it grows a conjunction of threshold tests on two thirds of the labelled
statistics by information gain, prunes it from the end on the other third, keeps it while its precision there is
high enough, removes the rows it covers and goes on. The list is emitted as one ordered Spark CASE expression.

The learner reads at most ``most_labelled`` labelled rows, picked by the hash of their id, and one text of each; statistics
and verdicts cover every text.

Defined cases: a null text counts as empty and fails the base rule (fewer than 50 words); without labels the list is
empty and every text that passes the base rule is kept; repeated rows are judged each; a null doc_id is judged like
any other but never used to learn; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_BANG = bytes(c for c in range(256) if c not in b"!?")

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs"]

#: Ratios the rules may test, as SQL over the counts; the same text serves the learner and the emitted expression.
RATIOS = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def repeat_words(words: list, width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more, the first one included."""
    n = len(words)
    if n <= width:
        return 0
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    v = len(known)
    if v == n:
        return 0
    key = ids[: n - width + 1].copy()
    for i in range(1, width):
        if v < 1 << 20:
            key = key * v + ids[i : n - width + 1 + i]
        else:  # keep products inside 64 bits
            key = np.unique(key, return_inverse=True)[1] * v + ids[i : n - width + 1 + i]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(key), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for i in range(width):
        covered[i : n - width + 1 + i] |= hit
    return int(covered.sum())


def counts(text: str | None) -> list[int]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = text.split("\n")
    seen: set = set()
    dup = 0
    for line in lines:
        if line in seen:
            dup += bool(line.strip(_SPACES))
        else:
            seen.add(line)
    return [
        len(words),
        len(text) - sum(text.count(c) for c in _SPACES),
        sum(raw.count(c) for c in _SYMBOLS),
        dup,
        repeat_words(words),
        len(lines),
        len(raw.translate(None, _UPPER)),
        len(raw.translate(None, _NOT_BANG)),
    ]


def statistics(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, the extra columns and the counts of every row."""
    n = 1 + len(extra)

    def run(batches):
        for b in common.parts(batches, n):
            rows = np.array([counts(t) for t in b.column(n).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            arrays = [b.column(i) for i in range(n)] + [pa.array(rows[:, i]) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *extra, *COUNTS])

    rows = docs.select(F.col("doc_id").cast("long"), *extra, F.col("text").cast("string"))
    head = ["doc_id long", *(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[1:n])]
    return rows.mapInArrow(run, ", ".join(head + [f"{c} long" for c in COUNTS]))


@dataclass(frozen=True)
class Test:
    ratio: str
    above: bool
    bound: float

    def sql(self) -> str:
        return f"({RATIOS[self.ratio]}) {'>=' if self.above else '<='} {self.bound!r}D"

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, list(RATIOS).index(self.ratio)]
        return column >= self.bound if self.above else column <= self.bound


Rule = tuple[Test, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for t in rule:
        hit &= t.holds(x)
    return hit


def _best_test(x: np.ndarray, low: np.ndarray) -> tuple[float, Test | None]:
    """Information gain of the foil kind: p1 * (log2 share after - log2 share before), over all cut points at once."""
    total_p, total = low.sum(), len(low)
    before = np.log2(total_p / total)
    best: tuple[float, Test | None] = (0.0, None)
    for i, name in enumerate(RATIOS):
        order = np.argsort(x[:, i], kind="stable")
        v, p = x[order, i], np.cumsum(low[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        middle = (v[cut] + v[cut + 1]) / 2
        for above in (False, True):
            p1 = (total_p - p[cut] if above else p[cut]).astype(float)
            n1 = (total - cut - 1 if above else cut + 1).astype(float)
            gain = np.where(p1 > 0, p1 * (np.log2(np.maximum(p1, 1e-9) / n1) - before), 0)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), Test(name, above, float(middle[k])))
    return best


def learn(x: np.ndarray, low: np.ndarray, least_precision: float = 0.6, least_cover: int = 3, most_rules: int = 12) -> list[Rule]:
    """Ordered rules for the class low, from the ratios ``x`` and 0/1 labels; deterministic."""
    rules: list[Rule] = []
    low = low.astype(bool)
    rng = np.random.default_rng(7)
    while low.sum() >= least_cover and len(rules) < most_rules:
        part = rng.permutation(len(low)) % 3
        grow, prune = part != 0, part == 0
        if not low[grow].any() or not low[prune].any():
            break
        rule: Rule = ()
        inside = grow.copy()
        while len(rule) < 4 and not low[inside].all():
            gain, test = _best_test(x[inside], low[inside])
            if test is None:
                break
            rule += (test,)
            inside &= test.holds(x)

        def worth(r: Rule) -> float:
            hit = _covers(r, x) & prune
            p, n = int((hit & low).sum()), int((hit & ~low).sum())
            return (p - n) / (p + n) if p + n else -1.0

        if not rule:
            break
        rule = max((rule[:i] for i in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))
        hit = _covers(rule, x)
        p, n = int((hit & low).sum()), int((hit & ~low).sum())
        held = hit & prune
        if p < least_cover or p / (p + n) < least_precision or (low & held).sum() < least_precision * held.sum():
            break
        rules.append(rule)
        x, low = x[~hit], low[~hit]
    return rules


def expression(rules: list[Rule]):
    """The verdict "keep" as an ordered conditional expression over the counts."""
    if not rules:
        return F.lit(True)
    cases = " ".join(f"WHEN {' AND '.join(t.sql() for t in r)} THEN false" for r in rules)
    return F.expr(f"CASE {cases} ELSE true END")


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000) -> list[Rule]:
    """Rules from labelled statistics; a row with fewer than 50 words is left to the base rule."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id is not null and quality is not null")
    #: Two numbers a row, at most most_labelled rows.
    picked = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most_labelled)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    # One text of an id that repeats, so the rows are bounded whatever the ids.
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = statistics(texts, "quality").where("n_words >= 50").select("doc_id", "quality", *[F.expr(f"cast({sql} as double)").alias(k) for k, sql in RATIOS.items()]).toPandas()
    rows = rows.sort_values(["doc_id", "quality", *RATIOS], kind="stable")
    return learn(rows[list(RATIOS)].to_numpy(np.float64), (rows["quality"] == 0).to_numpy())


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row."""
    rows = statistics(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & expression(rules))
