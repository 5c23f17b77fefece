"""Quality classifier: Naive Bayes support vectors.

Binary n-gram indicators (hashed words, and 1- to 3-grams of word shapes) are scaled by the ratio
of the classes' smoothed log counts; a linear hinge-loss model is then fitted to the scaled,
length-normalised indicators by dual coordinate descent, and its margin is mapped to a probability.

The model is fitted on at most MAX_ROWS labelled rows, those with the smallest hashes of their id;
scoring covers every row. The sample's ids are broadcast (at most MAX_ROWS), so no text is shuffled
except the sample's, and one task fits the model on it.

Defined results: null text is the empty text and has the bias as its only indicator; labels that
repeat an id are averaged (a tie is 0), null labels and ids are ignored; with one class or none in
the sample every score is that class's share (0.5 without labels); rows that repeat an id are
scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fold_of, pieces, text_of

#: Labelled rows that the model is fitted on.
MAX_ROWS = 12_000
#: Hashed indicators.
BUCKETS = 1 << 18
SMOOTHING = 1.0
COST = 1.0
PASSES = 12
THRESHOLD = 0.3
SEED = 7
#: Words whose indicators a worker keeps.
MEMO = 200_000
_PART = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def _shape(part: str) -> str:
    """U upper, T title, l lower and m mixed words, 9 digits, else up to three marks."""
    if part[0].isdigit():
        return "9"
    if not part[0].isalpha():
        return part[:3]
    return "U" if part.isupper() and len(part) > 1 else "T" if part.istitle() else "l" if part.islower() else "m"


class _Codes(dict):
    def __missing__(self, part: str) -> int:
        """Word hash in the low half, shape hash in the high half."""
        from xxhash import xxh32_intdigest

        if len(self) >= MEMO:
            self.clear()
        self[part] = out = xxh32_intdigest(part.lower()) | (xxh32_intdigest(_shape(part)) << 32)
        return out


_codes = _Codes()


def indicators(text: str) -> np.ndarray:
    """The distinct hashed n-grams of a text, bias 0 included."""
    parts = _PART.findall(text)
    code = np.fromiter(map(_codes.__getitem__, parts), np.uint64, len(parts))
    word, s = code & np.uint64(0xFFFFFFFF), code >> np.uint64(32)
    mix = lambda x, salt: (x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) >> np.uint64(20)
    two = s[:-1] * np.uint64(31) + s[1:]
    found = np.concatenate([mix(word, 1), mix(s, 2 << 40), mix(two, 3 << 41), mix(two[:-1] * np.uint64(37) + s[2:], 5 << 42)]) % np.uint64(BUCKETS - 1)
    return np.append(0, np.unique(found).astype(np.int64) + 1)


@dataclass(frozen=True)
class NbSvm:
    """Weights of the indicators (already scaled by the ratios), their squared ratios, and the margin's mapping."""

    weights: np.ndarray
    squares: np.ndarray
    slope: float
    offset: float

    def margin(self, text: str) -> float:
        x = indicators(text)
        return float(self.weights[x].sum() / np.sqrt(self.squares[x].sum()))

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -30, 30)))


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = COST, passes: int = PASSES, seed: int = SEED) -> NbSvm:
    """Fit to indicators and 0/1 labels; a fifth of the rows, taken by their order, maps margins to probabilities."""
    y = np.where(labels > 0, 1.0, -1.0)
    share = float((y > 0).mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        flat = np.clip(share, 1e-6, 1 - 1e-6)
        return NbSvm(np.zeros(BUCKETS), np.ones(BUCKETS), 0.0, float(np.log(flat / (1 - flat))))

    def solve(train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = {s: np.full(BUCKETS, SMOOTHING) for s in (1.0, -1.0)}
        for i in train:
            counts[y[i]][rows[i]] += 1
        n = {s: (y[train] == s).sum() + 2 * SMOOTHING for s in (1.0, -1.0)}
        ratio = np.log(counts[1.0] / n[1.0]) - np.log(counts[-1.0] / n[-1.0])
        ratio[0] = 1.0  # bias
        squares = ratio**2
        x = [ratio[rows[i]] / np.sqrt(squares[rows[i]].sum()) for i in train]
        w, alpha, rng = np.zeros(BUCKETS), np.zeros(len(train)), np.random.default_rng(seed)
        # classes weigh the same, whatever their shares
        upper = cost * len(train) / (2 * np.where(y[train] > 0, (y[train] > 0).sum(), (y[train] < 0).sum()))
        for _ in range(passes):
            for k in rng.permutation(len(train)):
                i, xi = train[k], x[k]
                g = y[i] * (w[rows[i]] @ xi) - 1  # rows have unit length
                new = min(max(alpha[k] - g, 0.0), upper[k])
                if new != alpha[k]:
                    w[rows[i]] += (new - alpha[k]) * y[i] * xi
                    alpha[k] = new
        return w * ratio, squares

    every, held = np.arange(len(y)), np.arange(len(y)) % 5 == 4
    rest = every[~held]
    if len(set(y[rest].tolist())) == 2 and held.any():
        w, squares = solve(rest)
        margins, z = np.array([w[rows[i]].sum() / np.sqrt(squares[rows[i]].sum()) for i in every[held]]), (y[held] > 0).astype(float)
    else:
        w, squares = solve(every)
        margins, z = np.array([w[r].sum() / np.sqrt(squares[r].sum()) for r in rows]), (y > 0).astype(float)
    # logistic map of the margin, with smoothed targets, by Newton steps
    pos, neg = z.sum(), len(z) - z.sum()
    target = np.where(z > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        r, d = p - target, p * (1 - p)
        h = np.array([[(d * margins**2).sum() + 1e-3, (d * margins).sum()], [(d * margins).sum(), d.sum() + 1e-6]])
        step = np.linalg.solve(h, [(r * margins).sum() + 1e-3 * (a - 1.0), r.sum()])
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-8:
            break
    w, squares = solve(every)
    return NbSvm(w, squares, max(a, 1e-3), b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> NbSvm:
    """Fit on at most max_rows labelled rows of docs."""
    given = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg((F.avg(label_col) > 0.5).cast("int").alias("label"))
    # labels without a document don't count towards the sample
    chosen = given.join(docs.select(F.col(id_col).alias("__id")), "__id", "left_semi").orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "__id")
    # rows that repeat a labelled id would count over and over: the first text of an id is fitted
    sample = rows.groupBy("__id").agg(F.min(F.struct("text", "label")).alias("r")).select("__id", "r.text", "r.label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = [], []
        for batch in pieces(batches):
            x += [indicators(t).astype(np.int32) for t in batch.column("text").to_pylist()]
            y += batch.column("label").to_pylist()
        model = fit(x, np.array(y))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype("<f4").tobytes()]), pa.array([model.squares.astype("<f4").tobytes()]), pa.array([model.slope]), pa.array([model.offset])], names=["weights", "squares", "slope", "offset"])

    # one task sees the bounded sample, in order of the ids' hashes
    one = sample.repartition(1).sortWithinPartitions(F.xxhash64("__id"), "__id").select("text", "label").mapInArrow(run, "weights binary, squares binary, slope double, offset double").first()
    if one is None:
        return fit([], np.zeros(0))
    return NbSvm(np.frombuffer(one["weights"], "<f4"), np.frombuffer(one["squares"], "<f4"), one["slope"], one["offset"])


def quality(spark: SparkSession, model: NbSvm, text: Column) -> Column:
    """The probability of label 1 of a text."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.probability(np.array([sent.value.margin(t) for t in texts.to_pylist()], np.float64)))

    return run(text)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from four fifths of the labelled ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(fold_of("doc_id", 5) != 0))
    rows = docs.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), quality(spark, model, text_of("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
