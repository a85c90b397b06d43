"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of the training folds with quality 1, at most ``LABELLED``; the unlabelled web text is a
sample of all documents of these folds, at most ``UNLABELLED``, whatever their labels are, so the prior is the corpus's. Both take
the lowest hashes of doc_id. The class prior is estimated from held-back parts of both: for any
set A of scores, prior <= P_u(A) / P_p(A), so the least such ratio over upper sets of scores is the estimate.
A linear model is then fitted by mini-batches on the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the logistic loss, so that the model's sigmoid estimates the probability of quality. Where the second
term falls below zero on a batch, the step goes up it instead, which keeps the model from fitting the positives away.

Inputs are byte classes, repetition and length of the whole text and its hashed byte trigrams; never labels,
lang, source or doc_id. Every text is scored whole where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbraframe.llm.common import ready, release_memory, table, whole_text

#: The bounds of the samples of labelled positives and of unlabelled documents.
LABELLED, UNLABELLED = 4_000, 4_000
THRESHOLD = 0.3
HASHED = 1_024
DENSE = 21
#: Weight of the hashed features beside the others, and where scaled ones are cut off.
HASHED_SHARE, CUT = 0.1, 3.0

_CLASSES = np.full(256, 8, np.uint8)  # other ASCII
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\v\f", b"\n", b"!?", b"|", b"#$%&*@^~<>{}[]\\=+_")):
    _CLASSES[np.frombuffer(_chars, np.uint8)] = _i
_CLASSES[np.frombuffer(b".,;:'\"()-", np.uint8)] = 9
_CLASSES[128:] = 10


def dense_features(text: str, raw: np.ndarray) -> list[float]:
    """Shares of byte classes, word shape and repetition, length."""
    n = len(raw)
    if not n:
        return [0.0] * DENSE
    shares = (np.bincount(_CLASSES[raw], minlength=11) / n).tolist()
    words = text.split()
    k = max(len(words), 1)
    same = sum(map(eq, words, words[1:])) / k
    upper = sum(map(str.isupper, words)) / k
    # A few per cent of shouting, bars, symbols or repeats already tell: these saturate early.
    early = [min(1.0, x) for x in (5 * same, 5 * upper, 50 * shares[5], 50 * shares[6], 20 * shares[7])]
    return [*shares, len(set(words)) / k, same, n / k / 10, float(np.log1p(n)), upper, *early]


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Hashes below HASHED of each three neighbouring bytes."""
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    a = raw.astype(np.uint32)
    mixed = (a[:-2] * np.uint32(0x9E3779B1)) ^ (a[1:-1] * np.uint32(0x85EBCA77)) ^ (a[2:] * np.uint32(0xC2B2AE3D))
    return ((mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(22)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    t = trigrams(raw)
    hashed = np.bincount(t, minlength=HASHED) / max(len(t), 1)
    return np.concatenate([dense_features(text, raw), hashed]).astype(np.float32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """A linear score over scaled features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale = mean.astype(np.float32), scale.astype(np.float32)
        self.w, self.b = np.zeros(len(mean)), 0.0

    @classmethod
    def of(cls, *parts: np.ndarray) -> Model:
        """Scaled by the mean and spread of all rows of the parts."""
        n = sum(map(len, parts))
        mean = sum(p.sum(0, dtype=np.float64) for p in parts) / n
        return cls(mean, np.sqrt(np.maximum(sum(np.square(p, dtype=np.float64).sum(0) for p in parts) / n - mean**2, 0)) + 1e-4)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CUT, CUT)
        z[:, DENSE:] *= HASHED_SHARE
        return z

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scaled(x) @ self.w + self.b)


def _descend(model: Model, gradient, n: int, epochs: int, batch: int, rng: np.random.Generator, rate: float = 0.01, ridge: float = 1e-3) -> Model:
    """Adam over shuffled batches; gradient(indices) gives that of weights and bias."""
    m, v, step = np.zeros(len(model.w) + 1), np.zeros(len(model.w) + 1), 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            step += 1
            g = gradient(model, order[at : at + batch])
            g[:-1] += ridge * model.w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            model.w, model.b = model.w - move[:-1], model.b - move[-1]
    return model


def nn_risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, float]:
    """(risk of the positives as such, risk of the rest as negatives before it is held at 0) of scores before the sigmoid."""
    return prior * float(np.logaddexp(0, -fp).mean()), float(np.logaddexp(0, fu).mean()) - prior * float(np.logaddexp(0, fp).mean())


def nn_gradient(w: np.ndarray, b: float, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """The step's direction for weights and bias: the risk's gradient, or, where the negative part is below 0, up that part."""
    fp, fu = p @ w + b, u @ w + b
    up = -prior * sigmoid(-fp) / len(p)  # of softplus(-f), over positives as +
    down_p, down_u = sigmoid(fp) / len(p), sigmoid(fu) / len(u)  # of softplus(f), as -
    gp, gu = (up - prior * down_p, down_u) if nn_risk(fp, fu, prior)[1] >= 0 else (prior * down_p, -down_u)
    return np.append(gp @ p + gu @ u, gp.sum() + gu.sum())


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 30, batch: int = 256, seed: int = 0) -> Model:
    """The minimiser of the non-negative risk over raw features (rows of :func:`features`)."""
    model = Model.of(positive, unlabelled)
    xp, xu = model.scaled(positive), model.scaled(unlabelled)
    rng = np.random.default_rng(seed)

    def gradient(model: Model, rows: np.ndarray) -> np.ndarray:
        return nn_gradient(model.w, model.b, xp[rng.integers(0, len(xp), len(rows))], xu[rows], prior)

    return _descend(model, gradient, len(xu), epochs, batch, rng)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 0) -> float:
    """The share of positives among the unlabelled: the least ratio of upper tails of a positive-against-unlabelled score.

    One half of either set fits the score, the other gives the tails; sets of fewer than 20 rows give both whole.
    """
    halves = lambda x: (x[::2], x[1::2]) if len(x) >= 20 else (x, x)
    (p0, p1), (u0, u1) = halves(positive), halves(unlabelled)
    model = Model.of(p0, u0)
    x, y = np.concatenate([model.scaled(p0), model.scaled(u0)]), np.concatenate([np.ones(len(p0)), np.zeros(len(u0))])
    weight = np.where(y == 1, 0.5 / len(p0), 0.5 / len(u0)) * len(y)
    _descend(model, lambda m, rows: np.append(*(lambda g: (g @ x[rows], g.sum()))((sigmoid(x[rows] @ m.w + m.b) - y[rows]) * weight[rows] / len(rows))), len(x), 15, 256, np.random.default_rng(seed), ridge=1e-2)
    sp, su = np.sort(model(p1)), np.sort(model(u1))
    cuts = sp[: int(len(sp) * 0.8) + 1]
    tail_p, tail_u = 1 - np.searchsorted(sp, cuts) / len(sp), 1 - np.searchsorted(su, cuts) / len(su)
    slack = np.sqrt(0.5 / len(sp)) + np.sqrt(0.5 / len(su))
    best = np.argmin((tail_u + slack) / tail_p)
    return float(np.clip(tail_u[best] / tail_p[best], 0.02, 0.98))


def in_training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def sample_features(docs: DataFrame, labels: DataFrame, most: int = LABELLED, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features of at most ``most`` trusted positives and at most ``unlabelled`` documents of the training folds."""
    good = labels.filter(in_training(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_quality")).filter("_quality = 1")
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("_of"), F.lit("p").alias("_part"))
    some = docs.select("doc_id").filter(in_training(F.col("doc_id"))).orderBy(F.xxhash64("doc_id", F.lit("unlabelled")), "doc_id").limit(unlabelled)
    some = some.distinct().select(F.col("doc_id").alias("_of"), F.lit("u").alias("_part"))
    chosen = good.unionByName(some)  # at most so many ids
    found = docs.select("doc_id", whole_text().alias("_text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_of")).select("doc_id", "_part", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "part", "x"])

    # One text of each id, however often it repeats: rows of a fixed width, as many as were chosen (4 KB each). Sorted, so that the
    # fit does not depend on the order of tasks.
    one = found.transform(ready).mapInArrow(run, "doc_id long, part string, x binary").groupBy("doc_id", "part").agg(F.min("x").alias("x"))
    got = one.toArrow().combine_chunks().sort_by([("part", "ascending"), ("doc_id", "ascending")])
    parts = []
    for part in "pu":
        x = got.filter(pc.equal(got["part"], part))["x"]
        parts.append(np.frombuffer(b"".join(c.buffers()[2].slice(4 * (DENSE + HASHED) * c.offset, 4 * (DENSE + HASHED) * len(c)) for c in x.chunks if len(c)), np.float32).reshape(-1, DENSE + HASHED))
    return tuple(parts)


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED, unlabelled: int = UNLABELLED) -> tuple[Model | None, float | None]:
    """(model, estimated prior); neither where there are no trusted positives or no unlabelled documents."""
    positive, rest = sample_features(docs, labels, most, unlabelled)
    if not len(positive) or not len(rest):
        return None, None
    prior = estimate_prior(positive, rest)
    model = fit_nnpu(positive, rest, prior)
    del positive, rest
    release_memory()
    return model, prior


def score(docs: DataFrame, model: Model | None, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, and the columns named in ``extra``.

    Defined cases: a null text is empty; an empty text is scored like any other; a null id is held out; without a
    model every score is 0.5; repeated rows each get a row; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = [0.5 if m is None else float(m(features(t.as_py())[None])[0]) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(out, pa.float64())], ["doc_id", *extra, "score"])

    slim = docs.select("doc_id", whole_text().alias("_text"), *extra)
    fields = [f"{c} {slim.schema[c].dataType.simpleString()}" for c in ("doc_id", *extra)]
    scored = slim.transform(ready).mapInArrow(run, ", ".join([*fields, "score double"]))
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *extra)


def keep_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(shared.value(features(t.as_py())[None])[0] >= THRESHOLD) for t in batch.column(at)], pa.bool_()))

    return docs.transform(ready).mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, _ = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model)
