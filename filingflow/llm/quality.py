"""Operator 8, quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are all it trains on: a linear score under the logistic
loss that minimises the non-negative unbiased risk

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

with an estimated class prior. The features describe the style of a text (which kinds of bytes
follow each other, words by hash, repetition, length) and are computed for whole Arrow batches in
numpy, in training and scoring alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingflow.llm.common import crc_bucket, least_draws, others, own_names, row_draw, text_buffers
from filingflow.llm.fingerprints import CHUNK, word_hashes

WORD_SLOTS = 256
KINDS = 16


def _byte_kinds() -> np.ndarray:
    """Kind of each byte: 0 lower-case vowels, 1 other lower-case letters, 2 capitals, 3 digits, 4 spaces, 5 line ends,
    then punctuation one by one or in families, 14 other ASCII, 15 bytes of longer characters."""
    kind = np.full(256, 14)
    kind[128:] = 15
    families = ["aeiouy", "bcdfghjklmnpqrstvwxz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!", "?", ":;", "'\"`", "()[]{}<>", "-/\\_|"]
    for i, chars in enumerate(families):
        kind[[ord(c) for c in chars]] = i
    return kind


_KIND = _byte_kinds()
SIZE = KINDS * KINDS + WORD_SLOTS + 5


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, SIZE) single-precision features; a text without bytes has zeros."""
    out, first = [np.zeros((0, SIZE), np.float32)], 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        off = offsets[first : last + 1]
        out.append(_features(data[off[0] : off[-1]], off - off[0]))
        first = last
    return np.concatenate(out)


def _features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    n, size = len(off) - 1, np.diff(off)
    out = np.zeros((n, SIZE), np.float32)
    if not len(data):
        return out
    kind = _KIND[data]
    doc = np.repeat(np.arange(n), size)
    pairs = (doc[:-1] * KINDS + kind[:-1]) * KINDS + kind[1:]
    counts = np.bincount(pairs[doc[:-1] == doc[1:]], minlength=n * KINDS * KINDS).reshape(n, -1)
    out[:, : KINDS * KINDS] = np.sqrt(counts / np.maximum(1, size - 1)[:, None])
    words, per = word_hashes(data, off)
    total = np.maximum(per, 1)
    slots = np.bincount(np.repeat(np.arange(n), per) * WORD_SLOTS + (words % np.uint64(WORD_SLOTS)).astype(np.int64), minlength=n * WORD_SLOTS)
    out[:, KINDS * KINDS : KINDS * KINDS + WORD_SLOTS] = np.sqrt(slots.reshape(n, -1) / total[:, None])
    cuts = np.r_[0, np.cumsum(per)]
    different = np.array([len(np.unique(words[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())])
    again = np.r_[False, words[1:] == words[:-1]]
    again[cuts[:-1][cuts[:-1] < len(words)]] = False
    out[:, -5] = np.bincount(np.repeat(np.arange(n), per), weights=again, minlength=n) / total
    out[:, -4] = np.log1p(size) / 10
    out[:, -3] = np.minimum(size / total, 50) / 10
    out[:, -2] = different / total
    out[:, -1] = np.log1p(per - different) / 10
    return out


@dataclass(frozen=True)
class Training:
    """Bounds of the samples and of the training."""

    positives: int = 3000  # trusted positive rows, about
    unlabelled: int = 6000  # rows of web text, about
    steps: int = 1500
    batch: int = 512
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 11


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class."""
        z = ((x - self.mean) * self.scale) @ self.w + self.b
        return 0.5 * (1 + np.tanh(0.5 * z.astype(np.float64)))


def _falling(z: np.ndarray) -> np.ndarray:
    """Slope of log(1 + exp(-z))."""
    return -0.5 * (1 - np.tanh(0.5 * z))


def negative_risk(p: np.ndarray, u: np.ndarray, w: np.ndarray, prior: float) -> float:
    """Unbiased estimate of the negatives' risk: unlabelled rows less the positives among them."""
    return float(np.logaddexp(0, u @ w[:-1] + w[-1]).mean() - prior * np.logaddexp(0, p @ w[:-1] + w[-1]).mean())


def risk(p: np.ndarray, u: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of the weights ``w`` (the last is the offset) and the direction to go down from: its gradient, or,
    where the negatives' part was below 0 and is taken for 0, the gradient that leads that part back up."""
    zp, zu, negative = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1], negative_risk(p, u, w, prior)
    if negative >= 0:
        at_p, at_u = prior * (_falling(zp) + _falling(-zp)) / len(p), -_falling(-zu) / len(u)
    else:
        at_p, at_u = -prior * _falling(-zp) / len(p), _falling(-zu) / len(u)
    value = prior * float(np.logaddexp(0, -zp).mean()) + max(0.0, negative)
    return value, np.r_[p.T @ at_p + u.T @ at_u, at_p.sum() + at_u.sum()]


def fit(pos: np.ndarray, unl: np.ndarray, prior: float, how: Training) -> Model:
    """The linear score of least non-negative risk (Adam over random batches of both samples)."""
    everything = np.concatenate([pos, unl])
    mean, spread = everything.mean(axis=0), everything.std(axis=0)
    scale = np.where(spread > 1e-6, 1 / np.maximum(spread, 1e-6), 0).astype(np.float32)
    pos, unl = np.clip((pos - mean) * scale, -8, 8), np.clip((unl - mean) * scale, -8, 8)
    rng = np.random.default_rng(how.seed)
    w, m, s = np.zeros(SIZE + 1), np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    for i in range(1, how.steps + 1):
        p, u = pos[rng.integers(0, len(pos), how.batch)], unl[rng.integers(0, len(unl), how.batch)]
        _, g = risk(p, u, w, prior)
        g[:-1] += how.decay * w[:-1]
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        w -= how.rate * (1 - 0.9 * i / how.steps) * (m / (1 - 0.9**i)) / (np.sqrt(s / (1 - 0.99**i)) + 1e-8)
    return Model(mean, scale, w[:-1].astype(np.float32), float(w[-1]), prior)


def _collect(docs: DataFrame, text_col: str) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(*text_buffers(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], names=["x"])

    got = sorted(bytes(r[0]) for r in docs.select(F.col(text_col)).mapInArrow(run, "x binary").collect())
    return np.frombuffer(b"".join(got), np.float32).reshape(-1, SIZE)


def estimate_prior(pos: np.ndarray, unl: np.ndarray, how: Training) -> float:
    """Share of positives among unlabelled rows, from the scores of held-back positives.

    A score is fitted on one half of both samples. In the other half, the share of unlabelled rows above a threshold is at
    least the prior times that of positives; over the thresholds that most positives pass, the least quotient of the
    two is the estimate, kept in 0.02 to 0.98.
    """
    rng = np.random.default_rng(how.seed + 2)
    pos, unl = pos[rng.permutation(len(pos))], unl[rng.permutation(len(unl))]
    half_p, half_u = -(-len(pos) // 2), -(-len(unl) // 2)
    model = fit(pos[:half_p], unl[:half_u], 0.5, how)
    back, among = np.sort(model.score(pos[half_p:])), np.sort(model.score(unl[half_u:]))
    if not len(back) or not len(among):
        return 0.5
    at = np.quantile(back, np.linspace(0.05, 0.5, 10))
    passed = 1 - np.searchsorted(back, at, "left") / len(back)
    share = 1 - np.searchsorted(among, at, "left") / len(among)
    return float(np.clip((share / passed).min(), 0.02, 0.98))


def learn(docs: DataFrame, labels: DataFrame, how: Training, folds: int, held: int, id_col: str, text_col: str, label_col: str) -> Model | None:
    """The model, from rows that are not held out; None without a trusted positive.

    Positives are the rows of at most ``how.positives`` ids with a label of 1, unlabelled rows come from all
    documents; both are the least draws by id and text, at most ``how.positives`` and ``how.unlabelled`` different
    rows, whatever an id's rows. The class prior is estimated from the two samples. Labels of 0 serve for nothing.
    """
    known = labels.where(crc_bucket(F.col(id_col), folds) != held).where(F.col(label_col) == 1)
    ids = known.select(F.col(id_col).alias("__id")).where(F.col("__id").isNotNull()).distinct()
    ids = ids.orderBy(F.xxhash64("__id", F.lit(how.seed))).limit(how.positives)
    open_ = docs.where(crc_bucket(F.col(id_col), folds) != held)

    def sample(rows: DataFrame, seed: int, most: int) -> np.ndarray:
        drawn = least_draws(rows, F.lit("row"), row_draw(F.col(id_col), F.col(text_col), seed), lambda n: most, F.col(text_col).alias("__text"))
        return _collect(drawn, "__text")

    pos = sample(open_.join(F.broadcast(ids), F.col(id_col) == F.col("__id"), "left_semi"), how.seed, how.positives)
    unl = sample(open_, how.seed + 1, how.unlabelled) if len(pos) else pos
    if not len(pos) or not len(unl):
        return None
    return fit(pos, unl, estimate_prior(pos, unl, how), how)


@own_names
def score_quality(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1; 0.5 where there is no model); a column of this name is replaced. Null and empty
    texts are scored as texts without bytes. Long texts are read whole. Equal texts get equal scores."""
    rest = others(docs, ["score"])
    if model is None:
        return docs.select(*rest, F.lit(0.5).alias("score"))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:  # only the text goes to Python, once
            yield pa.array(model.score(features(*text_buffers(text))))

    return docs.select(*rest, score.asNondeterministic()(F.col(text_col)).alias("score"))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    how: Training = Training(),
    folds: int = 3,
    held: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """``docs`` with ``held_out`` (crc32 of the id modulo ``folds`` is ``held``), ``score`` and ``predicted`` (1 from 0.5 on)."""
    model = learn(docs, labels, how, folds, held, id_col, text_col, label_col)
    scored = score_quality(docs, model, text_col)
    return scored.withColumns({"held_out": crc_bucket(F.col(id_col), folds) == held, "predicted": (F.col("score") >= 0.5).cast("int")})
