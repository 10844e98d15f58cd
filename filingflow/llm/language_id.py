"""Operator 2, language identification: a bidirectional gated recurrent network over bytes.

One recurrent layer reads each segment of bytes forwards, one backwards; a softmax over both states
labels every byte position, and a document's language is the one with the largest mean
probability over all its positions. The network is trained on the driver in numpy, by
backpropagation through time, from a bounded sample of labelled rows; prediction runs over whole
texts in numpy inside Spark tasks, on thousands of segments at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingflow.llm.common import crc_bucket, least_draws, others, own_names, row_draw, text_buffers

UNKNOWN = "und"


@dataclass(frozen=True)
class Training:
    """Bounds of the sample and of the training; nothing else depends on the input's size."""

    docs_per_lang: int = 500  # rows drawn for each language, by the hash of id and text
    sample: int = 32_000  # rows of all languages together: fewer of each beyond 64 languages, but one at least
    segment: int = 64  # bytes of a training segment
    hidden: int = 8  # states in each direction
    steps: int = 300  # for up to 64 languages, in proportion beyond
    batch: int = 160
    rate: float = 0.02
    seed: int = 7


class Direction:
    """Weights of one direction: ``x`` (256, 3H) inputs by byte, ``u`` (H, 3H) recurrent; gates r, z, n."""

    def __init__(self, rng: np.random.Generator, h: int):
        self.x = rng.normal(0, 0.1, (256, 3 * h))
        self.u = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h))
        self.h = h

    def forward(self, b: np.ndarray) -> tuple[np.ndarray, list]:
        """States (T, B, H) after each byte of ``b`` (T, B), and what backpropagation needs."""
        h, n = np.zeros((b.shape[1], self.h)), self.h
        out, kept = np.empty((*b.shape, n)), []
        for t in range(len(b)):
            gx, gu = self.x[b[t]], h @ self.u
            rz = 1 / (1 + np.exp(-(gx[:, : 2 * n] + gu[:, : 2 * n])))
            r, z = rz[:, :n], rz[:, n:]
            c = np.tanh(gx[:, 2 * n :] + r * gu[:, 2 * n :])
            kept.append((h, r, z, c, gu[:, 2 * n :]))
            h = out[t] = z * h + (1 - z) * c
        return out, kept

    def backward(self, b: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of ``x`` and ``u`` for the gradient (T, B, H) at the states: backpropagation through time."""
        dx, du, dh = np.zeros_like(self.x), np.zeros_like(self.u), np.zeros(grad.shape[1:])
        for t in reversed(range(len(b))):
            h, r, z, c, gn = kept[t]
            dh = dh + grad[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * gn * r * (1 - r)
            gate_x = np.concatenate([dr, dz, dc], axis=1)
            gate_u = np.concatenate([dr, dz, dc * r], axis=1)
            np.add.at(dx, b[t], gate_x)
            du += h.T @ gate_u
            dh = dh * z + gate_u @ self.u.T
        return dx, du


class Network:
    def __init__(self, langs: list[str], hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.ahead, self.back = Direction(rng, hidden), Direction(rng, hidden)
        self.v = rng.normal(0, 0.3, (2 * hidden, len(langs)))
        self.c = np.zeros(len(langs))

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.x, self.ahead.u, self.back.x, self.back.u, self.v, self.c]

    def gradients(self, b: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions of ``b`` (T, B), and its gradient for each weight array."""
        fa, ka = self.ahead.forward(b)
        fb, kb = self.back.forward(b[::-1])
        both = np.concatenate([fa, fb[::-1]], axis=2)
        logits = both @ self.v + self.c
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        t, n, k = p.shape
        loss = -np.log(p[:, np.arange(n), label] + 1e-12).mean()
        p[:, np.arange(n), label] -= 1
        p /= t * n
        at = both.reshape(t * n, -1), p.reshape(t * n, k)
        g, h = p @ self.v.T, self.ahead.h
        ga = self.ahead.backward(b, ka, g[:, :, :h])
        gb = self.back.backward(b[::-1], kb, g[::-1, :, h:])
        return float(loss), [*ga, *gb, at[0].T @ at[1], at[1].sum(axis=0)]

    def train(self, segments: np.ndarray, label: np.ndarray, how: Training) -> None:
        """Adam over random batches of segments (rows of bytes)."""
        rng = np.random.default_rng(how.seed)
        m, s = [[np.zeros_like(w) for w in self.weights()] for _ in range(2)]
        batch = max(1, min(how.batch, (1 << 23) // (how.segment * len(self.langs))))  # memory of the driver
        steps = -(-how.steps * how.batch * max(64, len(self.langs)) // (64 * batch))
        for i in range(1, steps + 1):
            pick = rng.integers(0, len(segments), batch)
            _, grads = self.gradients(segments[pick].T, label[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = how.rate * (1 - 0.9 * i / steps) * min(1.0, 1.0 / (norm + 1e-9))
            for w, g, a, b in zip(self.weights(), grads, m, s):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= rate * (a / (1 - 0.9**i)) / (np.sqrt(b / (1 - 0.99**i)) + 1e-8)


class Reader:
    """The trained network over whole texts: single precision, states as rows, segments as columns."""

    LENGTH = 128  # bytes of a segment
    WIDTH = 2048  # segments at a time, with up to 64 languages
    CELLS = 1 << 22  # documents times languages at a time

    def __init__(self, net: Network):
        h = net.ahead.h
        self.width = max(16, min(self.WIDTH, 64 * self.WIDTH // len(net.langs)))
        half = np.r_[np.full(2 * h, 0.5), np.ones(h)]  # a logistic is half a tanh of half its input
        self.parts = [
            (np.ascontiguousarray((d.x * half).T, np.float32), np.ascontiguousarray((d.u * half).T, np.float32)) for d in (net.ahead, net.back)
        ]
        self.v, self.c, self.h, self.langs = net.v.T.astype(np.float32), net.c.astype(np.float32)[:, None], h, net.langs

    def _states(self, part: int, b: np.ndarray, valid: np.ndarray | None, out: np.ndarray) -> None:
        x, u = self.parts[part]
        n, width = self.h, b.shape[1]
        h, gu, g = np.zeros((n, width), np.float32), np.empty((3 * n, width), np.float32), np.empty((3 * n, width), np.float32)
        order = range(len(b)) if part == 0 else range(len(b) - 1, -1, -1)
        rz, c, r, z = g[: 2 * n], g[2 * n :], g[:n], g[n : 2 * n]
        for t in order:
            np.take(x, b[t], axis=1, out=g, mode="clip")
            np.matmul(u, h, out=gu)
            rz += gu[: 2 * n]
            np.tanh(rz, out=rz)
            rz += 1
            rz *= 0.5
            gu[2 * n :] *= r
            c += gu[2 * n :]
            np.tanh(c, out=c)
            h -= c
            h *= z
            h += c
            if valid is not None:
                h *= valid[t]
            out[t] = h

    def segments(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For segments of ``data``: summed probabilities and counts of labelled positions, each (segments, languages)."""
        k, total = len(self.langs), len(start)
        prob, hits = np.zeros((total, k), np.float32), np.zeros((total, k), np.float32)
        by_size = np.argsort(-size, kind="stable")
        for at in range(0, total, self.width):
            rows = by_size[at : at + self.width]
            t = int(size[rows[0]])
            place = start[rows] + np.minimum(np.arange(t)[:, None], size[rows] - 1)
            b = data[place]
            valid = (np.arange(t)[:, None] < size[rows]).astype(np.float32) if size[rows[-1]] < t else None
            fa = np.empty((t, self.h, len(rows)), np.float32)
            fb = np.empty_like(fa)
            self._states(0, b, None, fa)
            self._states(1, b, valid, fb)
            p = np.matmul(self.v[:, : self.h], fa) + np.matmul(self.v[:, self.h :], fb) + self.c
            top = p.max(axis=1, keepdims=True)
            labelled = (p == top).astype(np.float32)
            p -= top
            np.exp(p, out=p)
            p /= p.sum(axis=1, keepdims=True)
            if valid is not None:
                p *= valid[:, None]
                labelled *= valid[:, None]
            prob[rows], hits[rows] = p.sum(axis=0).T, labelled.sum(axis=0).T
        return prob, hits

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: best language (index), its mean probability, the share of positions labelled with it."""
        length = np.diff(offsets)
        most = max(1, self.CELLS // len(self.langs))
        if len(length) > most:
            parts = [self.documents(data, offsets[at : at + most + 1]) for at in range(0, len(length), most)]
            return tuple(np.concatenate(p) for p in zip(*parts))
        n = -(-length // self.LENGTH)
        doc = np.repeat(np.arange(len(length)), n)
        inside = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        start = offsets[doc] + inside * self.LENGTH
        size = np.minimum(self.LENGTH, offsets[doc + 1] - start)
        prob, hits = np.zeros((len(length), len(self.langs))), np.zeros((len(length), len(self.langs)))
        for at in range(0, len(doc), 16 * self.width):
            some = slice(at, at + 16 * self.width)
            p, h = self.segments(data, start[some], size[some])
            np.add.at(prob, doc[some], p)
            np.add.at(hits, doc[some], h)
        best, all_ = prob.argmax(axis=1), np.maximum(length, 1)
        rows = np.arange(len(length))
        return best, prob[rows, best] / all_, hits[rows, best] / all_


def learn(docs: DataFrame, how: Training, usable: Column, id_col: str, text_col: str, lang_col: str) -> Network | None:
    """A network trained on at most ``how.docs_per_lang`` rows of each language among the ``usable`` ones, in equal shares
    of ``how.sample`` if there are many languages; None if no row has both a language and a letter. Every language
    with a letter is learned. Id and text only draw the rows; rows equal in both count once."""
    text, lang = F.col(text_col), F.col(lang_col).cast("string")
    labelled = docs.where(usable & lang.isNotNull() & text.rlike(r"\p{L}"))
    spot = (F.pmod(F.xxhash64("__draw"), F.greatest(F.lit(1), F.length(text) - how.segment)) + 1).cast("int")
    piece = F.substring(text, spot, F.lit(how.segment)).alias("piece")
    sample = least_draws(
        labelled, lang, row_draw(F.col(id_col), text, how.seed), lambda n: max(1, min(how.docs_per_lang, how.sample // max(1, n))), piece
    )
    sample = sorted((r["kind"], r["piece"]) for r in sample.collect())
    langs = sorted({k for k, _ in sample})
    if not langs:
        return None
    number = {k: i for i, k in enumerate(langs)}
    label = np.array([number[k] for k, _ in sample])
    rows = np.zeros((len(sample), how.segment), np.uint8)
    for i, (_, piece) in enumerate(sample):  # short pieces repeat up to the segment's length
        raw = np.frombuffer(piece.encode(), np.uint8)
        rows[i] = np.resize(raw, how.segment)
    most = int(np.bincount(label).max())
    even = np.concatenate([np.resize(np.flatnonzero(label == k), most) for k in range(len(langs))])
    net = Network(langs, how.hidden, how.seed)
    if len(langs) > 1:
        net.train(rows[even], label[even], how)
    return net


@own_names
def label_languages(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (mean probability of that language over all bytes, 0 to 1) and ``label_share``
    (share of bytes labelled with it); columns of these names are replaced.

    Texts that are null, empty or without a letter are ``und`` with score 0; so is everything if nothing
    was learned. Long texts are read whole, in segments. Equal texts get equal results.
    """
    new = ["lang_pred", "score", "label_share"]
    rest = others(docs, new)
    if net is None:
        return docs.select(*rest, F.lit(UNKNOWN).alias(new[0]), F.lit(0.0).alias(new[1]), F.lit(0.0).alias(new[2]))
    reader = Reader(net)

    @F.arrow_udf("lang_pred string, score double, label_share double")
    def label(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        names = np.array([*reader.langs, UNKNOWN], dtype=object)
        for text, lettered in batches:
            data, off = text_buffers(text)
            read = np.asarray(lettered.to_numpy(zero_copy_only=False), bool)
            best, score, share = reader.documents(data, off)
            best = np.where(read, best, len(reader.langs))
            cols = [pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1) * read), pa.array(np.clip(share, 0, 1) * read)]
            yield pa.StructArray.from_arrays(cols, names=new)

    # Only the text goes to Python, once, and three small columns come back.
    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    found = docs.select(*rest, label.asNondeterministic()(F.col(text_col), has_letter).alias("__label"))
    return found.select(*rest, *[F.col(f"__label.{c}").alias(c) for c in new])


def identify(
    docs: DataFrame, how: Training = Training(), folds: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``docs`` with ``held_out`` (crc32 of the id modulo ``folds`` is ``held``) and the columns of ``label_languages``; the
    network learns from rows that are not held out and have a language."""
    out = crc_bucket(F.col(id_col), folds) == held
    net = learn(docs, how, ~out, id_col, text_col, lang_col)
    return label_languages(docs, net, text_col).withColumn("held_out", out)
