"""Quality classifier: naive Bayes support vectors over token n-grams and token-shape n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import (
    BLANK,
    NOT_ALNUM,
    blocks,
    mix,
    prefix_sums,
    remainder,
    span_hashes,
    with_text_columns,
    words,
)
from .samples import labelled, sample_texts

#: Hash buckets, and the bound on labelled documents that are read for training.
BITS = 18
SAMPLE = 6000
PASSES = 15
PENALTY = 1.0
SMOOTHING = 1.0

NOT_SYMBOL = BLANK | ~NOT_ALNUM
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def token_grams(buf: np.ndarray, offs: np.ndarray, bits: int) -> np.ndarray:
    """Sorted distinct ``document << bits | bucket`` of the n-grams present.

    Tokens are runs of letters and digits, case kept, and runs of symbols. Single tokens and
    pairs count, and so do triples of shapes: lower, capitalised, upper, with digits, or the
    symbols themselves.
    """
    alpha, symbol = words(buf, offs, NOT_ALNUM), words(buf, offs, NOT_SYMBOL)
    start = np.concatenate([alpha[0], symbol[0]])
    end = np.concatenate([alpha[1], symbol[1]])
    doc = np.concatenate([alpha[2], symbol[2]])
    is_symbol = np.arange(len(start)) >= len(alpha[0])
    order = np.argsort(start, kind="stable")
    start, end, doc, is_symbol = start[order], end[order], doc[order], is_symbol[order]
    token = span_hashes(prefix_sums(buf), start, end)
    upper = np.concatenate([[0], np.cumsum(_UPPER[buf])])
    digit = np.concatenate([[0], np.cumsum(_DIGIT[buf])])
    n_upper = upper[end] - upper[start]
    shape = np.select(
        [digit[end] > digit[start], n_upper > 1, n_upper == 1], [3, 2, 1], 0
    ).astype(np.uint64)
    shape = np.where(is_symbol, token, shape)
    keys = []
    for stream, sizes, kind in ((token, (1, 2), 0), (shape, (1, 3), 8)):
        for size in sizes:
            n = len(stream) - size + 1
            if n <= 0:
                continue
            value = np.full(n, kind + size, np.uint64)
            for p in range(size):
                value = mix(value + stream[p : p + n])
            same = doc[:n] == doc[size - 1 :]
            bucket = (value[same] >> np.uint64(64 - bits)).astype(np.int64)
            keys.append((doc[:n][same] << bits) | bucket)
    if not keys:
        return np.zeros(0, np.int64)
    every = np.sort(np.concatenate(keys))
    return every[np.concatenate([[True], every[1:] != every[:-1]])] if len(every) else every


@dataclass(frozen=True)
class Model:
    """Weight of each bucket (log-count ratio times support-vector weight) and of the scale."""

    bits: int
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float


def fit_nbsvm(rows: list[tuple[np.ndarray, int]], bits: int) -> Model:
    """Log-count ratios, then dual coordinate descent for the L2-regularised hinge loss.

    Each text is a unit vector over its present n-grams scaled by their ratios. A logistic fit
    of the margins gives the score's scale. One class alone, or no rows, gives a constant.
    """
    size = 1 << bits
    counts = np.full((2, size), SMOOTHING)
    for at, y in rows:
        counts[y][at] += 1
    counts /= counts.sum(1, keepdims=True)
    ratio = np.log(counts[1] / counts[0])
    y01 = np.array([y for _, y in rows], float)
    if len(rows) == 0 or y01.min() == y01.max():
        constant = 0.0 if len(rows) == 0 else (4.0 if y01[0] else -4.0)
        return Model(bits, ratio.astype(np.float32), np.zeros(size, np.float32), 0.0, 0.0, constant)
    vectors = []
    for at, _ in rows:
        x = ratio[at]
        vectors.append(x / max(np.sqrt(x @ x), 1e-9))
    sign = np.where(y01 > 0, 1.0, -1.0)
    w, bias = np.zeros(size), 0.0
    dual = np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(PASSES):
        for i in order.permutation(len(rows)):
            at, x = rows[i][0], vectors[i]
            slope = sign[i] * (w[at] @ x + bias) - 1
            new = min(max(dual[i] - slope / 2.0, 0.0), PENALTY)  # squared norm: 1 + bias 1
            if new != dual[i]:
                change = (new - dual[i]) * sign[i]
                w[at] += change * x
                bias += change
                dual[i] = new
    margin = np.array([w[at] @ x for (at, _), x in zip(rows, vectors, strict=True)]) + bias
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps, slightly damped by a prior on both parameters
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = np.array([(p - y01) @ margin + 1e-2 * (a - 1), (p - y01).sum() + 1e-2 * b])
        s = p * (1 - p)
        h = np.array([[s @ margin**2 + 1e-2, s @ margin], [s @ margin, s.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        step /= max(1.0, np.abs(step).max())
        a, b = a - step[0], b - step[1]
    return Model(bits, ratio.astype(np.float32), (ratio * w).astype(np.float32), float(bias), float(a), float(b))


def fit_quality(
    docs: DataFrame, labels: DataFrame, *, limit: int = SAMPLE, bits: int = BITS
) -> Model:
    """Fit on at most ``limit`` labelled documents outside the held-out fold.

    Executors turn texts into bucket numbers; the driver gets those and fits.
    """
    sample = labelled(labels, "quality", limit=limit, divisor=3, held_out=1)

    def start():
        def columns(texts: pa.Array) -> list[pa.Array]:
            out = []
            for _, n, buf, offs in blocks(texts):
                key = token_grams(buf, offs, bits)
                cut = np.searchsorted(key >> bits, np.arange(n + 1))
                key = (key & ((1 << bits) - 1)).astype(np.int32)
                out += [key[cut[k] : cut[k + 1]].tobytes() for k in range(n)]
            return [pa.array(out, pa.binary())]

        return columns

    rows = with_text_columns(
        sample_texts(docs, sample), start, "buckets binary", keep=["id", "y"]
    ).orderBy(F.md5(F.col("id").cast("string")), "id", "y", "buckets").collect()
    return fit_nbsvm([(np.frombuffer(r["buckets"], np.int32), r["y"]) for r in rows], bits)


def quality_scores(
    docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``docs[keep]`` with ``score`` in [0, 1], higher for label 1.

    Null, empty and blank texts have a zero vector: the score of the bias. An existing
    ``score`` column is replaced. The model is two arrays of ``2**bits`` floats.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        fitted = shared.value
        mask = (1 << fitted.bits) - 1

        def columns(texts: pa.Array) -> list[pa.Array]:
            margin = np.zeros(len(texts))
            for first, n, buf, offs in blocks(texts):
                key = token_grams(buf, offs, fitted.bits)
                doc, at = key >> fitted.bits, key & mask
                norm = np.bincount(doc, fitted.ratio[at].astype(np.float64) ** 2, n)
                total = np.bincount(doc, fitted.weight[at].astype(np.float64), n)
                margin[first : first + n] = total / np.maximum(np.sqrt(norm), 1e-9)
            scaled = fitted.slope * (margin + fitted.bias) + fitted.shift
            return [pa.array(1 / (1 + np.exp(-np.clip(scaled, -35, 35))))]

        return columns

    return with_text_columns(docs, start, "score double", text=text, keep=keep)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: held-out flag, score and predicted class."""
    return quality_scores(docs, fit_quality(docs, labels), keep=["doc_id"]).select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
