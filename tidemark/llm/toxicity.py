"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import (
    LOWER,
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
SAMPLE = 12_000
REJECT_AT = 0.7
#: (offsets of the words joined, kind): words, pairs, triples, pairs with one or two words skipped.
GRAMS = (((0,), 1), ((0, 1), 2), ((0, 1, 2), 3), ((0, 2), 4), ((0, 3), 5))


def gram_indices(buf: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram and skip-gram, repeats included."""
    low = LOWER[buf]
    start, end, doc = words(low, offs, NOT_ALNUM)
    word = span_hashes(prefix_sums(low), start, end)
    docs, index = [], []
    for places, kind in GRAMS:
        n = len(word) - places[-1]
        if n <= 0:
            continue
        same = doc[:n] == doc[places[-1] :]
        value = np.full(n, kind, np.uint64)
        for p in places:
            value = mix(value + word[p : p + n])
        docs.append(doc[:n][same])
        index.append((value[same] >> np.uint64(64 - bits)).astype(np.int32))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(docs), np.concatenate(index)


def distinct_indices(buf: np.ndarray, offs: np.ndarray, bits: int) -> list[np.ndarray]:
    doc, index = gram_indices(buf, offs, bits)
    key = np.unique((doc << bits) | index)
    cut = np.searchsorted(key >> bits, np.arange(len(offs)))
    key = (key & ((1 << bits) - 1)).astype(np.int32)
    return [key[cut[k] : cut[k + 1]] for k in range(len(offs) - 1)]


@dataclass(frozen=True)
class Ftrl:
    """Learning rates and penalties; ``passes`` over the sample in digest order."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    passes: int = 2


@dataclass(frozen=True)
class Weights:
    """Non-zero weights of a fitted model; at most ``2**bits`` of them, so small to broadcast."""

    bits: int
    bias: float
    index: np.ndarray
    value: np.ndarray


def fit_ftrl(rows: list[tuple[np.ndarray, int]], bits: int, rules: Ftrl) -> Weights:
    """Per-coordinate FTRL-proximal on indicator features, with an unpenalised bias."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        out = -(zi - np.sign(zi) * rules.l1) / ((rules.beta + np.sqrt(n[at])) / rules.alpha + rules.l2)
        return np.where(np.abs(zi) <= rules.l1, 0.0, out)

    for _ in range(rules.passes):
        for at, y in rows:
            w = weights(at)
            bias = -bias_z * rules.alpha / (rules.beta + bias_n**0.5)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / rules.alpha
            z[at] += g - step * w
            n[at] += g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / rules.alpha * bias
            bias_n += g * g
    every = weights(np.arange(1 << bits))
    index = np.flatnonzero(every)
    bias = -bias_z * rules.alpha / (rules.beta + bias_n**0.5)
    return Weights(bits, float(bias), index.astype(np.int32), every[index].astype(np.float32))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    limit: int = SAMPLE,
    bits: int = BITS,
    rules: Ftrl = Ftrl(),
    doc_id: str = "doc_id",
    text: str = "text",
) -> Weights:
    """Fit on at most ``limit`` labelled documents outside the held-out fold.

    Texts are turned into bucket numbers on the executors, and one task fits the bounded sample;
    the driver gets the weights alone.
    The sample comes in digest order, so the model depends neither on row order nor on
    partitions. Without labelled documents every score is one half.
    """
    sample = labelled(labels, "toxic", limit=limit, divisor=3, held_out=1, doc_id="doc_id")

    def start():
        def columns(texts: pa.Array) -> list[pa.Array]:
            out = []
            for _, _, buf, offs in blocks(texts):
                out += [x.tobytes() for x in distinct_indices(buf, offs, bits)]
            return [pa.array(out, pa.binary())]

        return columns

    chosen = sample_texts(docs, sample, doc_id, text)
    rows = with_text_columns(chosen, start, "buckets binary", keep=["id", "y"]).withColumn(
        "key", F.md5(F.col("id").cast("string"))
    )

    def fit(batches):
        held = [r for b in batches for r in zip(*(b.column(c) for c in ("key", "id", "y", "buckets")), strict=True)]
        held.sort(key=lambda r: (r[0].as_py() or "", r[2].as_py(), r[3].as_py()))
        data = [(np.frombuffer(r[3].as_buffer(), np.int32), r[2].as_py()) for r in held]
        fitted = fit_ftrl(data, bits, rules)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([fitted.bias]),
                pa.array([fitted.index.tobytes()], pa.binary()),
                pa.array([fitted.value.tobytes()], pa.binary()),
            ],
            names=["bias", "index", "value"],
        )

    fitted = rows.repartition(1).mapInArrow(fit, "bias double, index binary, value binary").first()
    if fitted is None:  # no labelled document
        return fit_ftrl([], bits, rules)
    return Weights(
        bits,
        fitted["bias"],
        np.frombuffer(fitted["index"], np.int32),
        np.frombuffer(fitted["value"], np.float32),
    )


def toxicity_scores(
    docs: DataFrame,
    model: Weights,
    *,
    text: str = "text",
    keep: list[str] | None = None,
    name: str = "score",
) -> DataFrame:
    """``docs[keep]`` with a score in [0, 1]; null, empty and wordless texts get the bias alone.

    An existing column of the score's name is replaced. Long texts are scored whole: every feature counts
    once however often it occurs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        fitted = shared.value
        dense = np.zeros(1 << fitted.bits, np.float32)
        dense[fitted.index] = fitted.value

        def columns(texts: pa.Array) -> list[pa.Array]:
            margin = np.full(len(texts), fitted.bias)
            for first, n, buf, offs in blocks(texts):
                doc, index = gram_indices(buf, offs, fitted.bits)
                used = np.flatnonzero(dense[index])
                key = np.unique((doc[used] << fitted.bits) | index[used])
                weight = dense[key & ((1 << fitted.bits) - 1)].astype(np.float64)
                margin[first : first + n] += np.bincount(key >> fitted.bits, weight, n)
            return [pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35))))]

        return columns

    return with_text_columns(docs, start, f"{name} double", text=text, keep=keep)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: held-out flag, score and verdict."""
    model = fit_toxicity(docs, labels)
    return toxicity_scores(docs, model, keep=["doc_id"]).select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= REJECT_AT).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents whose score reaches the limit, columns unchanged.

    A score at the limit goes. Null, empty and wordless texts have the score of the bias; equal
    texts have equal scores, so repeated rows stay or go together; null ids are scored like any
    other. An empty table gives an empty result; without labels every document stays.
    """
    scored = toxicity_scores(docs, fit_toxicity(docs, labels), name="_toxicity")
    return scored.where(F.col("_toxicity") < REJECT_AT).select(*docs.columns)
