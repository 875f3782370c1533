"""Language identification: a bidirectional gated recurrent network over bytes.

Sequences are words (runs of letters, cut after ``LONGEST`` bytes), so that every byte position
gets language probabilities from both sides of its word. A batch of texts runs each of its
distinct words once and pools the probabilities of all positions of a document.
"""

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
    id_text,
    prefix_sums,
    remainder,
    span_hashes,
    with_text_columns,
    words,
)

#: Bound on the documents read for training, and the shape of network and training.
SAMPLE = 600
HIDDEN, LONGEST, STEPS, BATCH, RATE = 12, 24, 500, 256, 0.01
UNDETERMINED = "und"

NOT_LETTER = NOT_ALNUM.copy()
NOT_LETTER[48:58] = True


def pieces(buf: np.ndarray, offs: np.ndarray):
    """(start, end, document) of words, long ones cut into runs of ``LONGEST`` bytes."""
    start, end, doc = words(buf, offs, NOT_LETTER)
    n = -(-(end - start) // LONGEST)
    word = np.repeat(np.arange(len(start)), n)
    k = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    first = start[word] + k * LONGEST
    return first, np.minimum(first + LONGEST, end[word]), doc[word]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Gru:
    """One direction. The byte table holds the products of byte embedding and input weights."""

    def __init__(self, table: np.ndarray, cycle: np.ndarray) -> None:
        self.table, self.cycle = table, cycle

    def forward(self, x: np.ndarray):
        """States (position, sequence, unit) for equally long byte sequences, and what the
        backward pass needs."""
        h = self.cycle.shape[0]
        state = np.zeros((len(x), h), np.float32)
        states, kept = [], []
        for t in range(x.shape[1]):
            u = self.table[x[:, t]]
            v = state @ self.cycle
            gate = _sigmoid(u[:, : 2 * h] + v[:, : 2 * h])
            r, z = gate[:, :h], gate[:, h:]
            new = np.tanh(u[:, 2 * h :] + r * v[:, 2 * h :])
            kept.append((state, r, z, new, v[:, 2 * h :]))
            state = new + z * (state - new)
            states.append(state)
        return np.stack(states), kept

    def backward(self, x: np.ndarray, kept, grad: np.ndarray):
        """Gradients of byte table and cycle weights from those of the states."""
        h = self.cycle.shape[0]
        d_table, d_cycle = np.zeros_like(self.table), np.zeros_like(self.cycle)
        carry = np.zeros_like(grad[0])
        for t in range(x.shape[1] - 1, -1, -1):
            state, r, z, new, v_new = kept[t]
            g = grad[t] + carry
            d_new = g * (1 - z) * (1 - new * new)
            d_z = g * (state - new) * z * (1 - z)
            d_r = d_new * v_new * r * (1 - r)
            d_u = np.concatenate([d_r, d_z, d_new], 1)
            d_v = np.concatenate([d_r, d_z, d_new * r], 1)
            np.add.at(d_table, x[:, t], d_u)
            d_cycle += state.T @ d_v
            carry = g * z + d_v @ self.cycle.T
        return d_table, d_cycle


@dataclass
class Network:
    """Two directions and the output layer; a few thousand floats."""

    languages: list[str]
    ahead: Gru
    back: Gru
    out: np.ndarray
    bias: np.ndarray

    def logits(self, x: np.ndarray):
        ahead, kept_a = self.ahead.forward(x)
        back, kept_b = self.back.forward(x[:, ::-1])
        both = np.concatenate([ahead, back[::-1]], 2)
        return both @ self.out + self.bias, both, kept_a, kept_b

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Summed over the positions of each sequence: (sequence, language)."""
        logits = self.logits(x)[0]
        p = np.exp(logits - logits.max(2, keepdims=True))
        return (p / p.sum(2, keepdims=True)).sum(0)


def fit_network(
    sequences: list[np.ndarray], labels: np.ndarray, languages: list[str], seed: int = 5
) -> Network:
    """Backpropagation through time with Adam on batches of equally long words."""
    rng = np.random.default_rng(seed)
    h, c = HIDDEN, max(len(languages), 1)
    gru = lambda: Gru(
        rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32),
        rng.normal(0, h**-0.5, (h, 3 * h)).astype(np.float32),
    )
    net = Network(
        languages, gru(), gru(), rng.normal(0, 0.3, (2 * h, c)).astype(np.float32), np.zeros(c, np.float32)
    )
    if not len(labels):
        return net
    lengths = np.array([len(s) for s in sequences])
    by_length = [np.flatnonzero(lengths == n) for n in np.unique(lengths)]
    share = np.array([len(g) * lengths[g[0]] for g in by_length], float)
    share /= share.sum()
    params = [net.ahead.table, net.ahead.cycle, net.back.table, net.back.cycle, net.out, net.bias]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        group = by_length[rng.choice(len(by_length), p=share)]
        rows = rng.choice(group, min(BATCH, len(group)), replace=False)
        x, y = np.stack([sequences[i] for i in rows]), labels[rows]
        logits, both, kept_a, kept_b = net.logits(x)
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(len(y)), y] -= 1
        p /= p.shape[0] * p.shape[1]
        d_both = p @ net.out.T
        flat = both.reshape(-1, 2 * h), p.reshape(-1, c)
        grads = [
            *net.ahead.backward(x, kept_a, d_both[:, :, :h]),
            *net.back.backward(x[:, ::-1], kept_b, d_both[::-1, :, h:]),
            flat[0].T @ flat[1],
            flat[1].sum(0),
        ]
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / STEPS))
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] -= rate * (first[k] / (1 - 0.9**step)) / (
                np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
            )
    return net


def fit_languages(docs: DataFrame, *, limit: int = SAMPLE) -> Network:
    """Fit on at most ``limit`` documents outside the held-out fold: the first by digest of id.

    The executors cut their words; the driver gets distinct words by language and trains.
    """
    sample = (
        docs.where(F.col("lang").isNotNull() & (remainder("doc_id", 5) != 0))
        .select("doc_id", F.col("lang").cast("string").alias("lang"), F.md5(id_text()).alias("key"))
        .orderBy("key", "doc_id", "lang")
        .limit(limit)
    )
    chosen = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("l"), "text").join(
        F.broadcast(sample.distinct()),
        F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("l") == F.col("lang")),
    )

    def start():
        def columns(texts: pa.Array) -> list[pa.Array]:
            out = []
            for _, n, buf, offs in blocks(texts):
                low = LOWER[buf]
                begin, end, doc = pieces(low, offs)
                body = low.tobytes()
                found = [[] for _ in range(n)]
                for s, e, d in zip(begin.tolist(), end.tolist(), doc.tolist(), strict=True):
                    found[d].append(body[s:e])
                out += found
            return [pa.array(out, pa.list_(pa.binary()))]

        return columns

    cut = with_text_columns(chosen.select("lang", "text"), start, "words array<binary>", keep=["lang"])
    counted = (
        cut.select("lang", F.explode("words").alias("word"))
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
        .orderBy("lang", "word")
        .collect()
    )
    languages = sorted({r["lang"] for r in counted})
    code = {name: k for k, name in enumerate(languages)}
    sequences, labels = [], []
    for r in counted:
        for _ in range(int(np.ceil(np.sqrt(r["n"])))):  # common words count more, not all that more
            sequences.append(np.frombuffer(r["word"], np.uint8))
            labels.append(code[r["lang"]])
    return fit_network(sequences, np.array(labels, np.int64), languages)


def language_predictions(
    docs: DataFrame, net: Network, *, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``docs[keep]`` with ``lang_pred`` and its pooled probability ``score``.

    Texts that are null or hold no letter are ``und`` with score 0, and so is every text when
    no language was learned. Same-named columns are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def start():
        net = shared.value

        def columns(texts: pa.Array) -> list[pa.Array]:
            names, scores = [], []
            for first, n, buf, offs in blocks(texts, 4 << 20):
                low = LOWER[buf]
                begin, end, doc = pieces(low, offs)
                total = np.zeros((n, max(len(net.languages), 1)))
                if len(begin) and net.languages:
                    value = span_hashes(prefix_sums(low), begin, end)
                    _, at, which = np.unique(value, return_index=True, return_inverse=True)
                    size = end[at] - begin[at]
                    each = np.zeros((len(at), len(net.languages)))
                    for length in np.unique(size):
                        same = np.flatnonzero(size == length)
                        for part in np.array_split(same, -(-len(same) // 4096)):
                            x = low[begin[at[part]][:, None] + np.arange(length)]
                            each[part] = net.probabilities(x)
                    for k in range(len(net.languages)):
                        total[:, k] = np.bincount(doc, each[which, k], n)
                positions = np.maximum(np.bincount(doc, end - begin, n), 1)
                best = total.argmax(1)
                score = np.clip(total[np.arange(n), best] / positions, 0, 1)
                ascii_letter = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
                lettered = ascii_letter[offs[1:]] > ascii_letter[offs[:-1]]
                for d in range(n):
                    known = bool(net.languages) and (
                        lettered[d] or any(map(str.isalpha, texts[first + d].as_py() or ""))
                    )
                    names.append(net.languages[best[d]] if known else UNDETERMINED)
                    scores.append(float(score[d]) if known else 0.0)
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return columns

    return with_text_columns(docs, start, "lang_pred string, score double", text=text, keep=keep)


def language_digest(docs: DataFrame) -> DataFrame:
    """One row per document: held-out flag, predicted language and score."""
    found = language_predictions(docs, fit_languages(docs), keep=["doc_id"])
    return found.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score"
    )
