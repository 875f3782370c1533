"""Personal data: fixed patterns plus a character BiLSTM with CRF transitions.

The patterns give the base spans. They also label the training windows of the network, which
then finds spans of the same kinds that the patterns miss (a card number with a typing error, a
phone number without a plus). All four kinds need a digit or an ``@``, so only windows that hold
one are decoded; every such window of a text is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, id_text, with_text_columns

# fixed values: kinds in their order of listing, and the shapes of their base spans
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins; saying so keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Bound on the documents read for training; windows and shape of the network and training.
SAMPLE = 600
WINDOW, STRIDE = 64, 32
HIDDEN, STEPS, BATCH, RATE = 16, 240, 48, 0.03
#: A learned span counts from this length and mean posterior on.
LEAST_CHARS, LEAST_SURE = 7, 0.9

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Every ``@`` with a run of local characters before it and a domain behind, left to right."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL.fullmatch(text[start - 1]):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((0, start, found.end()))
            last = found.end()
        at = text.find("@", max(at + 1, last))
    return out


def _ascii_digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by kind and start."""
    out = _emails(text)
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = _ascii_digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(_ascii_digits(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


# Tags: 0 outside; 1 + 2 * kind begins a span, 2 + 2 * kind continues it.
TAGS = 1 + 2 * len(KINDS)
CHARS = 130


def coded(text: str) -> np.ndarray:
    """Characters as small numbers: ASCII as is, 128 for the rest; 129 pads."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(points, 128).astype(np.uint8)


def window_starts(codes: np.ndarray) -> np.ndarray:
    """Starts of the overlapping windows that hold a digit or an ``@``, on one grid per text."""
    marked = np.flatnonzero(((codes >= 48) & (codes <= 57)) | (codes == 64))
    cell = np.unique(marked // STRIDE)
    grid = np.unique(np.concatenate([cell, np.maximum(cell - 1, 0)]))
    return grid * STRIDE


def cut_windows(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.concatenate([codes, np.full(WINDOW, 129, np.uint8)])
    return padded[starts[:, None] + np.arange(WINDOW)]


def tags_of(n: int, spans: list[Span]) -> np.ndarray:
    """Tags of a text's characters; an earlier kind keeps what a later one overlaps."""
    out = np.zeros(n, np.int64)
    for kind, a, b in spans:
        if not out[a:b].any():
            out[a] = 1 + 2 * kind
            out[a + 1 : b] = 2 + 2 * kind
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lstm(x: np.ndarray, table: np.ndarray, cycle: np.ndarray):
    """States (position, window, unit) of one direction, with what its gradient needs."""
    h = cycle.shape[0]
    state = np.zeros((len(x), h), np.float32)
    cell = np.zeros_like(state)
    states, kept = [], []
    for t in range(x.shape[1]):
        u = table[x[:, t]] + state @ cycle
        gate = _sigmoid(u[:, : 3 * h])
        i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
        new = np.tanh(u[:, 3 * h :])
        before, cell = cell, f * cell + i * new
        lit = np.tanh(cell)
        kept.append((state, before, i, f, o, new, lit))
        state = o * lit
        states.append(state)
    return np.stack(states), kept


def _lstm_gradient(x, table, cycle, kept, grad):
    d_table, d_cycle = np.zeros_like(table), np.zeros_like(cycle)
    d_state, d_cell = np.zeros_like(grad[0]), np.zeros_like(grad[0])
    for t in range(x.shape[1] - 1, -1, -1):
        state, before, i, f, o, new, lit = kept[t]
        g = grad[t] + d_state
        d_cell = d_cell + g * o * (1 - lit * lit)
        d_u = np.concatenate(
            [
                d_cell * new * i * (1 - i),
                d_cell * before * f * (1 - f),
                g * lit * o * (1 - o),
                d_cell * i * (1 - new * new),
            ],
            1,
        )
        np.add.at(d_table, x[:, t], d_u)
        d_cycle += state.T @ d_u
        d_state = d_u @ cycle.T
        d_cell = d_cell * f
    return d_table, d_cycle


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _passes(scores: np.ndarray, move: np.ndarray):
    """Forward and backward log sums of the linear chain: (position, window, tag)."""
    ahead, back = np.empty_like(scores), np.zeros_like(scores)
    ahead[0] = scores[0]
    for t in range(1, len(scores)):
        ahead[t] = scores[t] + _log_sum(ahead[t - 1][:, :, None] + move, 1)
    for t in range(len(scores) - 2, -1, -1):
        back[t] = _log_sum(move + (scores[t + 1] + back[t + 1])[:, None, :], 2)
    return ahead, back, _log_sum(ahead[-1], 1)


@dataclass
class Tagger:
    """Weights of both directions, the output layer and the transitions."""

    params: list[np.ndarray]

    def scores(self, x: np.ndarray):
        t_a, c_a, t_b, c_b, out, bias, _ = self.params
        ahead, kept_a = _lstm(x, t_a, c_a)
        back, kept_b = _lstm(x[:, ::-1], t_b, c_b)
        both = np.concatenate([ahead, back[::-1]], 2)
        return both @ out + bias, both, kept_a, kept_b

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean negative log likelihood of the tag sequences ``y`` (window, position)."""
        t_a, c_a, t_b, c_b, out, bias, move = self.params
        scores, both, kept_a, kept_b = self.scores(x)
        ahead, back, total = _passes(scores, move)
        n, h = len(x), c_a.shape[0]
        d = np.exp(ahead + back - total[None, :, None])
        d_move = np.zeros_like(move)
        for t in range(1, len(scores)):
            pair = ahead[t - 1][:, :, None] + move + (scores[t] + back[t])[:, None, :]
            d_move += np.exp(pair - total[:, None, None]).sum(0)
        np.add.at(d_move, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        rows = np.arange(n)
        for t in range(len(scores)):
            d[t, rows, y[:, t]] -= 1
        d, d_move = (d / n).astype(np.float32), (d_move / n).astype(np.float32)
        d_both = d @ out.T
        return [
            *_lstm_gradient(x, t_a, c_a, kept_a, d_both[:, :, :h]),
            *_lstm_gradient(x[:, ::-1], t_b, c_b, kept_b, d_both[::-1, :, h:]),
            both.reshape(-1, 2 * h).T @ d.reshape(-1, TAGS),
            d.sum((0, 1)),
            d_move,
        ]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag sequences (window, position) and the posteriors of their tags."""
        move = self.params[6]
        scores = self.scores(x)[0]
        best, came = scores[0], []
        for t in range(1, len(scores)):
            reach = best[:, :, None] + move
            came.append(reach.argmax(1))
            best = scores[t] + reach.max(1)
        rows = np.arange(len(x))
        tags = np.empty((len(x), len(scores)), np.int64)
        tags[:, -1] = best.argmax(1)
        for t in range(len(scores) - 2, -1, -1):
            tags[:, t] = came[t][rows, tags[:, t + 1]]
        ahead, back, total = _passes(scores, move)
        posterior = np.exp(ahead + back - total[None, :, None])
        return tags, posterior[np.arange(len(scores))[None, :], rows[:, None], tags]


def fit_tagger(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Tagger | None:
    """Adam on batches of windows; none without windows."""
    if not len(x):
        return None
    rng = np.random.default_rng(seed)
    h = HIDDEN
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    tagger = Tagger(
        [draw(CHARS, 4 * h), draw(h, 4 * h), draw(CHARS, 4 * h), draw(h, 4 * h), draw(2 * h, TAGS),
         np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32)]
    )
    for table in (tagger.params[0], tagger.params[2]):
        table[:, h : 2 * h] += 1  # open forget gates at the start
    first = [np.zeros_like(p) for p in tagger.params]
    second = [np.zeros_like(p) for p in tagger.params]
    for step in range(1, STEPS + 1):
        rows = rng.choice(len(x), min(BATCH, len(x)), replace=False)
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / STEPS))
        for k, g in enumerate(tagger.gradients(x[rows], y[rows])):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            tagger.params[k] -= rate * (first[k] / (1 - 0.9**step)) / (
                np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
            )
    return tagger


def reconciled(tagger: Tagger, codes: np.ndarray, starts: np.ndarray) -> list[Span]:
    """Spans of a text from all its windows: each position follows the window whose middle is
    nearest, and runs of tags that cross window borders are one span."""
    tags = np.zeros(len(codes), np.int64)
    sure = np.zeros(len(codes))
    nearest = np.full(len(codes), WINDOW)
    place = np.abs(np.arange(WINDOW) - WINDOW // 2)
    for part in np.array_split(starts, -(-len(starts) // 256)):
        found, posterior = tagger.decode(cut_windows(codes, part))
        for start, row, p in zip(part.tolist(), found, posterior, strict=True):
            end = min(start + WINDOW, len(codes))
            closer = place[: end - start] < nearest[start:end]
            at = np.flatnonzero(closer) + start
            tags[at], sure[at] = row[at - start], p[at - start]
            nearest[at] = place[at - start]
    spans, k = [], 0
    marked = np.flatnonzero(tags).tolist()
    while k < len(marked):
        a = b = marked[k]
        kind = (tags[a] - 1) // 2
        while k < len(marked) and marked[k] == b and (
            b == a or tags[b] == 2 + 2 * kind
        ):
            b += 1
            k += 1
        if b - a >= LEAST_CHARS and sure[a:b].mean() >= LEAST_SURE:
            spans.append((int(kind), a, b))
    return spans


def all_spans(text: str, tagger: Tagger | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): learned spans are added where no base span of any kind lies."""
    base = base_spans(text)
    if tagger is None:
        return base, base
    codes = coded(text)
    starts = window_starts(codes)
    if not len(starts):
        return base, base
    extra = [
        s for s in reconciled(tagger, codes, starts)
        if all(s[2] <= a or b <= s[1] for _, a, b in base)
    ]
    return base, sorted([*base, *extra])


def fit_pii(docs: DataFrame, *, limit: int = SAMPLE) -> Tagger | None:
    """Train on windows of at most ``limit`` documents that hold a digit or an ``@``.

    The first by digest of id; the base spans are their labels. Ids are chosen before texts are
    read, so no task gathers texts from every partition; rows that share an id count once, with
    their least text. Windows of at most 200 per document come back to the driver as small arrays.
    """
    holding = docs.where(F.col("text").rlike("[0-9@]")).withColumn("key", F.md5(id_text()))
    chosen = holding.select("key").orderBy("key").limit(limit).distinct()
    sample = (
        holding.select("key", "text")
        .join(F.broadcast(chosen), "key", "left_semi")
        .groupBy("key")
        .agg(F.min("text").alias("text"))
    )

    def start():
        def columns(texts: pa.Array) -> list[pa.Array]:
            xs, ys = [], []
            for value in texts:
                text = value.as_py() or ""
                codes = coded(text)
                starts = window_starts(codes)[:200]
                tags = np.concatenate([tags_of(len(codes), base_spans(text)), np.zeros(WINDOW, np.int64)])
                xs.append(cut_windows(codes, starts).tobytes())
                ys.append(tags[starts[:, None] + np.arange(WINDOW)].astype(np.uint8).tobytes())
            return [pa.array(xs, pa.binary()), pa.array(ys, pa.binary())]

        return columns

    rows = with_text_columns(sample, start, "x binary, y binary", keep=["key"]).orderBy("key", "x").collect()
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.uint8).reshape(-1, WINDOW)
    y = np.frombuffer(b"".join(r["y"] for r in rows), np.uint8).reshape(-1, WINDOW).astype(np.int64)
    return fit_tagger(x, y)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_data(
    docs: DataFrame, tagger: Tagger | None, *, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``docs[keep]`` with the base counts by kind, ``base_spans`` and ``spans`` as text.

    Offsets are code points, ends exclusive. Null and empty texts have none; same-named columns
    are replaced. Without a tagger (no training window) the base spans are all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    marked = np.zeros(256, bool)
    marked[48:58] = marked[64] = True

    def start():
        tagger = shared.value

        def columns(texts: pa.Array) -> list[pa.Array]:
            counts = np.zeros((len(KINDS), len(texts)), np.int64)
            base_out, all_out = [""] * len(texts), [""] * len(texts)
            for first, _, buf, offs in blocks(texts):
                hits = np.concatenate([[0], np.cumsum(marked[buf])])
                for d in np.flatnonzero(hits[offs[1:]] > hits[offs[:-1]]).tolist():
                    base, spans = all_spans(texts[first + d].as_py(), tagger)
                    for kind, _, _ in base:
                        counts[kind, first + d] += 1
                    base_out[first + d], all_out[first + d] = listed(base), listed(spans)
            return [*map(pa.array, counts), pa.array(base_out), pa.array(all_out)]

        return columns

    fields = ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_spans string, spans string"
    return with_text_columns(docs, start, fields, text=text, keep=keep)


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, digest of the base spans, all spans."""
    return personal_data(docs, fit_pii(docs), keep=["doc_id"]).select(
        "doc_id",
        *[f"n_{k}" for k in KINDS],
        F.sha2("base_spans", 256).alias("base_sha256"),
        "spans",
    )
