"""Training steps, gradients and placement against plain recomputations."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import langid, nbsvm, pii, samples, sharding, toxicity


def test_ftrl_equals_a_plain_loop():
    rng = random.Random(2)
    rows = [(np.array(sorted(rng.sample(range(32), rng.randint(0, 6))), np.int32), rng.randint(0, 1)) for _ in range(80)]
    rules = toxicity.Ftrl(alpha=0.7, beta=1.0, l1=0.4, l2=0.3, passes=3)
    z, n = [0.0] * 33, [0.0] * 33  # the last is the bias, without penalties

    def weight(i):
        l1, l2 = (0.0, 0.0) if i == 32 else (rules.l1, rules.l2)
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((rules.beta + math.sqrt(n[i])) / rules.alpha + l2)

    for _ in range(rules.passes):
        for at, y in rows:
            own = [*at.tolist(), 32]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in own:
                step = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / rules.alpha
                z[i] += g - step * w[i]
                n[i] += g * g
    fitted = toxicity.fit_ftrl(rows, 5, rules)
    plain = {i: weight(i) for i in range(32) if weight(i)}
    assert dict(zip(fitted.index.tolist(), fitted.value.tolist(), strict=True)) == pytest.approx(plain, rel=1e-5)
    assert fitted.bias == pytest.approx(weight(32), rel=1e-9) and 0 < len(plain) < 32


def test_dual_descent_reaches_the_primal_optimum():
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(120):
        y = int(rng.random() < 0.5)
        p = np.where(np.arange(16) < 8, 0.5 if y else 0.2, 0.2 if y else 0.5)
        rows.append((np.flatnonzero(rng.random(16) < p).astype(np.int32), y))
    model = nbsvm.fit_nbsvm(rows, 4)
    counts = np.full((2, 16), nbsvm.SMOOTHING)
    for at, y in rows:
        counts[y][at] += 1
    counts /= counts.sum(1, keepdims=True)
    ratio = np.log(counts[1] / counts[0])
    assert model.ratio == pytest.approx(ratio, rel=1e-5)
    x = np.zeros((len(rows), 17))
    for k, (at, _) in enumerate(rows):
        x[k, at] = ratio[at] / max(math.sqrt((ratio[at] ** 2).sum()), 1e-9)
    x[:, 16] = 1
    sign = np.array([1.0 if y else -1.0 for _, y in rows])

    def loss(w):
        return w @ w / 2 + nbsvm.PENALTY * np.maximum(0, 1 - sign * (x @ w)).sum()

    best, w = np.inf, np.zeros(17)
    for k in range(1, 6000):  # subgradient steps
        bad = sign * (x @ w) < 1
        w = w - (w - nbsvm.PENALTY * (sign[bad, None] * x[bad]).sum(0)) / k
        best = min(best, loss(w))
    fitted = np.append(model.weight / ratio, model.bias)
    assert loss(fitted) <= best * 1.02


def differences(loss, array, step=1e-5):
    out = np.zeros_like(array)
    for at in np.ndindex(array.shape):
        kept = array[at]
        array[at] = kept + step
        high = loss()
        array[at] = kept - step
        out[at] = (high - loss()) / (2 * step)
        array[at] = kept
    return out


@pytest.mark.parametrize("kind", ["gru", "lstm"])
def test_gradients_through_time_equal_differences(kind):
    rng = np.random.default_rng(1)
    h, gates = 3, 3 if kind == "gru" else 4
    table, cycle = rng.normal(0, 0.6, (5, gates * h)), rng.normal(0, 0.6, (h, gates * h))
    x = rng.integers(0, 5, (2, 6))
    aim = rng.normal(0, 1, (6, 2, h))
    if kind == "gru":
        cell = langid.Gru(table, cycle)
        forward, backward = cell.forward, cell.backward
    else:
        forward = lambda x: pii._lstm(x, table, cycle)
        backward = lambda x, kept, grad: pii._lstm_gradient(x, table, cycle, kept, grad)
    loss = lambda: float(((forward(x)[0] - aim) ** 2).sum() / 2)
    states, kept = forward(x)
    d_table, d_cycle = backward(x, kept, states - aim)
    assert d_table == pytest.approx(differences(loss, table), abs=1e-5)
    assert d_cycle == pytest.approx(differences(loss, cycle), abs=1e-5)


def test_chain_sums_equal_all_paths():
    rng = np.random.default_rng(6)
    scores, move = rng.normal(0, 1, (4, 2, 3)), rng.normal(0, 1, (3, 3))
    ahead, back, total = pii._passes(scores, move)
    for window in range(2):
        paths = {
            p: sum(scores[t, window, p[t]] for t in range(4)) + sum(move[p[t], p[t + 1]] for t in range(3))
            for p in itertools.product(range(3), repeat=4)
        }
        assert total[window] == pytest.approx(math.log(sum(map(math.exp, paths.values()))))
        for t in range(4):
            for tag in range(3):
                through = math.log(sum(math.exp(v) for p, v in paths.items() if p[t] == tag))
                assert ahead[t, window, tag] + back[t, window, tag] == pytest.approx(through)


def plain_luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_cards_and_phones_equal_plain_patterns():
    rng = random.Random(8)
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 555 010 7788", "+(1)", "+4", " ", "-", "  ", "5500000000000004",
             "378282246310005", "+49 (0)30 123-45.67", "+1234567890123456", "12", ".", "x", "+1 555", "0" * 20]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 8)))
        wanted = []
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if 13 <= len(digits) <= 19 and plain_luhn(digits):
                wanted.append((2, m.start(), m.end()))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
            if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
                wanted.append((3, m.start(), m.end()))
        assert [s for s in pii.base_spans(text) if s[0] >= 2] == wanted, text


def test_interleaving_equals_a_plain_ranking(spark):
    rng = random.Random(5)
    rows = [
        (None if k % 17 == 0 else k, rng.choice([None, "a", "bb", "çç"]), rng.choice(["s", "s", "s", "t", None, ""]))
        for k in range(203)
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted(
        (str(r["doc_id"]), str(r["source"]), r["text_crc32"], r["shard"], r["slot"])
        for r in sharding.interleaved(docs, shards=8, seed="z").collect()
    )
    strata = {}
    for i, text, source in rows:
        key = hashlib.md5(f"z:{'' if i is None else i}".encode()).hexdigest()
        raw = (text or "").encode()
        name = "" if source is None else f"={source}"
        strata.setdefault(name, []).append((key, zlib.crc32(raw), len(raw) + 1, str(i), str(source)))
    placed = []
    for name, own in strata.items():
        for k, row in enumerate(sorted(own)):
            placed.append(((k + 0.5) / len(own), name, *row))
    placed.sort()
    cut = lambda s: -(-s * len(rows) // 8)
    wanted = []
    for spot, (*_, crc, _, i, source) in enumerate(placed):
        shard = spot * 8 // len(rows)
        wanted.append((i, source, crc, shard, spot - cut(shard)))
    assert got == sorted(wanted)


def test_a_hot_id_is_one_training_row(spark):
    docs = spark.createDataFrame([(1, f"text {k:03}") for k in range(90)] + [(2, "b"), (None, "c")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1)], "doc_id bigint, toxic int")
    chosen = samples.labelled(labels, "toxic", limit=10, divisor=1000, held_out=999)
    got = sorted((r["id"], r["y"], r["text"]) for r in samples.sample_texts(docs, chosen).collect())
    assert got == [(1, 1, "text 000"), (2, 0, "b"), (2, 1, "b")]
