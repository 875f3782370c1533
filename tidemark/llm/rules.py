"""Quality rules: decision lists learned by sequential covering, applied as Spark conditions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import (
    BLANK,
    LOWER,
    NOT_ALNUM,
    blocks,
    mix,
    per_document,
    prefix_sums,
    span_hashes,
    with_text_columns,
    words,
)
from .samples import labelled, sample_texts

#: Bounds on the labelled documents read, the rules, their conditions and tried thresholds.
SAMPLE = 6000
RULES, CONDITIONS, THRESHOLDS = 12, 3, 32

COUNTS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, n_chars_all bigint, n_upper bigint, n_letters bigint, n_marks bigint, "
    "n_lines bigint, n_distinct_words bigint"
)
#: Ratios that rules may test, as SQL over the counts.
RATIOS = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "words": "n_words / 1",
}


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _table(b"#*$%&|<>")
_UPPER = _table(bytes(range(65, 91)))
_LETTER = ~NOT_ALNUM & ~_table(bytes(range(48, 58)))
_MARK = _table(b"!?\"'()[]{}=/\\^~`_+@;:")
_CONTINUED = _table(bytes(range(128, 192)))


def document_counts(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The counts of ``COUNTS`` for the documents of a block."""
    n = len(offs) - 1
    sums = prefix_sums(buf)
    start, end, doc = words(buf, offs, BLANK)
    word = span_hashes(sums, start, end)
    count = per_document(doc, n)

    def inside(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[offs[1:]] - total[offs[:-1]]

    # Words in three-word windows that occur twice or more in the same text.
    repeated = np.zeros(len(word), bool)
    if len(word) >= 3:
        at = np.flatnonzero(doc[2:] == doc[:-2])
        value = mix(mix(mix(word[at] + np.uint64(3)) + word[at + 1]) + word[at + 2])
        order = np.lexsort((value, doc[at]))
        d, v = doc[at][order], value[order]
        equal = (d[1:] == d[:-1]) & (v[1:] == v[:-1])
        twice = np.zeros(len(at), bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        hit = at[order[twice]]
        for k in range(3):
            repeated[hit + k] = True
    # Lines with a word that equal an earlier one of the text.
    line_start, line_end, line_doc = words(buf, offs, _table(b"\n"))
    worded = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    value, line_doc = span_hashes(sums, line_start, line_end)[worded], line_doc[worded]
    order = np.lexsort((value, line_doc))
    d, v = line_doc[order], value[order]
    again = d[1:][(d[1:] == d[:-1]) & (v[1:] == v[:-1])]
    lower = span_hashes(prefix_sums(LOWER[buf]), start, end)
    order = np.lexsort((lower, doc))
    d, v = doc[order], lower[order]
    same = d[1:][(d[1:] == d[:-1]) & (v[1:] == v[:-1])]
    return [
        count,
        inside(~BLANK[buf] & ~_CONTINUED[buf]),
        inside(_SYMBOL[buf]),
        per_document(again, n),
        per_document(doc[repeated], n),
        inside(~_CONTINUED[buf]),
        inside(_UPPER[buf]),
        inside(_LETTER[buf] & ~_CONTINUED[buf]),
        inside(_MARK[buf]),
        per_document(line_doc, n),
        count - per_document(same, n),
    ]


def text_statistics(
    docs: DataFrame, *, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``docs[keep]`` with the counts; null texts have none. Same-named columns are replaced."""

    def start():
        def columns(texts: pa.Array) -> list[pa.Array]:
            parts = [document_counts(buf, offs) for _, _, buf, offs in blocks(texts)]
            return [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True)]

        return columns

    return with_text_columns(docs, start, COUNTS, text=text, keep=keep)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(RATIOS[self.name])
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        value = table[self.name]
        return value > self.threshold if self.above else value <= self.threshold


def _log_ratio(p: float, n: float) -> float:
    return float(np.log2((p + 1e-9) / (p + n + 1e-9)))


def _grown(table, bad, weight) -> list[Condition]:
    """Conditions added one by one for the largest information gain on the growing rows."""
    inside = np.ones(len(bad), bool)
    rule: list[Condition] = []
    while len(rule) < CONDITIONS and (inside & ~bad).any():
        p0, n0 = weight[inside & bad].sum(), weight[inside & ~bad].sum()
        best, chosen = 1e-6, None
        for name, value in table.items():
            cuts = np.unique(np.quantile(value[inside], np.linspace(0, 1, THRESHOLDS + 1)[1:-1]))
            bad_cuts = np.unique(np.quantile(value[inside & bad], np.linspace(0, 1, 9)))
            for cut in np.unique(np.concatenate([cuts, bad_cuts])):
                for above in (True, False):
                    held = inside & ((value > cut) if above else (value <= cut))
                    p, n = weight[held & bad].sum(), weight[held & ~bad].sum()
                    gain = p * (_log_ratio(p, n) - _log_ratio(p0, n0)) if p else 0.0
                    if gain > best:
                        best, chosen = gain, Condition(name, above, float(cut))
        if chosen is None:
            break
        rule.append(chosen)
        inside &= chosen.holds(table)
    return rule


def _worth(rule, table, bad) -> float:
    held = reduce(np.logical_and, [c.holds(table) for c in rule], np.ones(len(bad), bool))
    p, n = (held & bad).sum(), (held & ~bad).sum()
    return float((p - n) / (p + n)) if p + n else -1.0


def learn_list(table: dict[str, np.ndarray], bad: np.ndarray) -> list[list[Condition]]:
    """Ordered conjunctions that mark low quality.

    Two thirds of the rows grow a rule, one third prunes it: the final conditions go as long as
    that does not lower (p - n) / (p + n) there. A rule that is wrong on half of the pruning
    rows ends the list; covered rows leave before the next rule.
    """
    growing = np.arange(len(bad)) % 3 != 2
    left = np.ones(len(bad), bool)
    rules: list[list[Condition]] = []
    while len(rules) < RULES and (left & bad & growing).any():
        part = lambda rows: {k: v[rows] for k, v in table.items()}  # noqa: B023, E731
        grow, prune = left & growing, left & ~growing
        rule = _grown(part(grow), bad[grow], np.ones(grow.sum()))
        if not rule:
            break
        cut = max(
            range(1, len(rule) + 1), key=lambda k: (_worth(rule[:k], part(prune), bad[prune]), -k)
        )
        rule = rule[:cut]
        if _worth(rule, part(prune), bad[prune]) <= 0:
            break
        rules.append(rule)
        left &= ~reduce(np.logical_and, [c.holds(table) for c in rule])
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The ordered list as one conditional expression: false where a rule marks the text."""
    out = None
    for rule in rules:
        test = reduce(Column.__and__, [c.column() for c in rule])
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit_rules(docs: DataFrame, labels: DataFrame, *, limit: int = SAMPLE) -> list[list[Condition]]:
    """Learn from at most ``limit`` labelled documents outside the held-out fold that pass the base.

    Only their statistics, a few numbers a document, reach the driver. Null texts have no words
    and so fail the base; rows are ordered by a digest of the id, then by their values, so ties
    and repeated rows do not depend on partitions. Without labelled rows no rule is learned.
    """
    sample = labelled(labels, "quality", limit=limit, divisor=3, held_out=1)
    rows = (
        text_statistics(sample_texts(docs, sample), keep=["id", "y"])
        .where(~base_failed())
        .select("id", "y", *[F.expr(e).cast("double").alias(k) for k, e in RATIOS.items()])
        .orderBy(F.md5(F.col("id").cast("string")), "id", "y", *RATIOS)
        .collect()
    )
    if not rows:
        return []
    table = {k: np.array([r[k] for r in rows]) for k in RATIOS}
    return learn_list(table, np.array([r["y"] == 0 for r in rows]))


def rules_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: the counts, the base verdict and the learned one.

    Repeated rows and null ids stay rows of their own; a null text counts zero words and fails
    the base; an empty table gives an empty result.
    """
    rules = fit_rules(docs, labels)
    return text_statistics(docs, keep=["doc_id"]).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & verdict(rules)).alias("kept"),
    )
