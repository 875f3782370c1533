"""Benchmark decontamination with a generalised suffix automaton over item words.

The automaton of a block of items is broadcast; texts stream through it and carry the length
of the longest match that ends at each word. Benchmarks of any size are handled in blocks of
bounded size, one narrow pass over the texts for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.stage import freeze

from .blocks import LOWER, NOT_ALNUM, set_aside, with_text_columns

WINDOW = 10
#: Item words in one broadcast automaton; a word takes about 600 bytes in a worker.
BLOCK_WORDS = 100_000

_CLEAN = bytes(32 if NOT_ALNUM[b] else LOWER[b] for b in range(256))


def item_words(text: bytes) -> list[bytes]:
    return text.translate(_CLEAN).split()


class Automaton:
    """Suffix automaton of several word sequences, with the windows that end in each state.

    ``ends[state]`` lists ``(length, items)``: a match of at least ``length`` words ending in
    ``state`` or in a state below it by suffix links ends an occurrence of those windows.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.words: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        coded = [(name, [self.words.setdefault(w, len(self.words)) for w in ws]) for name, ws in items]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.ends: dict[int, list[tuple[int, tuple[str, ...]]]] = {}
        found: dict[tuple[int, int], set[str]] = {}
        for name, codes in coded:
            span = min(window, len(codes))
            state = size = 0
            for c in codes:
                state, size = self._advance(state, size, c)
                if size >= span:
                    at = state
                    while self.length[self.link[at]] >= span:
                        at = self.link[at]
                    found.setdefault((at, span), set()).add(name)
        for (at, span), names in found.items():
            self.ends.setdefault(at, []).append((span, tuple(sorted(names))))
        self.shortest = min((s for _, s in found), default=1)
        # The windows of a state and of all states its suffix links reach.
        for at in sorted(range(len(self.link)), key=self.length.__getitem__):
            above = self.ends.get(self.link[at]) if at else None
            if above:
                self.ends[at] = above + self.ends.get(at, [])

    def _extend(self, last: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        known = step[last].get(c)
        if known is not None:
            if length[known] == length[last] + 1:
                return known
            return self._clone(last, known, c)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return new

    def _clone(self, p: int, q: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        copy = len(step)
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = copy
            p = link[p]
        return copy

    def _advance(self, state: int, size: int, c: int) -> tuple[int, int]:
        step, link, length = self.step, self.link, self.length
        while state and c not in step[state]:
            state = link[state]
            size = length[state]
        following = step[state].get(c)
        return (following, size + 1) if following is not None else (0, 0)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit word spans (merged, end exclusive), items met, and the longest match."""
        codes = np.fromiter(map(self.words.get, words, _MISSING), np.int64, len(words))
        # Only runs of known words that are long enough for some window can hold a match.
        known = np.concatenate([[False], codes >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        longest = 0
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < self.shortest:
                continue
            state = size = 0
            for i, c in enumerate(codes[a:b].tolist(), a + 1):
                state, size = self._advance(state, size, c)
                if size < self.shortest:
                    continue
                longest = max(longest, size)
                ended = self.ends.get(state)
                if not ended:
                    continue
                most = 0
                for span, items in ended:
                    if span <= size:
                        most = max(most, span)
                        names.update(items)
                if most:
                    start = i - most
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        return spans, names, longest


class _Missing:
    """An endless supply of -1 for ``map(dict.get, keys, ...)``."""

    def __iter__(self):
        return self

    def __next__(self) -> int:
        return -1


_MISSING = _Missing()


def item_blocks(
    items: DataFrame, item_id: str, text: str, block_words: int
) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with words, streamed to the driver in blocks of at most ``block_words`` words.

    An item longer than a block is a block of its own.
    """
    rows = items.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("name"),
        F.col(f"`{text}`").cast("string").alias("body"),
    ).where(F.col("body").isNotNull())
    block, size = [], 0
    for row in rows.toLocalIterator():
        words = item_words(row["body"].encode())
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row["name"], words))
        size += len(words)
    if block:
        yield block


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FOUND_NAMES = ["n_words", "hit_from", "hit_to", "items", "longest_match"]
FOUND = "n_words bigint, hit_from array<int>, hit_to array<int>, items array<string>, longest_match int"


def match_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    window: int = WINDOW,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs[keep]`` with n_words, hit word spans, met items and the longest match in words.

    Words are runs of ASCII letters, digits and non-ASCII characters after lower-casing A-Z.
    A window is ``window`` consecutive item words, or a shorter item as a whole. Null and empty
    texts have no words; null or wordless items are ignored; items with equal ids count once;
    a null item id reads as empty. Columns of ``docs`` with the names added are replaced.
    The pass for a block is narrow; beyond one block the passes are cut by checkpoints.
    """
    context = docs.sparkSession.sparkContext
    names = FOUND_NAMES
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    found: DataFrame | None = None
    source = docs

    def scanner(shared):
        def start():
            automaton = shared.value if shared else None

            def columns(texts: pa.Array) -> list[pa.Array]:
                texts = texts.cast(pa.binary())
                total, lows, highs, met, longest = [], [], [], [], []
                for value in texts:
                    words = item_words(value.as_py() or b"")
                    spans, items_met, most = (
                        automaton.scan(words) if automaton and words else ([], set(), 0)
                    )
                    total.append(len(words))
                    lows.append([a for a, _ in spans])
                    highs.append([b for _, b in spans])
                    met.append(sorted(items_met))
                    longest.append(most)
                return [
                    pa.array(total, pa.int64()),
                    pa.array(lows, pa.list_(pa.int32())),
                    pa.array(highs, pa.list_(pa.int32())),
                    pa.array(met, pa.list_(pa.string())),
                    pa.array(longest, pa.int32()),
                ]

            return columns

        return start

    stream = item_blocks(items, item_id, item_text, block_words)
    block = next(stream, None)
    while block is not None:
        following = next(stream, None)
        if found is not None:
            source = freeze(_combined(found, kept, text))
        carried = [c for c in source.columns if c.startswith("_was_")]
        passed = [*kept, *([text] if following is not None and text not in kept else []), *carried]
        shared = context.broadcast(Automaton(block, window))
        found = with_text_columns(source, scanner(shared), FOUND, text=text, keep=passed)
        block = following
    if found is None:
        found = with_text_columns(docs, scanner(None), FOUND, text=text, keep=kept)
        return found.select(*kept, *names)
    return _finished(found).select(*kept, *names)


def _combined(found: DataFrame, kept: list[str], text: str) -> DataFrame:
    """The texts again, with what earlier blocks have found under ``_was_`` names."""
    done = _finished(found)
    passed = list(dict.fromkeys([*kept, text]))
    return done.select(
        *passed,
        *[F.col(c).alias(f"_was_{c}") for c in ("hit_from", "hit_to", "items", "longest_match")],
    )


def _finished(found: DataFrame) -> DataFrame:
    if "_was_items" not in found.columns:
        return found
    spans = lambda a, b: F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))
    both = F.array_sort(F.concat(spans("hit_from", "hit_to"), spans("_was_hit_from", "_was_hit_to")))
    merged = F.aggregate(
        both,
        F.expr("cast(array() as array<struct<a:int,b:int>>)"),
        lambda out, s: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["b"] >= s["a"]),
            F.concat(
                F.slice(out, 1, F.size(out) - 1),
                F.array(
                    F.struct(
                        F.element_at(out, -1)["a"].alias("a"),
                        F.greatest(F.element_at(out, -1)["b"], s["b"]).alias("b"),
                    )
                ),
            ),
        ).otherwise(F.concat(out, F.array(s))),
    )
    return found.withColumn("_spans", merged).withColumns(
        {
            "hit_from": F.col("_spans.a"),
            "hit_to": F.col("_spans.b"),
            "items": F.array_sort(F.array_union("items", "_was_items")),
            "longest_match": F.greatest("longest_match", "_was_longest_match"),
        }
    )


def hits() -> F.Column:
    """Words inside occurrences."""
    return F.aggregate(
        F.zip_with("hit_from", "hit_to", lambda a, b: (b - a).cast("bigint")),
        F.lit(0).cast("bigint"),
        lambda s, x: s + x,
    )


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per document: counts, items digest and verdict."""
    return found.select(
        doc_id,
        "n_words",
        hits().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
        "longest_match",
    )


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between those words."""
    clean = text.translate(_CLEAN)
    if not spans:
        return text
    borders, at = [], 0
    for word in clean.split():
        at = clean.index(word, at)
        borders.append((at, at + len(word)))
        at += len(word)
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : borders[a][0]])
        last = borders[b - 1][1]
    out.append(text[last:])
    return b"".join(out)


def decontaminated(
    docs: DataFrame,
    items: DataFrame,
    *,
    window: int = WINDOW,
    longest_span: int = 0,
    max_coverage: float = 0.0,
    text: str = "text",
    **options,
) -> DataFrame:
    """``docs`` without benchmark passages, columns unchanged.

    Hit spans of more than ``longest_span`` words are over the length limit. A document whose
    share of words in such spans is over ``max_coverage`` goes; from the others the spans are
    cut out of the text (an ``n_chars`` column follows). The defaults reject every document
    with a passage. Clean documents, null and empty texts stay untouched.
    """
    own, restore = set_aside(docs, FOUND_NAMES)
    found = match_items(own, items, window=window, text=text, **options)
    long = F.filter(
        F.arrays_zip(F.col("hit_from").alias("a"), F.col("hit_to").alias("b")),
        lambda s: s["b"] - s["a"] > longest_span,
    )
    marked = found.withColumn("_long", long)
    covered = F.aggregate("_long", F.lit(0), lambda s, x: s + x["b"] - x["a"])
    stay = marked.where(covered <= F.lit(max_coverage) * F.col("n_words"))
    if max_coverage <= 0:
        return restore(stay)

    def cut(batches):
        for batch in batches:
            bodies, spans = batch.column(text).cast(pa.binary()), batch.column("_long")
            out = [
                b.as_py() if not len(s) else cut_spans(b.as_py(), [(x["a"], x["b"]) for x in s.as_py()])
                for b, s in zip(bodies, spans, strict=True)
            ]
            at = batch.schema.get_field_index(text)
            columns = [pa.array(out, pa.binary()).cast(pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns[:-1], names=batch.schema.names[:-1])

    out = restore(stay.select(*own.columns, "_long").mapInArrow(cut, own.schema))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return out
