"""Vector operations on blocks of UTF-8 text: word borders and hashes without a loop over words.

A block is the concatenated bytes of some whole documents and their offsets. Word hashes are
differences of one running polynomial over the block, so that their cost is per byte.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Bytes that separate words. Every byte of a non-ASCII character belongs to a word.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
for _low, _high in ((48, 58), (65, 91), (97, 123)):
    NOT_ALNUM[_low:_high] = False
BLANK = np.zeros(256, bool)
BLANK[9:14] = True
BLANK[32] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n + 1:
        size = max(n + 1, BLOCK_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Running polynomial of the block, one entry more than bytes."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _powers(len(buf))[0][: len(buf)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    inverse = _powers(len(sums) - 1)[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def blocks(
    column: pa.Array, limit: int = BLOCK_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of consecutive runs of whole texts; null reads as empty.

    A run ends before ``limit`` bytes are passed; a longer text stands alone, whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offs, offs[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last - first, whole[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def words(
    buf: np.ndarray, offs: np.ndarray, separator: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every maximal run of bytes that are no separators."""
    if not len(buf):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~separator[buf]
    border = np.zeros(len(buf) + 1, bool)
    border[offs] = True
    outside_before = border[:-1].copy()
    outside_before[1:] |= ~inside[:-1]
    outside_after = border[1:].copy()
    outside_after[:-1] |= ~inside[1:]
    start = np.flatnonzero(inside & outside_before)
    end = np.flatnonzero(inside & outside_after) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def per_document(doc: np.ndarray, n: int, values: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64)


Columns = Callable[[pa.Array], list[pa.Array]]


def with_text_columns(
    docs: DataFrame,
    compute: Callable[[], Columns],
    fields: str,
    *,
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs[keep]`` with new columns computed from whole texts, one Arrow batch at a time.

    ``compute()`` runs once per task and returns the function from a text column to the new
    columns. Kept columns that bear a new column's name are replaced. Narrow: no shuffle.
    """
    new = T._parse_datatype_string(fields)
    names = set(new.names)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    passed = [F.col(f"`{c}`") for c in keep]
    source = docs.select(F.col(f"`{text}`").cast("string").alias("_whole_text"), *passed)
    schema = T.StructType([*source.schema.fields[1:], *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = columns or compute()
            added = columns(batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *added], names=[*keep, *new.names]
            )

    return source.mapInArrow(run, schema)


def set_aside(docs: DataFrame, names: list[str]):
    """``docs`` with its columns of these names renamed, and the function that restores
    exactly the columns of ``docs``."""
    own = [c for c in docs.columns if c in names]

    def restore(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`_own_{c}`" if c in own else f"`{c}`").alias(c) for c in docs.columns])

    return docs.withColumnsRenamed({c: f"_own_{c}" for c in own}), restore


def id_text(doc_id: str = "doc_id"):
    """The id as text; a null id counts as empty."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def remainder(doc_id: str, divisor: int):
    """crc32 of the id as text, modulo ``divisor``: the fixed folds of the learned operators."""
    return F.crc32(id_text(doc_id)) % divisor
