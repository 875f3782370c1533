"""Phrase collocations by sampling: proposed phrases and their negative border, counted exactly.

A sample proposes the phrases that look frequent. One pass over all texts counts those and the
border around them: phrases that were not proposed, but whose longest proper parts all were (every
single word is one). A border phrase that turns out frequent may have frequent extensions that
were not counted yet; further passes count only these, until no border phrase fails. Then every
frequent phrase has been counted, in the whole corpus, exactly.

Phrases fall into a fixed number of hash cells. A pass first adds up its candidates by cell, two
bytes each, and then counts, by their text, those whose cell reaches the support. What is known
to be frequent is a bitmap of cells too. Phrases that share a cell by chance make a pass count
more of them than it has to, never fewer, so counts stay exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.skew import salted_join
from tidemark.operators.stage import freeze

from .blocks import BLOCK_BYTES, LOWER, blocks, mix, prefix_sums, span_hashes

#: There are this power of two of cells; a bitmap of them takes 8 MB. Cells are added up in ranges
#: of 65,536, a task sends its candidates on after so many, and at least so many tasks share the
#: ranges: an array of a range takes 512 KB, whether one cell of it is in use or all are.
CELL_BITS = 26
RANGE_BITS = 16
HELD = 2_000_000
ADDERS = 32

# Piece ends are . , ; : ! ? and the bytes 0A to 0D; blank and tab stand between words.
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_GAP = _STOP.copy()
_GAP[[9, 32]] = True


@dataclass(frozen=True)
class Mining:
    """Support and longest phrase; share of texts in the sample, and how far below its
    proportional part the support in the sample is put."""

    support: int = 30
    longest: int = 4
    sample_parts: int = 4
    slack: float = 0.5

    @property
    def sample_support(self) -> int:
        return max(2, int(self.slack * self.support / self.sample_parts))


def word_stream(buf: np.ndarray, offs: np.ndarray):
    """Lower-cased words of a block, one blank apart: (bytes, starts, ends, piece, document)."""
    low = LOWER[np.insert(buf, offs[1:], 10)]  # a piece ends with its text
    border = offs[1:] + np.arange(1, len(offs))
    gap = _GAP[low]
    start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    end = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
    piece = np.cumsum(_STOP[low])[start]
    document = np.searchsorted(border, start, "right")
    kept = ~gap
    kept[end] = True  # the byte behind a word becomes its blank
    low[end] = 32
    size = end - start
    first = np.cumsum(size + 1) - (size + 1)
    return low[kept], first, first + size, piece, document


def _spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    offsets = np.append(0, np.cumsum(size))
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.Array.from_buffers(
        pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])]
    ).cast(pa.string())


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    names = [np.frombuffer(x.encode(), np.uint8) for x in coded.dictionary.to_pylist()]
    value = np.array(
        [span_hashes(prefix_sums(x), np.zeros(1, int), np.array([len(x)]))[0] for x in names], np.uint64
    )
    value = mix(value + np.uint64(0x2545F4914F6CDD1D))  # apart from the hash of an equal phrase
    return value[coded.indices.to_numpy(zero_copy_only=False)]


class Cells:
    """The cells of hashes, and which of them a bitmap holds; None holds nothing."""

    def __init__(self, packed: np.ndarray | None, bits: int) -> None:
        self.packed, self.shift = packed, np.uint64(64 - bits)

    def __call__(self, value: np.ndarray) -> np.ndarray:
        if self.packed is None:
            return np.zeros(len(value), bool)
        at = value >> self.shift
        return (self.packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


@dataclass(frozen=True)
class Pass:
    """What a pass over the texts counts: phrases of ``sizes`` words whose longest proper parts
    are ``known``; with ``before``, only those of which a part was not known then."""

    sizes: range
    bits: int
    known: object = None
    before: object = None

    def candidates(self):
        """(batch) to (word stream, size, places, hashes, known) of each block with candidates."""
        known = Cells(self.known and self.known.value, self.bits)
        before = Cells(self.before.value, self.bits) if self.before else None

        def found(batch: pa.RecordBatch):
            seeds = _lang_hashes(batch.column(0))
            for first, _, buf, offs in blocks(batch.column(1)):
                if not offs[-1]:
                    continue
                data, start, end, piece, doc = word_stream(buf, offs)
                stream, parts = (data, start, end, first + doc), None
                sums, seed = prefix_sums(data), seeds[first + doc]
                for n in range(max(1, self.sizes.start - 1), min(self.sizes.stop, len(piece) + 1)):
                    k = len(piece) - n + 1
                    value = mix(span_hashes(sums, start[:k], end[n - 1 :]) ^ seed[:k])
                    held = known(value), before(value) if before else None
                    if n in self.sizes:
                        wanted = piece[:k] == piece[n - 1 :]
                        if n > 1:
                            wanted &= parts[0][:-1] & parts[0][1:]
                            if before:
                                wanted &= ~(parts[1][:-1] & parts[1][1:])
                        at = np.flatnonzero(wanted)
                        if len(at):
                            yield stream, n, at, value[at], held[0][at]
                    parts = held

        return found


def dealt(ranges: DataFrame) -> DataFrame:
    """Rows by their range. The number is given, since Spark would put small shuffles into one task,
    which would hold the arrays of all ranges."""
    usual = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(max(ADDERS, usual), "part")


def full_cells(texts: DataFrame, what: Pass, least: int) -> np.ndarray:
    """Bitmap of the cells whose candidates occur ``least`` times or more in ``texts``.

    Tasks send sorted cells on by range, with their number where it is more than one; a range is
    added up in one array of fixed size, from a stream of what tasks sent.
    """
    low = (1 << RANGE_BITS) - 1

    def sent(cells: np.ndarray) -> pa.RecordBatch:
        cell, often = np.unique(cells, return_counts=True)
        part = cell >> RANGE_BITS
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        once, more, times = [], [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            single = often[a:b] == 1
            own = (cell[a:b] & low).astype(np.uint16)
            once.append(own[single].tobytes())
            more.append(own[~single].tobytes())
            times.append(often[a:b][~single].astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(part[cuts[:-1]].astype(np.int32)), *[pa.array(x, pa.binary()) for x in (once, more, times)]],
            names=["part", "once", "more", "times"],
        )

    def send(batches):
        found, kept, size = what.candidates(), [], 0
        shift = np.uint64(64 - what.bits)
        for batch in batches:
            for _, _, _, value, _ in found(batch):
                kept.append((value >> shift).astype(np.int64))
                size += len(value)
                if size > HELD:
                    yield sent(np.concatenate(kept))
                    kept, size = [], 0
        if kept:
            yield sent(np.concatenate(kept))

    def add_up(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, once, more, times in zip(*(batch.column(k) for k in range(4)), strict=True):
                own = sums.setdefault(part.as_py(), np.zeros(low + 1, np.int64))
                own[np.frombuffer(once.as_buffer(), np.uint16)] += 1
                own[np.frombuffer(more.as_buffer(), np.uint16)] += np.frombuffer(times.as_buffer(), np.uint32)
        full = {p: np.packbits(x >= least, bitorder="little").tobytes() for p, x in sums.items() if x.max() >= least}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(full), pa.int32()), pa.array(list(full.values()), pa.binary())], names=["part", "bits"]
        )

    packed = np.zeros(1 << (what.bits - 3), np.uint8)
    bytes_of = 1 << (RANGE_BITS - 3)
    rows = dealt(texts.mapInArrow(send, "part int, once binary, more binary, times binary"))
    for r in rows.mapInArrow(add_up, "part int, bits binary").collect():  # no more than the bitmap
        packed[r["part"] * bytes_of : (r["part"] + 1) * bytes_of] = np.frombuffer(r["bits"], np.uint8)
    return packed


NAMES = ["lang", "phrase", "often", "known"]


def counted(texts: DataFrame, what: Pass, full, totals: bool = False) -> DataFrame:
    """(lang, phrase, size, f, known) of the candidates whose cell is in the bitmap ``full``
    (all of them without one), counted exactly; with ``totals`` also the words of each language,
    as a row without a phrase."""

    def run(batches):
        found = what.candidates()
        enough = Cells(full.value, what.bits) if full else lambda value: np.ones(len(value), bool)
        for batch in batches:
            langs = batch.column(0)
            for (data, start, end, doc), n, at, value, held in found(batch):
                if n == 1 and totals:
                    words = np.bincount(doc[at], minlength=len(langs))
                    of = np.flatnonzero(words)
                    yield pa.RecordBatch.from_arrays(
                        [
                            langs.take(pa.array(of)),
                            pa.nulls(len(of), pa.string()),
                            pa.array(words[of]),
                            pa.array(np.zeros(len(of), bool)),
                        ],
                        names=NAMES,
                    )
                kept = np.flatnonzero(enough(value))
                if not len(kept):
                    continue
                order = kept[np.argsort(value[kept], kind="stable")]
                new = np.flatnonzero(np.concatenate([[True], value[order[1:]] != value[order[:-1]]]))
                often, one = np.diff(np.append(new, len(order))), order[new]
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.take(pa.array(doc[at[one]])),
                        _spans(data, start[at[one]], end[at[one] + n - 1]),
                        pa.array(often),
                        pa.array(held[one]),
                    ],
                    names=NAMES,
                )

    return (
        texts.mapInArrow(run, "lang string, phrase string, often bigint, known boolean")
        .groupBy("lang", "phrase")
        .agg(F.sum("often").alias("f"), F.max("known").alias("known"))
        .withColumn("size", F.size(_words(F.col("phrase"))))
    )


def with_hash(phrases: DataFrame) -> DataFrame:
    """(hash) of each phrase (lang, phrase), the one that decides on its cell in a text."""

    def run(batches):
        for batch in batches:
            seeds = _lang_hashes(batch.column(0))
            for first, rows, buf, offs in blocks(batch.column(1)):
                value = span_hashes(prefix_sums(buf), offs[:-1], offs[1:])
                value = mix(value ^ seeds[first : first + rows]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(value)], names=["hash"])

    return phrases.select("lang", "phrase").mapInArrow(run, "hash bigint")


def cells_of(phrases: DataFrame, bits: int) -> np.ndarray:
    """The cells of counted phrases. Made on the executors; at most ``2**bits / 8`` bytes return."""
    position = F.shiftrightunsigned("hash", 64 - bits) + 1
    slots = (
        with_hash(phrases)
        .select(position.alias("at"))
        .groupBy(F.bitmap_bucket_number("at").alias("slot"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    )
    packed = np.zeros(1 << (bits - 3), np.uint8)
    for r in slots.toLocalIterator():
        first = (r["slot"] - 1) * len(r["bits"])
        packed[first : first + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)[: len(packed) - first]
    return packed


def frequent_phrases(texts: DataFrame, mining: Mining, *, bits: int = CELL_BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, f) of every phrase with ``support`` occurrences, (lang, n) word totals).

    ``texts`` has lang (not null) and text.
    """
    share = texts.sparkSession.sparkContext.broadcast
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(mining.sample_parts)) == 0)
    packed, known = np.zeros(1 << (bits - 3), np.uint8), None
    for n in range(1, mining.longest + 1):
        level = full_cells(sample, Pass(range(n, n + 1), bits, known), mining.sample_support)
        packed = packed | level
        known = share(packed)
        if not level.any():
            break

    often = (F.col("f") >= mining.support) | F.col("phrase").isNull()
    first = Pass(range(1, mining.longest + 1), bits, known)
    full = share(full_cells(texts, first, mining.support))
    found = freeze(counted(texts, first, full, totals=True).where(often))
    totals = found.where("phrase is null").select("lang", F.col("f").alias("n"))
    frequent = found = found.where("phrase is not null")
    while True:
        failed = cells_of(found.where(~F.col("known") & (F.col("size") < mining.longest)), bits)
        if not (failed & ~packed).any():  # every border phrase held
            return frequent.select("lang", "phrase", "size", "f"), totals
        packed, before = packed | failed, known
        known = share(packed)
        further = Pass(range(2, mining.longest + 1), bits, known, before)
        found = freeze(counted(texts, further, None).where(often))  # few, so without cells
        frequent = frequent.unionByName(found)


def _words(phrase: Column) -> Column:
    return F.split(phrase, " ")


def collocations(
    docs: DataFrame,
    *,
    top: int = 2000,
    mining: Mining = Mining(),
    lang: str = "lang",
    text: str = "text",
    bits: int = CELL_BITS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score.

    Words are lower-cased (A-Z), phrases have two words or more and stay within a piece. A
    candidate's weakest cut gives l and r, the counts of its two parts, and the score
    ``floor(2000000 a / (l + r))``; ties fall to the earliest cut. Candidates inside a longer one
    that occurs at least four fifths as often are left out. Null languages count as ``und``; null
    and empty texts have no words; equal rows count each; an empty table gives an empty result;
    other columns are ignored.
    """
    texts = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    frequent, totals = frequent_phrases(texts, mining, bits=bits)
    candidates = frequent.where("size > 1").withColumnRenamed("f", "a")
    wide = lambda c: F.col(c).cast("decimal(38,0)")

    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    of = F.when(F.col("side") == 0, F.slice("w", F.lit(1), F.col("k"))).otherwise(
        F.slice("w", F.col("k") + 1, F.col("size") - F.col("k"))
    )
    parts = (
        cuts.withColumn("w", _words(F.col("phrase")))
        .withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        .select("lang", F.array_join(of, " ").alias("part"), "phrase", "a", "k", "side")
    )
    counts = frequent.select("lang", F.col("phrase").alias("part"), "f")
    sides = (
        salted_join(parts, counts, ["lang", "part"])
        .groupBy("lang", "phrase", "a", "k")
        .agg(
            F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"),
            F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"),
        )
        .withColumn("a2", wide("a") * F.lit(2_000_000).cast("decimal(10,0)"))
        .withColumn("score", F.expr("a2 div (cast(l as decimal(38,0)) + cast(r as decimal(38,0)))"))
    )
    scored = sides.groupBy("lang", "phrase", "a").agg(
        F.min_by(F.struct("score", "l", "r"), F.struct("score", "k")).alias("cut")
    )
    inner = (
        candidates.where("size > 2")
        .withColumn("w", _words(F.col("phrase")))
        .withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
        .groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase"))
        .agg(F.max("a").alias("longer"))
    )
    kept = scored.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * 80)
    )
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    return (
        kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
        .where(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
