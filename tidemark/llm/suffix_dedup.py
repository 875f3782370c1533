"""Removal of long repeated byte strings by suffix sorting in shards.

Two equal strings of ``length`` bytes hold the same anchor (their least hashed gram) at the same
place. So the windows of a text are cut into runs that share an anchor, runs with equal anchors
go to one shard, and only there suffixes are sorted. Runs that occur twice as a whole need no
sorting. Texts are moved once, and only those with a run whose anchor occurs elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.stage import freeze

from .anchors import window_minima
from .blocks import blocks, mix, prefix_sums, span_hashes, with_text_columns
from .induced import repeated_starts

LENGTH = 400
#: Bytes sorted at once, and distinct runs of an anchor from which its windows are counted singly.
SHARD_BYTES = 1 << 20
HOT_RUNS = 20_000


def _runs(length: int):
    gram = max(1, length // 3)
    width = length - gram + 1

    def columns(texts: pa.Array) -> list[pa.Array]:
        counts = np.zeros(len(texts), np.int64)
        out = [[], [], [], []]
        for first, n, buf, offs in blocks(texts):
            sums = prefix_sums(buf)
            for d in np.flatnonzero(offs[1:] - offs[:-1] >= length).tolist():
                a, b = int(offs[d]), int(offs[d + 1])
                at = np.arange(a, b - gram + 1)
                value = span_hashes(sums, at, at + gram)
                place = window_minima(value, width)
                new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                size = np.append(new[1:], len(place)) - new + length - 1
                counts[first + d] = len(new)
                out[0].append(value[place[new]].view(np.int64))
                out[1].append(span_hashes(sums, a + new, a + new + size).view(np.int64))
                out[2].append(new)
                out[3].append(size)
        offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return [
            pa.ListArray.from_arrays(offsets, pa.array(x.astype(t)))
            for x, t in zip(flat, (np.int64, np.int64, np.int32, np.int32), strict=True)
        ]

    return columns


RANGES = "array<struct<low:int,high:int>>"
RUNS = "anchor array<bigint>, content array<bigint>, at array<int>, size array<int>"


def sorted_shards(slices: DataFrame, length: int, shard_bytes: int, queue_bytes: int) -> DataFrame:
    """(anchor, content, ranges): the window starts of a run that occur elsewhere, as ranges.

    ``slices`` holds each distinct run of an anchor once, with its bytes. Runs of an anchor stay
    together; anchors are sorted together up to ``shard_bytes``.
    """

    def work(rows):
        out = []
        for (anchor, content, _), starts in zip(
            rows, repeated_starts([r[2] for r in rows], length, queue_bytes), strict=True
        ):
            if not len(starts):
                continue
            cuts = np.flatnonzero(np.diff(starts) > 1)
            low, high = starts[np.append(0, cuts + 1)], starts[np.append(cuts, len(starts) - 1)]
            pairs = zip(low.tolist(), high.tolist(), strict=True)
            out.append((anchor, content, [{"low": a, "high": b} for a, b in pairs]))
        columns = zip(*out, strict=True) if out else [[]] * 3
        types = [pa.int64(), pa.int64(), pa.list_(pa.struct({"low": pa.int32(), "high": pa.int32()}))]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
            names=["anchor", "content", "ranges"],
        )

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for anchor, content, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= shard_bytes and anchor != rows[-1][0]:
                    yield work(rows)
                    rows, size = [], 0
                rows.append((anchor, content, piece))
                size += len(piece)
        if rows:
            yield work(rows)

    return (
        slices.select("anchor", "content", "piece")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(run, f"anchor bigint, content bigint, ranges {RANGES}")
    )


def counted_windows(slices: DataFrame, length: int) -> DataFrame:
    """The same ranges for anchors with very many runs: 128-bit window hashes are counted.

    Counting combines map-side, so no task holds an anchor's runs together.
    """

    def columns():
        def hashes(pieces: pa.Array) -> list[pa.Array]:
            firsts, seconds = [], []
            for piece in pieces:
                buf = np.frombuffer(piece.as_buffer(), np.uint8)
                at = np.arange(len(buf) - length + 1)
                firsts.append(span_hashes(prefix_sums(buf), at, at + length).view(np.int64))
                turned = prefix_sums(np.bitwise_xor(buf, np.uint8(0x55)))
                seconds.append(mix(span_hashes(turned, at, at + length)).view(np.int64))
            of = lambda x: pa.array(x, pa.list_(pa.int64()))
            return [of(firsts), of(seconds)]

        return hashes

    def run(batches):
        compute = columns()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *compute(batch.column(2))],
                names=["anchor", "content", "one", "two"],
            )

    windows = (
        slices.select("anchor", "content", "piece")
        .mapInArrow(run, "anchor bigint, content bigint, one array<bigint>, two array<bigint>")
        .select("anchor", "content", F.posexplode(F.arrays_zip("one", "two")).alias("low", "w"))
        .select("anchor", "content", "low", "w.one", "w.two")
    )
    often = freeze(windows.groupBy("one", "two").count().where("count > 1").select("one", "two"))
    start = F.struct(F.col("low").cast("int").alias("low"), F.col("low").cast("int").alias("high"))
    return (
        windows.join(often, ["one", "two"])
        .groupBy("anchor", "content")
        .agg(F.collect_list(start).alias("ranges"))
    )


SPANS = "array<struct<low:bigint,high:bigint>>"


def _cut(batches):
    for batch in batches:
        spans, kept = [], []
        for body, pieces in zip(batch.column("body"), batch.column("spans"), strict=True):
            data = memoryview(body.as_buffer())
            merged: list[list[int]] = []
            for s in sorted((p["a"], p["b"]) for p in pieces.as_py()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            ends = [0, *(x for s in merged for x in s), len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
            spans.append([{"low": a, "high": b} for a, b in merged])
        types = pa.list_(pa.struct({"low": pa.int64(), "high": pa.int64()}))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(spans, types), pa.array(kept, pa.binary())],
            names=["row", "spans", "kept"],
        )


def cut_texts(
    docs: DataFrame,
    *,
    length: int = LENGTH,
    doc_id: str = "doc_id",
    text: str = "text",
    shard_bytes: int = SHARD_BYTES,
    queue_bytes: int = 64 << 20,
    hot_runs: int = HOT_RUNS,
) -> DataFrame:
    """(id, print, n_bytes, spans, kept) for every row of ``docs``.

    ``print`` is the SHA-256 of the text, ``spans`` holds the removed runs in order, from ``low``
    up to ``high`` in bytes, and ``kept`` the remaining bytes, which need not be whole characters;
    it is null where nothing is removed.

    Every byte covered by a string of ``length`` bytes that also starts anywhere else in the
    table is removed; texts are judged as given. Null reads as empty; texts shorter than
    ``length`` stay whole; equal rows remove each other, also under equal ids. An empty table
    gives an empty result; other columns are ignored. ``length`` is at least 16.
    """
    base = docs.select(
        F.col(f"`{doc_id}`").alias("id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"),
    ).withColumn("print", F.unhex(F.sha2(F.col("body"), 256)))
    rows = freeze(
        with_text_columns(
            base.withColumn("n_bytes", F.octet_length("body").cast("bigint")),
            lambda: _runs(length),
            RUNS,
            text="body",
            keep=["id", "print", "n_bytes"],
        ).withColumn("row", F.monotonically_increasing_id())
    )
    runs = rows.select(
        "row", F.explode(F.arrays_zip("anchor", "content", "at", "size")).alias("r")
    ).select("row", "r.*")
    shared = freeze(
        runs.groupBy("anchor")
        .agg(
            F.count("*").alias("n"),
            (F.min("content") < F.max("content")).alias("mixed"),
        )
        .where("n > 1")
        .select("anchor", "mixed")
    )
    found = freeze(runs.join(shared, "anchor"))
    contents = freeze(
        found.where("mixed")
        .groupBy("anchor", "content")
        .agg(F.count("*").alias("n"), F.min("row").alias("first"))
    )
    heavy = contents.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > hot_runs)
    heavy = freeze(heavy.select("anchor"))
    decided = freeze(found.where("mixed").join(contents, ["anchor", "content"]))
    whole = found.where("not mixed").select("row", "at", "size").unionByName(
        decided.where("n > 1").select("row", "at", "size")
    )

    # Texts equal as a whole are removed whole, so only one of them is looked into.
    copies = freeze(
        rows.where(F.col("n_bytes") >= length).groupBy("print").agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1")
    )
    slices = decided.where("row = first").groupBy("row").agg(
        F.collect_set(F.struct("anchor", "content", "at", "size")).alias("slices")
    )
    touched = freeze(found.select("row").distinct().join(slices, "row", "left"))
    known = rows.select("row", "id", "print")
    alone = known.join(copies.select("print", F.lit(True).alias("copied")), "print", "left")
    wanted = (
        touched.join(alone, "row")
        .where("copied is null or slices is not null")
        .select("row", F.col("id").alias("wanted_id"), F.col("print").alias("wanted_print"), "slices")
        .hint("shuffle_hash")
    )
    texts = freeze(
        base.join(
            wanted,
            F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("print") == F.col("wanted_print")),
        ).select("row", F.col("body").cast("binary").alias("body"), "slices")
    )
    pieces = (
        texts.where("slices is not null")
        .select("body", F.explode("slices").alias("s"))
        .select("s.anchor", "s.content", F.expr("substring(body, s.at + 1, s.size)").alias("piece"))
    )
    usual = pieces.join(heavy, "anchor", "left_anti")
    crowded = pieces.join(heavy, "anchor", "left_semi")
    ranges = sorted_shards(usual, length, shard_bytes, queue_bytes).unionByName(
        counted_windows(crowded, length)
    )
    single = decided.where("n = 1").select("anchor", "content", "row", "at")
    parts = single.join(freeze(ranges), ["anchor", "content"]).select(
        "row",
        F.transform(
            "ranges",
            lambda r: F.struct(
                (F.col("at") + r["low"]).alias("a"), (F.col("at") + r["high"] + length).alias("b")
            ),
        ).alias("spans"),
    )
    spans = (
        whole.select("row", F.array(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("size")).alias("b"))).alias("spans"))
        .unionByName(parts)
        .groupBy("row")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )
    # Equal rows with equal ids meet here; their texts are cut once.
    cut = (
        texts.select("row", "body")
        .join(spans, "row")
        .dropDuplicates(["row"])
        .mapInArrow(_cut, f"row bigint, spans {SPANS}, kept binary")
    )
    gone = F.col("copied").isNotNull()
    everything = F.array(F.struct(F.lit(0).cast("bigint").alias("low"), F.col("n_bytes").alias("high")))
    return (
        rows.select("row", "id", "print", "n_bytes")
        .join(cut, "row", "left")
        .join(copies.select("print", F.lit(True).alias("copied")), "print", "left")
        .select(
            F.col("id").alias(doc_id),
            "print",
            "n_bytes",
            F.when(gone, everything).otherwise(F.coalesce("spans", F.array().cast(SPANS))).alias("spans"),
            F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        )
    )


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the columns ``spans`` and ``kept`` of ``cut_texts``; ``kept`` holds all
    bytes of a text that stays as it is. Columns of these names are replaced."""
    found = cut_texts(docs, doc_id=doc_id, text=text, **options)
    by_text = found.select(
        F.col(f"`{doc_id}`").alias("_cut_id"), F.col("print").alias("_cut_print"), "spans", "kept"
    ).dropDuplicates(["_cut_id", "_cut_print"])
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return (
        docs.drop("spans", "kept")
        .withColumn("_cut_body", body)
        .withColumn("_cut_own", F.unhex(F.sha2("_cut_body", 256)))
        .join(
            by_text,
            F.col(f"`{doc_id}`").eqNullSafe(F.col("_cut_id")) & (F.col("_cut_own") == F.col("_cut_print")),
        )
        .withColumn("kept", F.coalesce("kept", F.col("_cut_body").cast("binary")))
        .drop("_cut_id", "_cut_print", "_cut_own", "_cut_body")
    )


def repeated_strings(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for every row: the digest of ``cut_texts``."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["high"] - s["low"])
    return cut_texts(docs, doc_id=doc_id, **options).select(
        F.col(f"`{doc_id}`"),
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.coalesce(F.sha2("kept", 256), F.lower(F.hex("print"))).alias("kept_sha256"),
    )
