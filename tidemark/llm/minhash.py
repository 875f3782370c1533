"""Near-duplicate groups: circulant MinHash, banding, exact Jaccard on full shingle sets.

Two permutations give the whole signature. The first scatters shingle hashes over a ring of
2**32 places; the second orders the ring, and coordinate k reads it shifted by k places.

Texts with equal shingle sets become one node. Members of a bucket are compared with its least
node; where a bucket still holds several groups of confirmed links, its members outside the
largest group are compared with all others, block against block. So each pair that shares a
bucket is either compared or already connected, and only links become rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.stage import freeze

from .blocks import (
    BLANK,
    BLOCK_BYTES,
    LOWER,
    blocks,
    mix,
    per_document,
    prefix_sums,
    span_hashes,
    with_text_columns,
    words,
)
from .components import components

FIVE_WORDS = 5
HASHES, BANDS = 128, 32
BLOCK_MEMBERS = 128


def shingle_sets(
    buf: np.ndarray, offs: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct word shingles, sorted by both.

    A text with fewer words than ``size``, but not none, is one shingle.
    """
    low = LOWER[buf]
    start, end, doc = words(low, offs, BLANK)
    word = span_hashes(prefix_sums(low), start, end)
    count = per_document(doc, len(offs) - 1)
    first = np.cumsum(count) - count

    def joined(at: np.ndarray, n: int) -> np.ndarray:
        total = np.full(len(at), n, np.uint64)
        for k in range(n):
            total = mix(total + word[at + k])
        return total

    at = np.flatnonzero(doc[size - 1 :] == doc[: len(doc) - size + 1]) if len(doc) >= size else (
        np.zeros(0, np.int64)
    )
    docs, hashes = [doc[at]], [joined(at, size)]
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        docs.append(short)
        hashes.append(joined(first[short], n))
    doc, value = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def ring_order(x: np.ndarray) -> np.ndarray:
    """The second permutation, of the 2**32 places of the ring."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def circulant_signatures(value: np.ndarray, starts: np.ndarray, hashes: int) -> np.ndarray:
    """Signature matrix (set, coordinate) of consecutive non-empty sets beginning at ``starts``."""
    place = (mix(value ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), hashes), np.uint32)
    for k in range(hashes):
        out[:, k] = np.minimum.reduceat(ring_order(place + np.uint32(k)), starts)
    return out


def _describe(size: int, hashes: int, bands: int):
    rows = hashes // bands

    def columns(texts: pa.Array) -> list[pa.Array]:
        n = len(texts)
        count = np.zeros(n, np.int64)
        print_a, print_b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        keys = []
        for first, n_docs, buf, offs in blocks(texts, BLOCK_BYTES // 2):
            doc, value = shingle_sets(buf, offs, size)
            held = per_document(doc, n_docs)
            count[first : first + n_docs] = held
            full = np.flatnonzero(held)
            if not len(full):
                continue
            starts = (np.cumsum(held) - held)[full]
            print_a[first + full] = np.add.reduceat(mix(value + np.uint64(1)), starts)
            print_b[first + full] = np.add.reduceat(mix(value ^ np.uint64(0x5851F42D4C957F2D)), starts)
            signature = circulant_signatures(value, starts, hashes).reshape(len(full), bands, rows)
            key = np.tile(np.arange(bands, dtype=np.uint64), (len(full), 1))
            for r in range(rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, :, r])
            keys.append(key.reshape(-1))
        lengths = np.where(count > 0, bands, 0)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        return [
            pa.array(count),
            pa.array(print_a.view(np.int64)),
            pa.array(print_b.view(np.int64)),
            pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()),
                pa.array(flat.view(np.int64)),
            ),
        ]

    return columns


def _sets(size: int):
    def columns(texts: pa.Array) -> list[pa.Array]:
        n = len(texts)
        print_a, print_b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        out = [b""] * n
        for first, n_docs, buf, offs in blocks(texts, BLOCK_BYTES // 2):
            doc, value = shingle_sets(buf, offs, size)
            held = per_document(doc, n_docs)
            full = np.flatnonzero(held)
            if not len(full):
                continue
            starts = (np.cumsum(held) - held)[full]
            print_a[first + full] = np.add.reduceat(mix(value + np.uint64(1)), starts)
            print_b[first + full] = np.add.reduceat(mix(value ^ np.uint64(0x5851F42D4C957F2D)), starts)
            for d, s in zip(full.tolist(), starts.tolist(), strict=True):
                out[first + d] = value[s : s + held[d]].tobytes()
        return [
            pa.array(print_a.view(np.int64)),
            pa.array(print_b.view(np.int64)),
            pa.array(out, pa.binary()),
        ]

    return columns


def confirmed_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the similarity, compared in integers."""

    def compare(batches):
        for batch in batches:
            a, b = batch.column("set_a"), batch.column("set_b")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x = np.frombuffer(a[i].as_buffer(), np.uint64)
                y = np.frombuffer(b[i].as_buffer(), np.uint64)
                if len(x) < len(y):
                    x, y = y, x
                if 100 * len(y) < percent * len(x):
                    continue
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                common = int(np.count_nonzero(x[at] == y))
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    side = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(compare, "a bigint, b bigint")


def blockwise_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` across parts among the members ``(main, node, part)`` of each ``main``.

    Members are dealt to blocks of about ``BLOCK_MEMBERS``; each pair of blocks, except two of
    the main part, is one small group that compares its sets in matrices. So no pair of texts
    becomes a row unless it is a link.
    """
    rest = F.col("part") != F.col("main")
    sizes = members.groupBy("main").agg(
        F.count_if(rest).alias("n_rest"), F.count_if(~rest).alias("n_main")
    )
    counts = freeze(
        sizes.select(
            "main",
            F.ceil(F.col("n_rest") / BLOCK_MEMBERS).cast("int").alias("blocks"),
            F.ceil(F.col("n_main") / BLOCK_MEMBERS).cast("int").alias("main_blocks"),
        )
    )
    # Blocks of the rest are 0, 1, ...; those of the main part -1, -2, ...
    own = F.expr(
        "if(part <> main, pmod(xxhash64(node), blocks), -1 - pmod(xxhash64(node), main_blocks))"
    )
    others = F.expr(
        "if(part <> main, sequence(-main_blocks, blocks - 1), sequence(0, blocks - 1))"
    )
    dealt = (
        freeze(members)
        .join(counts, "main")
        .where("blocks > 0")
        .withColumn("own", own.cast("int"))
        .withColumn("other", F.explode(others))
        .select(
            "main",
            "node",
            "part",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            (F.col("own") <= F.col("other")).alias("is_low"),
        )
    )

    def compare(table: pa.Table) -> pa.Table:
        node, part = table["node"].to_numpy(), table["part"].to_numpy()
        low = table["is_low"].to_numpy()
        alike = table["low"][0].as_py() == table["high"][0].as_py()
        left, right = np.flatnonzero(low), np.flatnonzero(low if alike else ~low)
        found_a, found_b = [], []
        if len(left) and len(right):
            values = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["set"].combine_chunks()]
            size = np.array([len(v) for v in values])
            common = common_elements([values[i] for i in left], [values[i] for i in right])
            union = size[left][:, None] + size[right][None, :] - common
            linked = (100 * common >= percent * union) & (part[left][:, None] != part[right][None, :])
            x, y = np.nonzero(linked)
            found_a, found_b = node[left[x]], node[right[y]]
        return pa.table(
            {"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())}
        )

    return (
        dealt.join(sets, "node")
        .groupBy("main", "low", "high")
        .applyInArrow(compare, "a bigint, b bigint")
        .distinct()
    )


def common_elements(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of every left with every right set, over bounded slices of elements."""
    sides = []
    for values in (left, right):
        row = np.repeat(np.arange(len(values)), [len(v) for v in values])
        sides.append((row, np.concatenate(values)))
    both = np.intersect1d(sides[0][1], sides[1][1])
    out = np.zeros((len(left), len(right)), np.float32)
    placed = []
    for row, value in sides:
        at = np.searchsorted(both, value)
        at[at == len(both)] = 0
        held = (both[at] == value) if len(both) else np.zeros(len(value), bool)
        order = np.argsort(at[held], kind="stable")
        placed.append((row[held][order], at[held][order]))
    for first in range(0, len(both), 2048):
        matrices = []
        for (row, at), n in zip(placed, (len(left), len(right)), strict=True):
            i, j = np.searchsorted(at, (first, first + 2048))
            m = np.zeros((n, min(2048, len(both) - first)), np.float32)
            m[row[i:j], at[i:j] - first] = 1
            matrices.append(m)
        out += matrices[0] @ matrices[1].T
    return out.astype(np.int64)


def text_hash(text: str = "text"):
    return F.xxhash64(F.col(f"`{text}`"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``; options as of ``groups_of_rows``.

    Words are runs of non-blank characters after lower-casing A-Z. Rows are linked when
    ``100 * intersection >= percent * union`` on their distinct shingles; component_id is the
    smallest id that links reach. With 32 bands of 4 coordinates a pair at exactly 0.8 is
    missed with probability 5e-8; every candidate is decided on the full sets.

    Null, empty and blank texts have no shingles, link with nothing and are their own
    component (null where the id is null). Repeated rows are equal sets and share a component.
    Rows whose id is null join components by their text and never name one. An empty table
    gives an empty result; other columns are ignored.
    """
    found = groups_of_rows(docs, doc_id=doc_id, **options)
    return found.select(F.col("id").alias(doc_id), "n_shingles", "component_id")


def one_of_each_group(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stand for their near-duplicate group, one of each.

    It is the row with the smallest id (null ids last), then the smallest hash of its text; of
    rows that are equal in both, one stays. Rows without a shingle are groups of their own and
    all stay. Chosen are ids with text hashes, so the documents are shuffled once by them; only
    chosen rows that are repeated are then grouped, with map-side combine.
    """
    found = groups_of_rows(docs, doc_id=doc_id, text=text, hashed=True, **options)
    found = freeze(found.select("id", "hash", "n_shingles", "group"))
    counted = found.where("n_shingles > 0").groupBy("group", "id", "hash").agg(F.count("*").alias("m"))
    first = counted.groupBy("group").agg(
        F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "hash", "m")).alias("first")
    )
    kept = freeze(
        first.select("first.id", "first.hash", "first.m")
        .unionByName(found.where("n_shingles = 0").select("id", "hash", F.lit(0).cast("bigint").alias("m")).distinct())
        .select(F.col("id").alias("_kept_id"), F.col("hash").alias("_kept_hash"), F.col("m").alias("_kept_rows"))
    )
    own = [F.col(f"`{c}`") for c in docs.columns]
    matched = docs.join(
        kept.hint("shuffle_hash"),
        F.col(f"`{doc_id}`").eqNullSafe(F.col("_kept_id")) & (text_hash(text) == F.col("_kept_hash")),
    )
    if kept.where("_kept_rows > 1").isEmpty():
        return matched.select(*own)
    once = matched.where("_kept_rows < 2").select(*own)
    repeated = matched.where("_kept_rows > 1").dropDuplicates(["_kept_id", "_kept_hash"]).select(*own)
    return once.unionByName(repeated)


def groups_of_rows(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle_words: int = FIVE_WORDS,
    percent: int = 80,
    hashes: int = HASHES,
    bands: int = BANDS,
    hashed: bool = False,
) -> DataFrame:
    """(id, n_shingles, component_id, group) for every row, and the hash of its text if asked.

    The group is the least node of the component, and null for rows without a shingle.
    """
    kept = ["id", "hash"] if hashed else ["id"]
    base = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("body"))
    rows = freeze(
        with_text_columns(
            base.withColumn("hash", text_hash("body")) if hashed else base,
            lambda: _describe(shingle_words, hashes, bands),
            "n_shingles bigint, print_a bigint, print_b bigint, bands array<bigint>",
            text="body",
            keep=kept,
        ).withColumn("row", F.monotonically_increasing_id())
    )
    nodes = freeze(
        rows.where("n_shingles > 0")
        .groupBy("print_a", "print_b")
        .agg(F.min("row").alias("node"), F.min("id").alias("id"), F.first("bands").alias("bands"))
    )
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    crowded = freeze(
        members.groupBy("bucket")
        .agg(F.min("node").alias("hub"), F.max("node").alias("top"))
        .where("hub < top")
        .select("bucket", "hub")
    )
    shared = freeze(members.join(crowded, "bucket").where("node <> hub"))
    stars = freeze(shared.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    compared = freeze(
        stars.select(F.col("a").alias("node")).union(stars.select(F.col("b"))).distinct()
    )
    wanted = nodes.join(compared, "node").select("id").distinct()
    chosen = base.join(
        wanted.withColumnRenamed("id", "wanted").hint("shuffle_hash"),
        F.col("id").eqNullSafe(F.col("wanted")),
        "left_semi",
    )
    sets = freeze(
        with_text_columns(
            chosen,
            lambda: _sets(shingle_words),
            "print_a bigint, print_b bigint, set binary",
            text="body",
            keep=[],
        )
        .join(nodes.join(compared, "node").select("print_a", "print_b", "node"), ["print_a", "print_b"])
        .groupBy("node")
        .agg(F.first("set").alias("set"))
    )
    links = freeze(confirmed_links(stars, sets, percent))
    groups = freeze(components(links))

    tagged = freeze(
        shared.join(groups, "node", "left").select(
            "bucket", "hub", "node", F.coalesce("root", "node").alias("part")
        )
    )
    parts = tagged.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    mixed = freeze(
        parts.groupBy("bucket")
        .agg(F.count("*").alias("parts"), F.max_by("part", F.struct("n", "part")).alias("main"))
        .where("parts > 1")
        .select("bucket", "main")
    )
    unlike = freeze(tagged.join(mixed, "bucket").select("main", "node", "part").distinct())
    more = freeze(blockwise_links(unlike, sets, percent))
    joined = groups.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    groups = freeze(components(joined.unionByName(more)))

    least = freeze(
        groups.join(nodes.select("node", "id"), "node")
        .groupBy("root")
        .agg(F.min("id").alias("component_id"))
    )
    named = groups.join(least, "root").select("node", "root", "component_id")
    final = freeze(
        nodes.join(named, "node", "left").select(
            "print_a",
            "print_b",
            F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
            F.coalesce("root", "node").alias("group"),
        )
    )
    full = rows.where("n_shingles > 0").select(*kept, "n_shingles", "print_a", "print_b")
    empty = rows.where("n_shingles = 0").select(
        *kept, "n_shingles", F.col("id").alias("component_id"), F.lit(None).cast("bigint").alias("group")
    )
    return (
        full.join(final, ["print_a", "print_b"])
        .select(*kept, "n_shingles", "component_id", "group")
        .unionByName(empty)
    )
