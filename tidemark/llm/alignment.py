"""Alignment of the tokens of two tokenizers over the same bytes.

A text is tokenised whole by both. The token ends of both cut its bytes into stretches, each inside
one A and one B token, so the stretches are the links; a group ends where a stretch ends tokens of
both. Texts of a block are worked through at once: the end of a text ends a group. Links are
counted over the corpus, and every document is measured against those counts.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.stage import checkpoint_dir, freeze

from .blocks import blocks, with_text_columns

TOKENIZERS = "/opt/tokenizers"
#: Without effect since nothing is looked up by window any more; an existing test still sets them.
MEMO_WINDOWS = 100_000
MEMO_TOKENS = 64
#: Id pairs that are broadcast with their counts (16 bytes each); rarer ones are joined by shuffle.
COMMON_PAIRS = 500_000
#: Bits of a B id within a pair.
PAIR_BITS = 20

# fixed value: the pattern that splits text before the merges of the byte vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

TOKENS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"


@dataclass(frozen=True)
class Files:
    """Contents of both vocabulary files: some MB, whatever the corpus."""

    byte_level: str
    pieces: bytes


def vocabulary_files(
    folder: str = TOKENIZERS, byte_level: str = "byte_bpe_50k.json", pieces: str = "piece_bpe_32k.model"
) -> Files:
    with open(os.path.join(folder, byte_level), encoding="utf-8") as a:
        vocabulary = a.read()
    with open(os.path.join(folder, pieces), "rb") as b:
        return Files(vocabulary, b.read())


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers with the bytes of their tokens: A byte-level, B pieces with byte fallback.

    A's merges follow the order of its ids, so its vocabulary serves as a table of ranks.
    """

    def __init__(self, files: Files) -> None:
        import sentencepiece
        import tiktoken

        listed = json.loads(files.byte_level)
        special = {x["content"]: x["id"] for x in listed["added_tokens"]}
        byte = _byte_of()
        ranks = {
            bytes(byte[c] for c in token): k
            for token, k in listed["model"]["vocab"].items()
            if token not in special
        }
        self._a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_proto=files.pieces)
        size = max([*ranks.values(), *special.values()]) + 1
        self.a_bytes = [b""] * size
        for token, k in ranks.items():
            self.a_bytes[k] = token
        self.b_bytes = [self._piece(k) for k in range(self._b.get_piece_size())]
        self.a_size, self.b_size = (
            np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes)
        )

    def _piece(self, k: int) -> bytes:
        piece = self._b.id_to_piece(k)
        if self._b.is_byte(k):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both over a space and the text; None if either does not give those bytes back."""
        raw = b" " + text.encode()
        a, b = self._a.encode_ordinary(" " + text), self._b.encode(text)
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw:
            return None
        if b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


def stretches(
    a: np.ndarray, b: np.ndarray, t: Tokenizers
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, whether an A token ends, whether a B token ends) of each stretch between token ends."""
    end_a, end_b = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
    ends = np.zeros(int(end_a[-1]) + 1, np.uint8)
    ends[end_a] = 1
    ends[end_b] |= 2
    at = np.flatnonzero(ends)
    kind = ends[at]
    return at, (kind & 1) > 0, kind > 1


def spelled_ids(t: Tokenizers) -> np.ndarray:
    """Each id with what follows it: A inside a group and at the end of its side, then B likewise."""
    return np.array(
        [f"{k}{mark}".encode() for mark, side in ((",", t.a_size), ("|", t.a_size), (",", t.b_size), (";", t.b_size)) for k in range(len(side))]
    )


def block_alignment(
    a: np.ndarray, b: np.ndarray, size: np.ndarray, t: Tokenizers
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(linked pairs, their border by text, groups by text, rows of ``spelled_ids`` in order of the
    groups) of the tokens of consecutive texts of ``size`` bytes."""
    at, in_a, in_b = stretches(a, b, t)
    to_a, to_b, shared = np.cumsum(in_a), np.cumsum(in_b), in_a & in_b
    pairs = a[to_a - in_a] << PAIR_BITS | b[to_b - in_b]
    border = np.append(0, np.searchsorted(at, np.cumsum(size)) + 1)
    group = np.append(0, np.cumsum(shared))
    # A tokens stand behind the B tokens of earlier groups, B tokens behind the A tokens of their own group too.
    before, through = np.append(0, to_b[shared]), to_a[shared]
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + before[group[:-1][in_a]]] = a + len(t.a_size) * shared[in_a]
    code[np.arange(len(b)) + through[group[:-1][in_b]]] = b + 2 * len(t.a_size) + len(t.b_size) * shared[in_b]
    return pairs, border, np.diff(group[border]), code


def _documents(files: Files, groups: bool):
    t = Tokenizers(files)
    spelled = spelled_ids(t)

    def columns(texts: pa.Array) -> list[pa.Array]:
        n = len(texts)
        counts = np.zeros((4, n), np.int64)
        whole = [""] * n
        keys, times, sizes = [], [], np.zeros(n, np.int64)
        for first, rows, buf, offs in blocks(texts):
            at, size, a, b = [], [], [], []
            for r in range(rows):
                raw = buf[offs[r] : offs[r + 1]].tobytes()
                tokens = t.encode(raw.decode()) if raw else None
                if tokens is not None:
                    at.append(first + r)
                    size.append(len(raw) + 1)
                    a.append(tokens[0])
                    b.append(tokens[1])
            if not at:
                continue
            n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
            pairs, border, n_groups, code = block_alignment(np.concatenate(a), np.concatenate(b), np.array(size), t)
            counts[:, at] = n_a, n_b, n_groups, np.diff(border)
            ends = np.append(0, np.cumsum(n_a + n_b)).tolist()
            border = border.tolist()
            for k, row in enumerate(at):
                text = spelled[code[ends[k] : ends[k + 1]]].tobytes().translate(None, b"\0")[:-1]
                whole[row] = text.decode() if groups else hashlib.sha256(text).hexdigest()
                pair, often = np.unique(pairs[border[k] : border[k + 1]], return_counts=True)
                keys.append(pair)
                times.append(often)
                sizes[row] = len(pair)
        offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, times)]
        pairs = [
            pa.ListArray.from_arrays(offsets, pa.array(x, kind))
            for x, kind in zip(flat, (pa.int64(), pa.int32()), strict=True)
        ]
        return [*map(pa.array, counts), pa.array(whole, pa.string()), *pairs]

    return columns


def aligned(
    docs: DataFrame,
    files: Files,
    *,
    text: str = "text",
    keep: list[str] | None = None,
    groups: bool = True,
) -> DataFrame:
    """``docs[keep]`` with n_a, n_b, n_groups, n_links, groups and the links of the text.

    ``groups`` lists the ids of each group, ``a1,a2|b1;a3|b2``; with ``groups=False`` the column
    is ``groups_sha256``, its digest, instead (empty without tokens). ``pairs`` holds the distinct
    linked id pairs (``pair_ids`` takes them apart) and ``times`` how often each occurs. A text
    that is null or empty, or that either tokenizer does not give back byte for byte, has no
    tokens: zeros and an empty string. Existing columns of these names are replaced. Texts are
    tokenised whole, whatever their length. Narrow: no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(files)
    name = "groups" if groups else "groups_sha256"
    return with_text_columns(
        docs,
        lambda: _documents(shared.value, groups),
        f"{TOKENS}, {name} string, pairs array<bigint>, times array<int>",
        text=text,
        keep=keep,
    )


def pair_ids(pair):
    """(A id, B id) columns of a pair."""
    return F.shiftright(pair, PAIR_BITS).cast("int"), pair.bitwiseAND((1 << PAIR_BITS) - 1).cast("int")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, links, best): corpus-wide links of each id pair, and whether no pair of its B id has more.

    ``links`` has pairs and times. Counting combines map-side; what is broadcast is one row per B id.
    """
    counted = freeze(
        links.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
        .groupBy(F.col("x.pairs").alias("pair"))
        .agg(F.sum("x.times").alias("links"))
        .withColumn("b", pair_ids(F.col("pair"))[1])
    )
    highest = counted.groupBy("b").agg(F.max("links").alias("highest"))
    return counted.join(F.broadcast(highest), "b").select(
        "pair", "links", (F.col("links") == F.col("highest")).alias("best")
    )


def common_from(counts: DataFrame, limit: int) -> int:
    """The least power of two such that at most ``limit`` pairs have that many links."""
    sizes = counts.groupBy(F.floor(F.log2("links")).alias("k")).count().collect()
    total, least = 0, 62
    for r in sorted(sizes, key=lambda r: -r["k"]):  # one row per power of two
        total += r["count"]
        if total > limit:
            break
        least = r["k"]
    return 1 << least


def alignment_quality(
    docs: DataFrame,
    files: Files | None = None,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    common_pairs: int = COMMON_PAIRS,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    ``n_best``: links whose corpus-wide count is the highest of their B id, ties included;
    ``count_sum``: those counts summed over the links. Null, empty and unaligned texts have
    zeros and an empty digest; equal rows and null ids stay rows of their own; an empty table
    gives an empty result; other columns are ignored. Texts are tokenised once: links are
    written to the shared folder and read twice. The ``common_pairs`` most frequent pairs at
    most are broadcast, links of all others are joined by shuffle.
    """
    spark = docs.sparkSession
    files = files or vocabulary_files()
    folder = f"{checkpoint_dir(spark)}/links-{uuid.uuid4().hex}"
    rows = aligned(docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")), files, keep=["id"], groups=False)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows.write.option("compression", "zstd").parquet(folder)
    rows = spark.read.schema(rows.schema).parquet(folder)
    counts = freeze(pair_counts(rows))
    least = common_from(counts, common_pairs)
    common = F.broadcast(counts.where(F.col("links") >= least))
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "row", F.col("x.pairs").alias("pair"), "x.times"
    )

    def measured(df: DataFrame) -> DataFrame:
        return df.groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("links")).alias("count_sum"),
        )

    parts = measured(links.join(common, "pair"))
    if least > 1:
        rest = links.join(common, "pair", "left_anti").join(counts.where(F.col("links") < least), "pair")
        parts = parts.unionByName(measured(rest)).groupBy("row").agg(
            F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
        )
    return (
        rows.drop("pairs", "times")
        .join(parts, "row", "left")
        .select(
            F.col("id").alias(doc_id),
            "n_a",
            "n_b",
            "n_groups",
            "n_links",
            F.coalesce("n_best", F.lit(0)).cast("bigint").alias("n_best"),
            F.coalesce("count_sum", F.lit(0)).cast("bigint").alias("count_sum"),
            "groups_sha256",
        )
    )
