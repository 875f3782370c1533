"""URL filters: listed rules by host and path, gradient-boosted trees for all other URLs.

The trees see lexical features alone: lengths, depths, digits, entropy, parameters, and how often
labelled URLs with the same host suffix or path suffix are blocked.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.stage import freeze

from .blocks import blocks, with_text_columns

# fixed values: the rules of the contract, (verdict, host and path)
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: The bound on labelled URLs that are read for training.
SAMPLE = 20_000
#: Hash buckets of suffixes: with three kinds of suffix, the table of statistics has at most
#: three times as many rows, whatever the number of hosts.
BUCKETS = 1 << 16
#: Labelled URLs that the overall share of blocked ones counts for in a suffix's share.
PRIOR = 10.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case
    (A-Z); then what follows up to ``?``, ``#`` or the end. Without ``://`` both are empty."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    behind = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(behind, r"^[^?#]*", 0)


def with_rules(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, *, url: str = "url"
) -> DataFrame:
    """``pages`` with host, path, and rule and verdict of the longest rule that fits, else null.

    A rule ``host/path`` fits its host and all subdomains where the path starts with its own.
    Rules are a configured list and become one chain of conditions, longest first; of equally
    long ones the longer host comes first. Existing columns of the four names are replaced.
    """
    taken = ("host", "path", "rule", "verdict")
    host, path = host_and_path(F.col(f"`{url}`"))
    parted = pages.select(
        *[F.col(f"`{c}`") for c in pages.columns if c not in taken], host.alias("host"), path.alias("path")
    )
    order = sorted(rules, key=lambda r: (-len(r[1]), r[1].index("/") * -1, r[1]))

    def first(value) -> Column:
        out = F.lit(None).cast("string")
        for verdict, rule in reversed(order):
            name, _, rest = rule.partition("/")
            fits = (F.col("host") == name) | F.col("host").endswith(f".{name}")
            out = F.when(fits & F.col("path").startswith(f"/{rest}"), value(verdict, rule)).otherwise(out)
        return out

    return parted.withColumns(
        {"rule": first(lambda _, rule: F.lit(rule)), "verdict": first(lambda verdict, _: F.lit(verdict))}
    )


LEXICAL = (
    "url_bytes", "host_bytes", "path_bytes", "host_labels", "depth", "digit_ratio", "letter_ratio",
    "symbol_ratio", "entropy", "longest_run", "parameters", "fragment", "secure",
)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _lexical(texts: pa.Array) -> list[pa.Array]:
    """Features of (url) bytes, of one block of URLs at a time; all in one pass over the bytes."""
    out = np.zeros((len(LEXICAL), len(texts)))
    for first, n, buf, offs in blocks(texts):
        size = np.diff(offs)
        doc = np.repeat(np.arange(n), size)
        share = lambda mask: np.bincount(doc, mask[buf], n) / np.maximum(size, 1)
        # Entropy over the bytes that occur: sorted (url, byte) pairs, one run per byte.
        pair = np.sort(doc << 8 | buf)
        new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, int)
        p = np.diff(np.append(new, len(pair))) / size[pair[new] >> 8]
        entropy = np.bincount(pair[new] >> 8, -p * np.log2(p), n)
        letter, digit = share(_LETTER), share(_DIGIT)
        # The longest run of letters and digits.
        edge = np.concatenate([offs[:-1][size > 0], np.flatnonzero(~(_LETTER | _DIGIT)[buf]), [len(buf)]])
        edge = np.unique(edge)
        run = np.zeros(n)
        if len(buf):
            np.maximum.at(run, doc[edge[:-1]], np.diff(edge))
        out[0, first : first + n] = size
        out[5, first : first + n], out[6, first : first + n] = digit, letter
        out[7, first : first + n] = (size > 0) * (1 - letter - digit)
        out[8, first : first + n], out[9, first : first + n] = entropy, run
        for k, mark in ((4, b"/"), (10, b"=")):
            out[k, first : first + n] = np.bincount(doc, buf == mark[0], n)
        out[11, first : first + n] = np.bincount(doc, buf == ord("#"), n) > 0
    return [pa.array(x) for x in out]


def suffixes(host: Column, path: Column) -> list[Column]:
    """Buckets of the last host label, of the last two, and of the ending of the last path segment."""
    last = F.regexp_extract(path, r"(\.[^./]{1,8})$", 1)
    texts = (F.substring_index(host, ".", -1), F.substring_index(host, ".", -2), last)
    return [F.pmod(F.xxhash64(F.lit(k), t), F.lit(BUCKETS)).cast("int") for k, t in enumerate(texts)]


def with_features(urls: DataFrame) -> DataFrame:
    """``urls`` (with host and path) and the lexical columns and suffix buckets; null reads as empty."""
    lexical = with_text_columns(
        urls, lambda: _lexical, ", ".join(f"{c} double" for c in LEXICAL), text="url"
    )
    known = F.coalesce(F.col("url"), F.lit(""))
    return lexical.withColumns(
        {
            "host_bytes": F.octet_length("host").cast("double"),
            "path_bytes": F.octet_length("path").cast("double"),
            "host_labels": (F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))).cast("double"),
            "secure": known.startswith("https://").cast("double"),
            **{f"suffix{k}": c for k, c in enumerate(suffixes(F.col("host"), F.col("path")))},
        }
    )


SHARES = [f"{what}{k}" for k in range(3) for what in ("share", "seen")]


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """(kind, bucket, n, blocked): labelled URLs by suffix bucket, all of them, combined map-side."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"suffix{k}").alias("bucket")) for k in range(3)]))
    return labelled.select(each.alias("s"), "y").groupBy("s.kind", "s.bucket").agg(
        F.count("*").alias("n"), F.sum("y").alias("blocked")
    )


def with_shares(urls: DataFrame, statistics: DataFrame, overall: float) -> DataFrame:
    """Smoothed share of blocked URLs and (logarithmic) number of URLs of each suffix."""
    out = urls
    for k in range(3):
        table = statistics.where(F.col("kind") == k).select(
            F.col("bucket").alias(f"suffix{k}"), F.col("n").alias("_n"), F.col("blocked").alias("_blocked")
        )
        n, blocked = F.coalesce("_n", F.lit(0)), F.coalesce("_blocked", F.lit(0))
        out = out.join(F.broadcast(table), f"suffix{k}", "left").withColumns(
            {
                f"share{k}": (blocked + PRIOR * overall) / (n + PRIOR),
                f"seen{k}": F.log1p(n.cast("double")),
            }
        ).drop("_n", "_blocked")
    return out


class UrlModel:
    """Trees over the lexical features with the suffix statistics they were fitted on."""

    def __init__(self, trees: Model | None, statistics: DataFrame | None, overall: float) -> None:
        self.trees, self.statistics, self.overall = trees, statistics, overall

    def score(self, urls: DataFrame) -> DataFrame:
        """``urls`` (url, host, path and more) with ``score``, the probability of a block."""
        if self.trees is None:
            return urls.withColumn("score", F.lit(self.overall))
        known = with_shares(with_features(urls), self.statistics, self.overall)
        scored = self.trees.transform(_assembler().transform(known))
        return scored.select(*urls.columns, vector_to_array("probability")[1].alias("score"))


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=[*LEXICAL, *SHARES], outputCol="features")


def fit_urls(labelled: DataFrame, *, limit: int = SAMPLE) -> UrlModel:
    """Trees fitted on labelled URLs: ``url``, ``host``, ``path`` and ``y`` (1: block).

    The trees are fitted on one half of them, at most ``limit``, the first by a digest of the url;
    suffixes are counted on the other half for that, so that no label stands in its own features,
    and over all of them for scoring. Neither row order nor repeated rows matter. A single class
    gives its constant, no labelled URL gives ``allow``.
    """
    rows = freeze(with_features(labelled.where("y is not null").dropDuplicates(["url", "y"])))
    total = rows.agg(F.count("*").alias("n"), F.sum("y").alias("blocked")).first()
    if not total["n"] or total["blocked"] in (0, total["n"]):
        return UrlModel(None, None, float(total["n"] and total["blocked"] / total["n"]))
    overall = total["blocked"] / total["n"]
    statistics = freeze(suffix_statistics(rows))
    counting = F.crc32(F.coalesce("url", F.lit(""))) % 2 == 0
    apart = freeze(suffix_statistics(rows.where(counting)))
    chosen = rows.where(~counting).orderBy(F.md5("url"), "y").limit(limit)
    sample = freeze(with_shares(chosen, apart, overall).select(*LEXICAL, *SHARES, F.col("y").cast("double")))
    ends = sample.agg(F.min("y"), F.max("y")).first()
    if ends[0] == ends[1]:
        return UrlModel(None, None, overall)
    trees = GBTClassifier(
        labelCol="y", maxIter=20, maxDepth=4, stepSize=0.2, minInstancesPerNode=5, seed=13, maxBins=32
    ).fit(_assembler().transform(sample))
    return UrlModel(trees, statistics, overall)


def filtered_urls(
    pages: DataFrame,
    labelled: DataFrame | None = None,
    rules: Sequence[tuple[str, str]] = RULES,
    *,
    url: str = "url",
    limit: int = SAMPLE,
    block_at: float = 0.5,
) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score.

    The longest rule that fits decides; else the trees do: ``block`` from ``block_at`` on. They are
    fitted on ``labelled`` (url, y), by default on the URLs of ``pages`` that a rule decides. Null
    URLs and those without ``://`` have an empty host and path and are scored like any other; equal
    URLs have equal verdicts; an empty table gives an empty result; columns that bear one of the
    five names are replaced. The URLs are not shuffled: only labelled ones are, for training.
    """
    added = ("host", "path", "rule", "verdict", "score")
    kept = [c for c in pages.columns if c not in added]
    ruled = with_rules(pages.select(*[F.col(f"`{c}`") for c in kept]), rules, url=url)
    if labelled is None:
        labelled = ruled.where("rule is not null").select(
            F.col(f"`{url}`").alias("url"), "host", "path", (F.col("verdict") == "block").cast("int").alias("y")
        )
    else:
        labelled = with_rules(labelled.select("url", "y"), ()).select("url", "host", "path", "y")
    model = fit_urls(labelled, limit=limit)
    own = {c: f"_own_{c}" for c in kept}
    scored = model.score(
        ruled.withColumnsRenamed(own).withColumn("url", F.col(f"`_own_{url}`").cast("string"))
    )
    verdict = F.coalesce("verdict", F.when(F.col("score") >= block_at, "block").otherwise("allow"))
    return scored.select(
        *[F.col(f"`_own_{c}`").alias(c) for c in kept], "host", "path", "rule", verdict.alias("verdict"), "score"
    )


def url_digest(pages: DataFrame) -> DataFrame:
    """One row per page: host, path, deciding rule and verdict."""
    return filtered_urls(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
