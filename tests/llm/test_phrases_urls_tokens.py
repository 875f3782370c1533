"""Token alignment, phrase collocations and URL filters against plain versions, on odd rows and
on the smallest generated tables."""

import hashlib
import math
import random
import re
import sys
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import alignment, collocations, queries, urls

SF = "/root/testdata/sf0.001"
FIELDS = "doc_id bigint, text string, lang string, groups string, pairs string, row string, rank string, phrase string, score string"
LONG = " ".join(f"w{k % 997}x{k % 13}" for k in range(30_000))
TEXTS = [
    None, "", " ", "a", "the cat sat on the mat", "the cat sat on the mat", LONG, "x" * 70_000,
    "  two  blanks\n\n\tand tabs ", "été ça 漢字 🙂 ▁ mark", "<s> <|endoftext|> <0x0A> </s>", "naïve café's don't",
    "a\x00b", "The Cat SAT", " leading",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (None if k == 3 else k, t, [None, "en", "de", "und"][k % 4], "x", "x", "x", "x", "x", "x")
        for k, t in enumerate(TEXTS)
    ]
    return spark.createDataFrame([*rows, rows[4]], FIELDS)


# --- alignment ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers(alignment.vocabulary_files())


def plain_encodings(text):
    """Ids by the two libraries as their files are meant to be read, with token bytes."""
    import os

    import sentencepiece
    from tokenizers import Tokenizer

    folder = alignment.TOKENIZERS
    a = Tokenizer.from_file(os.path.join(folder, "byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, "piece_bpe_32k.model"))
    ids = a.encode(" " + text, add_special_tokens=False).ids
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [k for k in range(256) if k not in keep]
    byte = {chr(k): k for k in keep} | {chr(256 + k): x for k, x in enumerate(rest)}
    left = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        hexed = re.fullmatch(r"<0x(..)>", piece) if b.is_byte(i) else None
        right.append((i, bytes([int(hexed[1], 16)]) if hexed else piece.replace("▁", " ").encode()))
    return left, right


def plain_alignment(text):
    """(a ids, b ids, groups, links) by testing every pair of a group for overlap."""
    if not text:
        return [], [], [], []
    left, right = plain_encodings(text)
    raw = b" " + text.encode()
    if b"".join(x for _, x in left) != raw or b"".join(x for _, x in right) != raw:
        return [], [], [], []
    spans = []
    for side in (left, right):
        end, out = 0, []
        for i, x in side:
            out.append((i, end, end + len(x)))
            end += len(x)
        spans.append(out)
    shared = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
    groups, links, low = [], [], 0
    for high in shared:
        a, b = ([t for t in side if low <= t[1] and t[2] <= high] for side in spans)
        groups.append((tuple(t[0] for t in a), tuple(t[0] for t in b)))
        links += [(x[0], y[0]) for x in a for y in b if max(x[1], y[1]) < min(x[2], y[2])]
        low = high
    return [t[0] for t in spans[0]], [t[0] for t in spans[1]], groups, links


def spelled(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


SHORT = [t for t in TEXTS if t is None or len(t) < 1000]


@pytest.mark.parametrize("text", SHORT[2:])
def test_aligned_text_equals_all_pairs(tokenizers, text):
    columns = alignment._documents(alignment.vocabulary_files(), True)(pa.array([text]))
    n_a, n_b, n_groups, n_links, groups, pairs, times = (c.to_pylist()[0] for c in columns)
    a, b, plain, links = plain_alignment(text)
    assert (n_a, n_b, n_groups, n_links) == (len(a), len(b), len(plain), len(links))
    assert groups == spelled(plain)
    got = Counter()
    for p, n in zip(pairs, times, strict=True):
        got[p >> alignment.PAIR_BITS, p & ((1 << alignment.PAIR_BITS) - 1)] += n
    assert got == Counter(links)


def test_windows_without_a_blank_and_a_small_memo(monkeypatch, tokenizers):
    texts = ["ab" * 3000 + " end", LONG[:5000], LONG[:5000]]
    whole = alignment._documents(alignment.vocabulary_files(), False)(pa.array(texts))
    monkeypatch.setattr(alignment, "MEMO_WINDOWS", 5)
    monkeypatch.setattr(alignment, "MEMO_TOKENS", 3)
    assert [c.to_pylist() for c in whole] == [
        c.to_pylist() for c in alignment._documents(alignment.vocabulary_files(), False)(pa.array(texts))
    ]


def test_no_python_step_for_each_window():
    """Calls made over a text do not grow with its words."""
    columns, calls = alignment._documents(alignment.vocabulary_files(), False), []
    for text in (LONG[:5000], LONG):
        own = []
        sys.setprofile(lambda frame, event, arg, own=own: own.append(event))
        try:
            columns(pa.array([text]))
        finally:
            sys.setprofile(None)
        calls.append(len(own))
    assert calls[1] < calls[0] + 200


def test_texts_of_a_block_equal_texts_alone():
    texts = [*TEXTS, "a", "a", "ab" * 3000, *TEXTS[::-1]]
    columns = alignment._documents(alignment.vocabulary_files(), True)
    alone = [[c.to_pylist()[0] for c in columns(pa.array([t], pa.string()))] for t in texts]
    assert [list(x) for x in zip(*(c.to_pylist() for c in columns(pa.array(texts))), strict=True)] == alone


@pytest.mark.parametrize("common", [500_000, 3])
def test_alignment_quality_equals_plain_counts(odd, common):
    docs = odd.where("text is null or length(text) < 1000")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    plain = [(i, plain_alignment(t)) for i, t in rows]
    count = Counter(x for _, p in plain for x in p[3])
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    wanted = sorted(
        (
            str(i), len(a), len(b), len(g), len(k), sum(count[x] == best[x[1]] for x in k),
            sum(count[x] for x in k), hashlib.sha256(spelled(g).encode()).hexdigest() if a else "",
        )
        for i, (a, b, g, k) in plain
    )
    got = alignment.alignment_quality(docs, common_pairs=common).collect()
    assert sorted((str(r[0]), *list(r)[1:]) for r in got) == wanted


def test_alignment_of_empty_table_and_kept_columns(odd):
    assert alignment.alignment_quality(odd.where("1 = 0")).count() == 0
    out = alignment.aligned(odd.where("doc_id = 4"), alignment.vocabulary_files())
    assert out.columns[:3] == ["doc_id", "text", "lang"] and len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    assert len(rows) == 2 and all("|" in r["groups"] and r["row"] == "x" for r in rows)


# --- collocations -------------------------------------------------------------------------


def plain_phrases(rows, support, top, longest=4):
    f, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                for k in range(len(words) - n + 1):
                    key = lang, tuple(words[k : k + n])
                    f[key] = f.get(key, 0) + 1
    found = []
    often = {k: n for k, n in f.items() if n >= support and len(k[1]) > 1}
    for (lang, words), a in often.items():
        if any(
            o == lang and len(w) > len(words) and 100 * n >= 80 * a
            and any(w[k : k + len(words)] == words for k in range(len(w)))
            for (o, w), n in often.items()
        ):
            continue
        cuts = [(2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], score))
    out = []
    for lang in {x[0] for x in found}:
        own = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[5], -x[2], x[1].encode()))
        out += [(lang, r, p, a, l, m, total[lang], s) for r, (_, p, a, l, m, s) in enumerate(own[:top], 1)]
    return sorted(out)


def phrase_rows(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


@pytest.mark.parametrize("bits,slack", [(26, 0.5), (17, 0.5), (26, 8.0)])
def test_phrases_equal_plain_counts(spark, bits, slack):
    """Also with so few cells that phrases share them, and with a sample that proposes nothing,
    so that every phrase has to come from failures of the border."""
    rng = random.Random(9)
    words = ["the", "The", "cat", "sät", "on", "mat", "en", "a"]
    rows = [
        (rng.choice(["en", "en", "de", None, "und"]),
         "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n"]) for _ in range(rng.randint(0, 40))))
        for _ in range(150)
    ]
    rows += [("en", "new york city hall " * 9), ("en", None), ("de", ""), ("en", "one two three four. " * 7)] * 2
    mining = collocations.Mining(support=6, slack=slack)
    got = collocations.collocations(phrase_rows(spark, rows), top=30, mining=mining, bits=bits)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, 6, 30)


def test_ranges_of_a_small_shuffle_stay_apart(spark):
    """An array of a range takes 512 KB, so a task must not meet all 1,024 ranges."""
    ranges = collocations.dealt(spark.range(1024).select(F.col("id").cast("int").alias("part")))
    tasks = ranges.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == 1024 and max(r["count"] for r in tasks) <= 64


def test_phrases_on_odd_rows(odd, spark):
    mining = collocations.Mining(support=2)
    short = odd.where("text is null or length(text) < 1000")
    got = collocations.collocations(short, mining=mining, top=50).collect()
    rows = [(r["lang"], r["text"]) for r in short.collect()]
    assert sorted(tuple(r) for r in got) == plain_phrases(rows, 2, 50)
    none = collocations.collocations(odd.where("1 = 0"))
    assert none.count() == 0 and none.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    # A language named like its own word must not share that word's key.
    same = [("en", "en en en"), ("es", "es es es en en")] * 3
    got = collocations.collocations(phrase_rows(spark, same), mining=mining, top=50).collect()
    assert sorted(tuple(r) for r in got) == plain_phrases(same, 2, 50)


# --- urls ---------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://A.Example.COM/en/x", "https://www.example.com/en/", "http://example.com/en/",
    "http://notexample.com/en/1", "http://x.net/es/1?a=1&b=2", "http://net/fr/", "http://net", "http://x.net?/es/",
    "http://x.org/fr/9#top", "ftp://first://second.com/", "http://ünï.com/é\n?x", "http://com/" + "a" * 50_000,
    "http://b.net/en/7", "://com/", "http://EXAMPLE.com/EN/",
]


def plain_rule(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, rule in urls.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules_equal_plain_rules(spark):
    df = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)], "page_id bigint, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.with_rules(df).collect()}
    assert got == {k: plain_rule(u) for k, u in enumerate(URLS)}


def test_lexical_features_equal_plain_ones(spark):
    columns = dict(zip(urls.LEXICAL, urls._lexical(pa.array(URLS)), strict=True))
    for k, url in enumerate(URLS):
        raw = (url or "").encode()
        share = lambda pattern: len(re.findall(pattern, raw)) / max(1, len(raw))  # noqa: B023, E731
        counts = Counter(raw)
        wanted = {
            "url_bytes": len(raw),
            "digit_ratio": share(rb"[0-9]"),
            "letter_ratio": share(rb"[A-Za-z]"),
            "entropy": -sum(n / len(raw) * math.log2(n / len(raw)) for n in counts.values()),
            "depth": raw.count(b"/"),
            "parameters": raw.count(b"="),
            "fragment": float(b"#" in raw),
        }
        for name, value in wanted.items():
            assert columns[name][k].as_py() == pytest.approx(value), (name, url)


def test_listed_rules_decide_before_the_trees(spark):
    rows = [(k, u, "x", "x") for k, u in enumerate(URLS)] + [(4, URLS[4], "x", "x"), (None, URLS[9], "x", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string, score string")
    out = urls.filtered_urls(df)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict", "score"] and out.count() == len(rows)
    for r in out.collect():
        host, path, rule, verdict = plain_rule(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))
    assert urls.filtered_urls(df.where("1 = 0")).count() == 0
    none = urls.filtered_urls(df, df.select("url", F.lit(None).cast("int").alias("y")), rules=())
    assert {r["verdict"] for r in none.collect()} == {"allow"}
    one = urls.filtered_urls(df, df.select("url", F.lit(1).alias("y")), rules=())
    assert {r["verdict"] for r in one.collect()} == {"block"}


def test_trees_learn_labelled_urls(spark):
    """Held-out accuracy where long numeric paths with parameters are to be blocked, a tenth at odds."""
    rng = random.Random(3)
    rows = []
    for k in range(1200):
        bad = rng.random() < 0.4
        tail = "".join(rng.choice("0123456789" if bad else "abcdefgh") for _ in range(rng.randint(4, 12)))
        extra = f"?id={rng.randint(1, 99)}&s={rng.randint(1, 99)}" if bad and rng.random() < 0.7 else ""
        url = f"http://{rng.choice('abc')}{k}.{rng.choice(['org', 'io'])}/{tail}{extra}"
        rows.append((url, int(bad) if rng.random() > 0.1 else 1 - int(bad), int(bad)))
    df = spark.createDataFrame(rows, "url string, y int, truth int")
    out = urls.filtered_urls(df.where("crc32(url) % 2 = 0"), df.where("crc32(url) % 2 = 1"), rules=())
    right = out.where((F.col("verdict") == "block") == (F.col("truth") == 1)).count()
    assert right / out.count() > 0.9


def test_url_query_covers_every_page(spark):
    pages = queries.table(spark, SF, "pages")
    out = queries.op13_url_filter(spark, SF)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"] and out.count() == pages.count()
    assert {r["verdict"] for r in out.select("verdict").distinct().collect()} <= {"allow", "block"}
