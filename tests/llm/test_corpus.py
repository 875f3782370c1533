"""Corpus operators against plain versions, on odd rows and on the smallest generated tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import (
    decontaminate,
    induced,
    langid,
    minhash,
    mixing,
    nbsvm,
    pii,
    queries,
    rules,
    sharding,
    suffix_dedup,
    toxicity,
)
from tidemark.llm.components import components
from tidemark.llm.sql import ORACLE
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
FIELDS = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, "
    "shard string, id string, row string, items string, rate string"
)
LONG = " ".join(f"w{k % 997}x{k % 13}" for k in range(30_000))
SAME = "one two three four five six seven eight nine ten eleven twelve"
TEXTS = [
    None, "", "   \n\t", "a", SAME, SAME, SAME + " thirteen", SAME.upper(), LONG, LONG + " end",
    "été ça übung ñandú 漢字 🙂", "mail ann@example.org or +1 555 010 7788, host 10.0.0.256 and 10.0.0.25",
    "card 4111 1111 1111 1111 and 4111 1111 1111 1112", "!!! *** $$$", " \u0085　",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (None if k == 3 else k, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else f"s{k % 2}",
         None, "x", "x", "x", "x", "x", "x")
        for k, t in enumerate(TEXTS)
    ]
    return spark.createDataFrame(rows + [rows[4]], FIELDS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], FIELDS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(k, k % 2, (k + 1) % 2) for k in range(len(TEXTS))] + [(None, 1, None), (99, None, 1)],
        "doc_id bigint, quality int, toxic int",
    )


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, SAME), (2, "nothing of this kind stands in any of the texts given here"), (3, None),
         (4, "?!"), (5, "Seven eight"), (5, "eleven TWELVE")],
        "item_id bigint, text string",
    )


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), ORACLE[name]) is None


# --- decontamination ----------------------------------------------------------------------


def plain_hits(doc, listed, window):
    hit, names = set(), set()
    for name, words in listed:
        span = min(window, len(words))
        for k in range(len(words) - span + 1):
            for p in range(len(doc) - span + 1):
                if span and doc[p : p + span] == words[k : k + span]:
                    hit.update(range(p, p + span))
                    names.add(name)
    return hit, names


def test_automaton_equals_plain_search():
    rng = random.Random(4)
    for _ in range(400):
        letters = [b"a", b"b", b"c"][: rng.choice([2, 3])]
        listed = [
            (str(k), [rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 12]))])
            for k in range(rng.randint(1, 4))
        ]
        doc = [rng.choice([*letters, b"z"]) for _ in range(rng.randint(0, 30))]
        spans, names, _ = decontaminate.Automaton(listed, 3).scan(doc)
        assert ({i for a, b in spans for i in range(a, b)}, names) == plain_hits(doc, listed, 3)


@pytest.mark.parametrize("block_words", [100_000, 3])
def test_items_in_blocks_give_the_same_hits(odd, items, block_words):
    found = decontaminate.match_items(odd, items, keep=["doc_id", "text"], block_words=block_words)
    listed = [
        (str(r["item_id"]), decontaminate.item_words(r["text"].encode()))
        for r in items.collect() if r["text"]
    ]
    for r in found.withColumn("n_hit", decontaminate.hits()).collect():
        words = decontaminate.item_words((r["text"] or "").encode())
        hit, names = plain_hits(words, listed, 10)
        assert (r["n_words"], r["n_hit"], set(r["items"])) == (len(words), len(hit), names)


def test_passages_are_cut_or_documents_go(odd, items, none):
    kept = decontaminate.decontaminated(odd, items)
    assert kept.schema.simpleString() == odd.schema.simpleString()
    assert {r["items"] for r in kept.collect()} == {"x"}
    assert {r["doc_id"] for r in kept.collect()}.isdisjoint({4, 5, 6, 7})
    cut = decontaminate.decontaminated(odd, items, max_coverage=0.95).where("doc_id = 6").collect()
    assert [r["text"] for r in cut] == [" thirteen"] and cut[0]["n_chars"] == 9
    assert decontaminate.decontaminated(none, items).count() == 0


# --- near duplicates ----------------------------------------------------------------------


def plain_components(rows, size, percent):
    sets = {}
    for k, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
        sets[k] = set(grams) if grams else ({tuple(words)} if words else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_plain_components(spark, size):
    docs = queries.table(spark, SF, "documents")
    expected = plain_components([tuple(r) for r in docs.select("doc_id", "text").collect()], size, 80)
    found = minhash.near_duplicates(docs, shingle_words=size).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == expected


def test_members_unlike_their_hub_are_still_compared(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    rows = [(0, " ".join(base))]
    for k in range(1, 70):
        words = list(base)
        for _ in range(k % 9):
            words[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = minhash.near_duplicates(docs, shingle_words=2).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == plain_components(rows, 2, 80)


def test_odd_rows_of_near_duplicates(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert found[0] == (0, 0) and found[1] == (0, 1) and found[2] == (0, 2)
    assert found[5][1] == found[7][1] == found[6][1] == 4 and found[9][1] == 8
    assert found[None] == (1, None)
    assert minhash.near_duplicates(none).count() == 0


def test_one_row_of_each_group_stays(spark, odd, none):
    other, third = (" ".join(f"{c}{k}" for k in range(40)) for c in "xy")
    rows = [
        (None, ""), (None, ""), (None, None), (5, ""), (5, ""),  # empty texts: all stay
        (None, third), (None, third), (None, third + " end"),  # a group without any id
        (3, SAME), (3, SAME), (None, SAME), (4, SAME),  # repeated row, null id, larger id
        (7, other), (3, other + " end"), (9, other),  # the id 3 again, for another group
        (4, "alone " + LONG[:400]), (None, "quite alone"),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, m string")
    out = corpus_pipeline.near_dedup(spark, docs.repartition(3), SF)
    assert out.columns == docs.columns
    stay = [(r["doc_id"], r["text"]) for r in out.collect()]
    third_kept = [r for r in stay if r[0] is None and r[1] and r[1].startswith(third)]
    assert len(third_kept) == 1
    expected = [*rows[:5], third_kept[0], rows[8], rows[13], *rows[15:]]
    assert Counter(stay) == Counter(expected)
    assert corpus_pipeline.near_dedup(spark, odd, SF).columns == odd.columns
    assert corpus_pipeline.near_dedup(spark, none, SF).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    found = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in found} == {
        **{k: 0 for k in range(31)}, **{k: 100 for k in range(100, 140)}
    }


# --- suffix dedup -------------------------------------------------------------------------


def test_induced_sorting_with_and_without_disk():
    rng = random.Random(1)
    for _ in range(200):
        text = [rng.randint(1, rng.choice([2, 3, 6])) for _ in range(rng.randint(1, 60))] + [0]
        order = induced.suffix_array(np.array(text), 1000, rng.choice([16, 1 << 20])).tolist()
        assert order == sorted(range(len(text)), key=lambda i: text[i:])


def test_doubled_ranks_equal_plain_sorting():
    rng = random.Random(2)
    for _ in range(200):
        n, depth = rng.randint(1, 80), rng.choice([1, 2, 3, 7, 100])
        rank = [rng.randint(0, rng.choice([1, 3, 40])) for _ in range(n)]
        order = induced._doubled(np.array(rank), depth).tolist()
        first = [rank[k : k + depth] for k in order]
        assert sorted(order) == list(range(n)) and first == sorted(first)


def test_neighbours_that_reach_are_read_once_a_stretch():
    rng = random.Random(3)
    for _ in range(300):
        length = rng.randint(1, 20)
        base = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60)))
        data = base + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 9))) + base[rng.randint(0, len(base)) :]
        order = sorted(range(len(data) - length + 1), key=lambda k: data[k : k + length])
        found = induced.reaching_neighbours(np.frombuffer(data, np.uint8), np.array(order, int), length)
        seen = Counter(data[k : k + length] for k in order)
        assert sorted(set(found.tolist())) == sorted(k for k in order if seen[data[k : k + length]] > 1)
    # A long repeat is one stretch: its 400-byte windows are not read one by one.
    data = bytes(rng.choice(b"abcd") for _ in range(3000)) * 2
    order = np.array(sorted(range(len(data) - 399), key=lambda k: data[k : k + 400]))
    compared = []
    prefix, induced.common_prefix = induced.common_prefix, lambda d, a, b, n: compared.append(len(a)) or prefix(d, a, b, n)
    try:
        assert len(set(induced.reaching_neighbours(np.frombuffer(data, np.uint8), order, 400).tolist())) == 2 * 2601
    finally:
        induced.common_prefix = prefix
    assert sum(compared) < 0.6 * len(order)


def plain_cut(rows, length):
    seen = Counter(x[k : k + length] for _, x in rows for k in range(len(x) - length + 1))
    out = []
    for key, x in rows:
        covered = np.zeros(len(x) + 1, bool)
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                covered[k : k + length] = True
        kept = bytes(b for b, c in zip(x, covered, strict=False) if not c)
        spans = int((covered[:-1] > np.append(False, covered[:-2])).sum()) if len(x) else 0
        out.append((key, len(x), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"hot_runs": 1}, {"shard_bytes": 500, "queue_bytes": 64}])
def test_repeated_strings_equal_plain_cut(spark, options):
    rng = random.Random(6)
    base = bytes(rng.choice(b"abcd ") for _ in range(900)).decode()
    rows = [(k, base[(a := rng.randint(0, 700)) : a + rng.randint(0, 200)]) for k in range(40)]
    rows += [(50, "ab" * 90), (51, ""), (52, rows[3][1]), (52, rows[3][1]), (53, "é" * 40 + base[100:180])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = suffix_dedup.repeated_strings(docs, length=40, **options).collect()
    expected = plain_cut([(k, t.encode()) for k, t in rows], 40)
    assert sorted((tuple(r) for r in found), key=str) == expected


def test_cut_texts_are_returned_whole(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    long, short = text(60), text(15)
    rows = [(1, text(50) + long + text(20) + short), (2, long + text(30)), (None, short + text(70)), (4, None), (4, "")]
    rows += [(5, long + "x" * 90), (None, rows[0][1][:30]), (7, text(80)), (7, text(80))]
    rows += [(8, rows[-1][1] + "z"), (9, rows[1][1]), (9, rows[1][1])]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id bigint, text string, n int")
    found = suffix_dedup.without_repeats(docs, length=40).collect()
    assert sorted(r["n"] for r in found) == list(range(len(rows)))
    plain = plain_cut([(r["n"], (r["text"] or "").encode()) for r in found], 40)
    for r, (_, size, removed, spans, digest) in zip(sorted(found, key=lambda r: str(r["n"])), plain, strict=True):
        body, last = (r["text"] or "").encode(), 0
        kept = b""
        for s in r["spans"]:
            kept, last = kept + body[last : s["low"]], s["high"]
        assert (r["doc_id"], r["text"]) == rows[r["n"]] and r["kept"] == kept + body[last:]
        assert len(body) == size and len(r["kept"]) == size - removed and len(r["spans"]) == spans
        assert hashlib.sha256(r["kept"]).hexdigest() == digest
    assert any(0 < len(r["kept"]) < len((r["text"] or "").encode()) for r in found)
    assert list(found[0].asDict()) == ["doc_id", "text", "n", "spans", "kept"]


def test_odd_rows_of_suffix_dedup(odd, none):
    found = {r["doc_id"]: r for r in suffix_dedup.repeated_strings(odd).collect()}
    assert found[0]["n_bytes"] == 0 and found[8]["n_removed"] == len(LONG)
    assert found[4]["n_removed"] == 0  # repeated, but shorter than the length
    assert suffix_dedup.repeated_strings(none).count() == 0


# --- personal data ------------------------------------------------------------------------


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(2)
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    host = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(3000):
        text = "".join(rng.choice("a1.@-+ ()b2,5é") for _ in range(rng.randint(0, 24)))
        plain = [(0, *m.span()) for m in mail.finditer(text)]
        plain += [
            (1, *m.span()) for m in host.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))
        ]
        assert [s for s in pii.base_spans(text) if s[0] < 2] == plain


def test_personal_data_of_odd_rows(odd, none):
    found = {r["doc_id"]: r for r in pii.pii_digest(odd).collect()}
    assert (found[11]["n_email"], found[11]["n_phone"], found[11]["n_ip"]) == (1, 1, 1)
    assert found[12]["n_card"] == 1 and found[0]["spans"] == ""
    assert pii.pii_digest(none).count() == 0


def test_long_runs_stay_linear():
    assert pii.base_spans("a" * 200_000) == [] and pii.base_spans("1" * 200_000) == []


# --- learned operators --------------------------------------------------------------------


def held_out(spark, name, label):
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.01").where("held_out").collect()
    marks = {r[0]: r[1] for r in queries.table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", label).collect()}
    return [(r["score"], r["predicted"], marks[r["doc_id"]]) for r in found if r["doc_id"] in marks]


def auc(rows):
    good = [s for s, _, y in rows if y]
    bad = [s for s, _, y in rows if not y]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_toxicity_and_quality_on_the_held_out_fold(spark):
    assert auc(held_out(spark, "op2_toxicity", "toxic")) > 0.85
    rows = held_out(spark, "op10_quality_nbsvm", "quality")
    assert auc(rows) > 0.95 and np.mean([p == y for _, p, y in rows]) > 0.95


def test_languages_on_the_held_out_fold(spark):
    found = queries.QUERIES["op9_language_id"](spark, SF).collect()
    known = {r["doc_id"]: r["lang"] for r in queries.table(spark, SF, "documents").collect()}
    rows = [r["lang_pred"] == known[r["doc_id"]] for r in found if r["held_out"]]
    assert np.mean(rows) > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)


def test_rules_count_as_a_plain_version_does(spark):
    found = queries.QUERIES["op8_decision_lists"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, SF, "documents").collect()}
    for r in found:
        text = texts[r["doc_id"]] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        seen = Counter(grams)
        repeat = {k + d for k, g in enumerate(grams) if seen[g] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = (
            len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(repeat),
        )
        assert tuple(r)[1:6] == expected
        assert r["base_failed"] == (len(words) < 50 or 100 * len(repeat) > 50 * len(words))


def test_a_planted_rule_is_found():
    rng = np.random.default_rng(1)
    table = {"words": rng.uniform(0, 10, 900), "upper_share": rng.uniform(0, 1, 900)}
    bad = (table["words"] > 7) & (table["upper_share"] <= 0.4)
    learned = rules.learn_list(table, bad)
    marked = np.zeros(900, bool)
    for rule in learned:
        marked |= np.logical_and.reduce([c.holds(table) for c in rule])
    assert (marked == bad).mean() > 0.95


def test_learned_operators_on_odd_rows(odd, none, labels):
    scored = toxicity.toxicity_digest(odd, labels)
    assert scored.where("score between 0 and 1").count() == odd.count()
    assert nbsvm.quality_digest(odd, labels).where("score between 0 and 1").count() == odd.count()
    assert rules.rules_digest(odd, labels).where("kept is not null").count() == odd.count()
    named = {r["doc_id"]: r for r in langid.language_digest(odd).collect()}
    assert named[0]["lang_pred"] == named[13]["lang_pred"] == "und"
    assert named[10]["lang_pred"] == "en"
    assert toxicity.without_toxic(odd, labels).columns == odd.columns
    for digest in (toxicity.toxicity_digest, nbsvm.quality_digest, rules.rules_digest):
        assert digest(none, labels).count() == 0
    assert toxicity.toxicity_digest(odd, labels.limit(0)).where("score = 0.5").count() == odd.count()
    assert langid.language_digest(none).count() == 0


# --- mixing and sharding ------------------------------------------------------------------


def test_shards_hold_the_mixture(spark, odd, none):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    rows = sharding.interleaved(docs).toPandas()
    assert len(rows) == docs.count() and np.ptp(rows.groupby("shard").size().to_numpy()) <= 1
    for _, part in rows.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    spread = rows.groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (spread.max(axis=1) - spread.min(axis=1)).max() <= 1
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows.itertuples():
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    found = sharding.interleaved(odd).collect()
    assert len(found) == odd.count() and {r["size"] for r in found if r["doc_id"] == 0} == {1}
    assert sharding.interleaved(none).count() == 0


def test_shards_hold_the_rows_themselves(spark, odd, none, tmp_path):
    docs = odd.unionByName(odd.where("doc_id > 3"))
    plan = Counter(tuple(r) for r in sharding.interleaved(docs).drop("source").collect())
    for path in (None, str(tmp_path / "shards")):
        rows = sharding.sharded(docs, path=path)
        assert set(rows.columns) == {*docs.columns, "slot"}
        assert Counter(tuple(r) for r in sharding.digest(rows).drop("source").collect()) == plan
        own = [c for c in docs.columns if c != "shard"]
        assert Counter(tuple(r) for r in rows.select(own).collect()) == Counter(
            tuple(r) for r in docs.select(own).collect()
        )
    assert len(list((tmp_path / "shards").glob("shard=*"))) == sharding.SHARDS
    assert sharding.sharded(none).count() == 0
    stage = corpus_pipeline.sharding(spark, docs, SF)
    assert {"text", "lang", "score", "slot"} <= set(stage.columns) and stage.count() == docs.count()
    query = queries.QUERIES["op5_sharding"](spark, SF)
    assert all("/shard=" in f for f in query.inputFiles())
    known = queries.table(spark, SF, "documents")
    assert Counter(query.collect()) == Counter(sharding.interleaved(known).drop("source").collect())


def test_copies_follow_given_weights(spark, odd, none):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source")
    )
    weights = spark.createDataFrame([("a", 3.0), (None, 1.0)], "source string, weight double")
    counts = dict(mixing.replicated(docs, weights=weights, rows=8000).groupBy("source").count().collect())
    assert "b" not in counts
    assert abs(counts["a"] - 6000) < 400 and abs(counts[None] - 2000) < 250
    assert set(mixing.replicated(odd).columns) == {*odd.columns, "n_copies", "copy", "shuffle_key"}
    assert mixing.replicated(none).count() == 0
    stage = corpus_pipeline.mixing(spark, odd, SF)
    assert stage.columns == odd.columns and {r["rate"] for r in stage.collect()} <= {"x"}


def test_the_mixture_query_copies_whole_documents(spark):
    plan = queries.QUERIES["op6_poisson_mixing"](spark, SF)
    folders = {f.rsplit("/", 1)[0] for f in plan.inputFiles()}
    assert len(folders) == 1
    rows = spark.read.parquet(*folders).collect()
    docs = {r["doc_id"]: r for r in queries.table(spark, SF, "documents").collect()}
    assert len(rows) == plan.count() > 0
    for r in rows:
        assert all(r[c] == docs[r["doc_id"]][c] for c in ("text", "lang", "source", "n_chars"))


def test_large_rates_do_not_underflow(spark):
    steps = spark.range(1).select(mixing.poisson_steps(F.lit(2000.0)).alias("s")).first()["s"]
    assert steps[1500] < 1e-6 and abs(steps[2000] - 0.506) < 0.002 and abs(steps[-1] - 1) < 1e-9


# --- pipeline -----------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    labels, items = queries.table(spark, SF, "labels"), queries.table(spark, SF, "benchmark")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_dedup", "decontamination", "mixing", "sharding",
    ]
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out.append(docs.collect())
    first = queries.table(spark, SF, "documents")
    model = toxicity.fit_toxicity(first, labels)
    scores = toxicity.toxicity_scores(first, model, keep=["doc_id"]).collect()
    assert {r["doc_id"] for r in out[0]} == {r["doc_id"] for r in scores if r["score"] < 0.7}
    groups = plain_components([(r["doc_id"], r["text"]) for r in out[0]], 5, 80)
    assert {r["doc_id"] for r in out[1]} == {k for k, (_, c) in groups.items() if k == c}
    listed = [(str(r["item_id"]), decontaminate.item_words(r["text"].encode())) for r in items.collect()]
    clean = {
        r["doc_id"] for r in out[1]
        if not plain_hits(decontaminate.item_words(r["text"].encode()), listed, 10)[0]
    }
    assert {r["doc_id"] for r in out[2]} == clean
    assert {r["doc_id"] for r in out[3]} <= clean
    assert [len(x) for x in out[3:]] == [len(out[3])] * 2
