"""Nulls, empty and very long texts, ties and repeated rows, empty tables, extra columns."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import chat_format, components, decontaminate, language_id, license_scan, line_dedup, maxent_lm, quality_classifier, quality_rules, sentencepiece_codec, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _fp string, score double, h string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def sentence(seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(sentence(k, 1000) for k in range(30))
    rows = [
        (1, None, "en", None, None), (2, "", None, "a", 0), (3, " \t\n ", "en", "a", 4), (None, "no id here at all", "en", "a", 17), (4, sentence(1), "en", "a", 1), (4, sentence(1), "en", "a", 1),
        (5, sentence(1) + " tail", "en", "b", 1), (6, long, "fr", "b", 1), (7, "12 34 !!", "fr", "b", 1), (8, "é ▁ 日本\x00😀", "fr", "b", 1), (9, sentence(2) + "\n" + sentence(3), "fr", "b", 1), (10, sentence(3) + "\n" + sentence(4), "fr", "b", 1),
    ]
    return spark.createDataFrame([(*r, "x", 0.5, "y") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(12)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


def test_quality_rules(odd, none, labels):
    got = quality_rules.quality_rules(odd, labels).collect()
    assert len(got) == 12 and {r["base_failed"] for r in got if r["doc_id"] in (1, 2, 3)} == {True}
    assert quality_rules.quality_rules(none, labels).count() == 0
    assert quality_rules.quality_rules(odd, labels.where("false")).where("kept").count() > 0


def test_repeated_words_either_way(monkeypatch):
    words = [b"w%d" % random.Random(3).randrange(3) for _ in range(2)] + [b"w%d" % (k * k % 7) for k in range(400)]
    plain = quality_rules.repeated_words(words)
    monkeypatch.setattr(quality_rules, "_MANY", 10)
    assert quality_rules.repeated_words(words) == plain > 0
    assert [quality_rules.repeated_words([b"a"] * n) for n in (0, 5, 6)] == [0, 0, 6]


def test_trees_are_monotone_and_fit():
    r = np.random.default_rng(1)
    x = r.random((2000, 3))
    y = (x[:, 0] < 0.5).astype(float)
    y[r.random(2000) < 0.1] = 1
    trees = quality_rules.fit_trees(x, y, [-1, 0, -1], trees=20)
    grid = np.linspace(0, 1, 50)
    for j in (0, 2):
        rows = np.full((50, 3), 0.4)
        rows[:, j] = grid
        assert (np.diff(trees.score(rows)) <= 1e-12).all()
    assert ((trees.score(x) > 0.5) == (x[:, 0] < 0.5)).mean() > 0.9


def test_classifier(odd, none, labels):
    got = quality_classifier.quality_classifier(odd, labels).collect()
    assert len(got) == 12 and all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.quality_classifier(none, labels).count() == 0
    assert {r["score"] for r in quality_classifier.quality_classifier(odd, labels.where("false")).collect()} == {1.0}


def test_language_model(odd, none):
    got = {r["doc_id"]: r for r in maxent_lm.lm_scores(odd).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == got[3]["n_tokens"] == 1 and len(got) == 11
    assert maxent_lm.lm_scores(none).count() == 0
    unseen = maxent_lm.lm_scores(odd.where("doc_id = 2")).first()
    assert np.isfinite(unseen["score"])


def lm_by_hand(texts, held):
    """The whole model in plain loops: what every text scores."""
    from collections import Counter

    words = [t.encode().lower().split() + [b"\n"] for t in texts]
    count = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    order = sorted(count, key=lambda w: (-count[w], w))
    leaves = maxent_lm.leaves_for(sum(count.values()))
    tails = leaves // 16
    own = {w: k for k, w in enumerate(order[: leaves - tails])}
    size = Counter()
    for w, c in count.items():
        if w not in own:
            size[zlib.crc32(w[-2:]) % tails] += c + 1
    leaf = [[own[w] if w in own else leaves - tails + zlib.crc32(w[-2:]) % tails for w in ws] for ws in words]
    tree = maxent_lm.Tree(leaves)
    tokens = np.zeros(leaves)
    for w, c in count.items():
        tokens[own[w] if w in own else leaves - tails + zlib.crc32(w[-2:]) % tails] += c
    return words, leaf, own, size, count, tree, tokens


def test_language_model_by_hand(spark):
    import math

    rows = [(k, sentence(k, 60) + (" rare%d" % k)) for k in range(60)]
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows]
    words, leaf, own, size, count, tree, tokens = lm_by_hand([t for _, t in rows], held)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).select(F.col("text").cast("binary").alias("text"))
    v = maxent_lm.vocabulary(maxent_lm.word_counts(train))
    assert np.array_equal(v.leaf_count, tokens) and {w: k for w, k in v.number.items() if k < v.modelled} == own and v.leaf[: len(own)].tolist() == list(own.values())
    coded = maxent_lm.coded(docs.selectExpr("doc_id", "false AS held_out", "0 AS fold", "CAST(text AS binary) AS text"), v).orderBy("doc_id").collect()
    assert [np.frombuffer(r["leaves"], np.int32).tolist() for r in coded] == leaf
    # sums of counts by loops over tokens and levels
    weights = tree.start(tokens) + np.random.default_rng(1).normal(0, 0.3, tree.starts[-1]).astype(np.float32)
    some = leaf[:5]
    flat, lengths = np.array(sum(some, []), np.int32), np.array(list(map(len, some)))
    contexts = tree.contexts(flat, lengths)
    observed, logs = np.zeros(len(weights)), np.zeros(len(flat))
    for i, x in enumerate(flat):
        for k, bits in enumerate(tree.bits):
            at, y = tree.level(k, flat[i : i + 1], contexts[:, i : i + 1])
            first = [int(tree.starts[k]) + (int(r[0]) << bits) for r in at]
            z = [sum(float(weights[f + c]) for f in first) for c in range(1 << bits)]
            top = max(z)
            total = sum(math.exp(q - top) for q in z)
            logs[i] += z[int(y[0])] - top - math.log(total)
            for f in first:
                observed[f + int(y[0])] += 1
    sums = maxent_lm.sums_of(tree, weights, [(flat, lengths)])
    assert np.array_equal(sums[0], observed)
    for k, bits in enumerate(tree.bits):  # draws fall in the rows of their contexts
        assert np.array_equal(*(tree.table(k, x).sum(axis=1) for x in sums))
    one = np.array([[0.1, 0.0, 0.6, 0.3]], np.float32)
    often = np.bincount(maxent_lm.drawn(np.repeat(one, 20_000, axis=0), np.arange(20_000, dtype=np.uint64)), minlength=4) / 20_000
    assert often[1] == 0 and np.abs(often - one[0]).max() < 0.02
    assert np.allclose(maxent_lm.token_scores(tree, weights, flat, lengths), logs / math.log(10), atol=1e-4)
    # texts start anew, and a context is the two tokens before
    place = int(lengths[0])
    assert contexts[0, place] == contexts[0, 0] and len({int(c) for c in contexts[2]}) > 100
    # one distribution over all leaves in a context
    every = np.arange(tree.leaves, dtype=np.int32)
    held_fast = np.repeat(contexts[:, 7:8], tree.leaves, axis=1)
    total = np.zeros(tree.leaves)
    for k in range(maxent_lm.LEVELS):
        at, y = tree.level(k, every, held_fast)
        z, e = maxent_lm.potentials(tree.table(k, weights), at)
        total += z[every, y] - np.log(e.sum(axis=1))
    assert abs(np.exp(total.astype(float)).sum() - 1) < 1e-3
    # training helps, and the query's scores are those of the fitted weights
    texts = maxent_lm.coded(docs.selectExpr("doc_id", "false AS held_out", "CAST(pmod(doc_id, 12) AS int) AS fold", "CAST(text AS binary) AS text"), v)
    fitted = maxent_lm.fit(texts, v)
    all_, sizes = np.array(sum(leaf, []), np.int32), np.array(list(map(len, leaf)))
    before, after = (maxent_lm.token_scores(tree, w, all_, sizes).sum() for w in (tree.start(tokens), fitted))
    assert after > before + 10
    got = {r["doc_id"]: r["model"] + r["fixed"] for r in maxent_lm.context_scores(texts, v, fitted).collect()}
    per = maxent_lm.token_scores(tree, fitted, all_, sizes)
    at = 0
    for (doc, _), ws in zip(rows, words, strict=True):
        plain = per[at : at + len(ws)].sum() + sum(math.log10(count[w] + 1) * (w in v.number) - math.log10(size[zlib.crc32(w[-2:]) % (tree.leaves // 16)] + 1) for w in ws if w not in own)
        at += len(ws)
        assert got[doc] == pytest.approx(plain, abs=1e-6)


def test_language_model_whatever_the_partitions(spark):
    docs = spark.createDataFrame([(k, sentence(k % 90, 50)) for k in range(100)], "doc_id long, text string")
    runs = [{r["doc_id"]: r["score"] for r in maxent_lm.lm_scores(docs.repartition(n)).collect()} for n in (1, 4, 16)]
    assert all(r[k] == pytest.approx(runs[0][k], rel=1e-9) for r in runs for k in r)
    words = spark.createDataFrame([(str(k), sentence(k, 50)) for k in range(20)], "doc_id string, text string")
    assert {r["doc_id"] for r in maxent_lm.lm_scores(words).collect()} == {str(k) for k in range(20)}


def test_language_model_jobs_of_a_round(spark, monkeypatch):
    """However many partitions there are, a round is a job or two, not one for each partition."""
    monkeypatch.setattr(maxent_lm, "FOLDS", 2)
    docs = spark.createDataFrame([(k, sentence(k, 30)) for k in range(20)], "doc_id long, text string").repartition(3)
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    v = maxent_lm.vocabulary(maxent_lm.word_counts(docs.select(F.col("text").cast("binary").alias("text"))))
    texts = maxent_lm.coded(docs.selectExpr("doc_id", "false AS held_out", "CAST(doc_id % 2 AS int) AS fold", "CAST(text AS binary) AS text"), v)
    few = maxent_lm.fit(texts, v)
    try:
        for k, value in held.items():
            spark.conf.set(k, value)
        spark.sparkContext.setJobGroup("rounds", "rounds")
        many = maxent_lm.fit(texts, v)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, value in before.items():
            spark.conf.set(k, value)
    assert np.array_equal(few, many) and maxent_lm.FOLDS <= len(jobs) <= 3 * maxent_lm.FOLDS


def test_long_texts_in_pieces():
    text = sentence(1, 500).replace(" ", "\n", 50).encode()
    cut = list(maxent_lm.pieces(text, 100))
    assert b"".join(cut) == text and len(cut) > 20 and [w for c in cut for w in c.split()] == text.split()
    assert list(maxent_lm.pieces(b"x" * 1000, 100)) == [b"x" * 1000, b""] and list(maxent_lm.pieces(b"")) == [b""]


def test_decontamination_blocks_agree(spark, odd, none):
    items = spark.createDataFrame([(1, " ".join(sentence(1).split()[3:20])), (2, "no id"), (3, None), (4, ""), (None, "x y"), (1, " ".join(sentence(1).split()[3:20])), (5, sentence(9))], "item_id long, text string")

    def rows(df):
        return sorted(((r["doc_id"] or -1, r["_words"], str(r["_spans"]), str(r["_items"])) for r in df.collect()), key=str)

    one, many = rows(decontaminate.scan(odd, items)), rows(decontaminate.scan(odd, items, most_windows=10))
    assert one == many and any("[[3, 20]]" in r[2] for r in one) and any(r[3] == "[2]" for r in one)
    assert decontaminate.scan(none, items).count() == 0 and decontaminate.scan(odd, items.where("false")).where("size(_spans) > 0").count() == 0
    clean = decontaminate.decontaminated(odd, items)
    assert clean.columns == odd.columns and clean.where("doc_id = 4").count() == 0


def test_cut_passages():
    assert decontaminate.without_spans("One, Zwölf three. FOUR five", [[1, 3]]) == "One, . FOUR five"
    assert decontaminate.without_spans("a b c", [[0, 3]]) == ""


def test_simhash(odd, none):
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()}
    assert (1, 1) in got and (2, 1) in got and (3, 1) in got and (4, 4) in got and simhash.near_duplicates(odd).count() == 12
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id IN (1, 2, 3)").count() == 1


def test_one_of_each_goes_by_row(spark):
    a, b, c, d = (sentence(k, 60) for k in range(500, 504))
    rows = [(None, a), (None, a), (5, b), (5, b), (6, c), (7, c), (7, d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in simhash.one_of_each(docs).collect()]
    assert sorted(got, key=repr) == sorted([(None, a), (5, b), (6, c), (7, d)], key=repr)


@pytest.mark.parametrize("plan", [(3, 1), (5, 2), (6, 3)])
def test_every_plan_finds_all_links(spark, plan, monkeypatch):
    r = np.random.default_rng(8)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << r.choice(64, k, replace=False).astype(np.uint64), initial=np.uint64(0)) for b in base for k in (1, 3, 4, 5)]
    values = np.unique(np.concatenate([base, np.array(near, np.uint64)])).view(np.int64)
    monkeypatch.setattr(simhash, "plan_for", lambda rows: plan)
    df = spark.createDataFrame([(int(v),) for v in values], "_fp long")
    roots = {x["node"]: x["root"] for x in components.components(simhash.links(df)).collect()}
    up = {int(v): int(v) for v in values}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (int(a) ^ int(b)) & ((1 << 64) - 1) and ((int(a) ^ int(b)) & ((1 << 64) - 1)).bit_count() <= 4:
                x, y = sorted((find(int(a)), find(int(b))))
                up[y] = x
    assert roots == {v: find(v) for v in up if find(v) != v or any(find(w) == v for w in up if w != v)}


def test_large_bucket_is_searched_as_pairs_would_be():
    r = np.random.default_rng(9)
    values = np.unique((np.uint64(0xABCDEF) ^ r.integers(0, 1 << 10, 200, dtype=np.uint64))).view(np.int64)
    a, b = simhash.bucket_links(np.zeros(len(values), np.int64), values)
    assert len(a) == len(values) - 1  # one component, as neighbours differ in few of ten bits


def test_components_of_path_star_and_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, **{i: 200 for i in (200, 201, 202)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup(odd, none):
    out = line_dedup.dedup_lines(odd)
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == odd.columns and text[9] == sentence(2) + "\n" + sentence(3) and text[10] == sentence(4)
    assert text[1] is None and text[2] == "" and text[3] == " \t\n "
    assert line_dedup.dedup_lines(none).count() == 0


def test_lines_go_by_row(spark):
    a, b, c, d, e = (sentence(k) for k in range(400, 405))
    rows = [(1, a), (None, b + "\n" + a), (None, c + "\n" + d), (None, None), (7, e + "\n" + a), (7, sentence(405) + "\n" + sentence(406)), (7, None), (8, sentence(407)), (8, sentence(407)), (None, sentence(408)), (None, sentence(408))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in line_dedup.dedup_lines(docs).collect()]
    expected = [(1, a), (None, b), (None, c + "\n" + d), (None, None), (7, e), (7, rows[5][1]), (7, None), (8, sentence(407)), (None, sentence(408))]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_similar_pairs_with_many_lines():
    base = [sentence(k, 30).encode() for k in range(60)]
    lines = base + [b + b" x" for b in base]
    pairs = line_dedup.similar_pairs(lines)
    assert {tuple(sorted(p)) for p in pairs} == {(k, k + 60) for k in range(60)}
    assert line_dedup.similar_pairs([b"ab", b"ac", b"completely different line"]) == []


def test_short_lines_with_one_edit(spark):
    """Lines of 50 to 78 characters with one character changed are 0.8 alike by shingles of 5, not by longer ones."""
    lines = [sentence(k, 20)[: 56 + k % 20] for k in range(300, 340)]
    edited = [t[:28] + "#" + t[29:] for t in lines]
    for a, b in zip(lines, edited, strict=True):
        x, y = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (a, b))
        assert len(x & y) >= 0.8 * len(x | y) and line_dedup.similar_pairs([a.encode(), b.encode()])
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(lines + edited)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()} == dict(enumerate(lines))


def test_language_id(odd, none):
    got = {r["doc_id"]: r for r in language_id.language_id(odd).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[7]["lang_pred"] == "und" and got[1]["score"] == 0.0
    assert language_id.language_id(none).count() == 0
    assert {r["lang_pred"] for r in language_id.language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_more_than_two_hundred_languages(spark):
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5][:205]
    docs = spark.createDataFrame([(k, sentence(k, 5), f"x{n:03}") for n, k in enumerate(ids)], "doc_id long, text string, lang string")
    assert language_id.fit(docs).langs == [f"x{n:03}" for n in range(205)]


def test_license_scan(spark, none):
    docs = spark.createDataFrame(
        [(1, "cc by cc by, CC-BY!"), (2, None), (3, "x " * 100 + "Licensed under the\nApache License, Version 2.0 (the" + " y" * 100), (4, "all rights reserved General Public License"), (4, "Licensed under some other terms")], "doc_id long, text string"
    )
    got = [tuple(r)[1:] for r in license_scan.license_scan(docs).orderBy("doc_id", "n_words").collect()]
    assert got[0] == (6, 3, 0, 4, "cc-by", "cc-by", 1.0) and got[1] == (0, 0, None, None, "", "", 0.0)
    assert got[2][4:6] == ("", "apache-2.0") and got[2][6] == 1.0 and got[4][4:6] == ("gpl,reserved", "gpl,reserved") and got[3][5] == ""
    assert license_scan.license_scan(none).count() == 0


def test_short_declarations_are_labelled(spark):
    lines = {
        "Released under the MIT License.": "mit", "Licensed under the MIT license": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3", "All rights reserved.": "reserved", "Distributed under the BSD 3-Clause License": "bsd", "Available under the ISC License": "isc",
        "SPDX-License-Identifier: MPL-2.0": "mpl-2.0", "Mozilla Public License, version 2.0": "mpl-2.0", "CC BY 4.0": "cc-by", "Creative Commons Attribution-ShareAlike 4.0 International": "cc-by-sa-4.0", "CC0 1.0 Universal": "cc0", "Released under the Unlicense": "unlicense",
    }
    docs = spark.createDataFrame([(k, f"{sentence(k)}\n{t}\n{sentence(k + 1)}") for k, t in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"].split(","), r["score"]) for r in license_scan.license_scan(docs).collect()}
    assert all(label in got[k][0] and got[k][1] > 0 for k, label in enumerate(lines.values()))


def test_short_templates_need_their_deciding_token(spark):
    lines = {
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0", "Licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa-4.0", "Licensed under CC BY 4.0.": "cc-by", "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "Licensed under the Apple License, Version 2.0": "", "This work is licensed under the GNU General Public License, version 2.": "gpl", "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3",
    }
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan.license_scan(docs).collect()} == dict(enumerate(lines.values()))
    sizes = [len(set(license_scan.plain_words(t.encode()))) for _, t in license_scan.TEMPLATES]
    assert all(n <= 6 or n > 10 for n in sizes)


def test_filters_lose_no_match():
    r = random.Random(12)
    vocabulary = [w for _, t in license_scan.TEMPLATES for w in license_scan.plain_words(t.encode())] + [b"filler%d" % k for k in range(30)]
    index = license_scan.TemplateIndex({w: r.randrange(50) for w in {w for _, t in license_scan.TEMPLATES for w in license_scan.plain_words(t.encode())}}, threshold=0.5)
    for _ in range(300):
        words = [r.choice(vocabulary) for _ in range(r.randrange(1, 60))]
        plain = {k for k, tokens in enumerate(index.tokens) if len(set(tokens) & set(words)) >= index.needed[k]}
        assert set(index.matches(words)) == plain


def test_sentencepiece(odd, none):
    got = {r["doc_id"]: r for r in sentencepiece_codec.encoded(odd).collect()}
    assert all(r["round_trip"] for r in got.values()) and got[1]["n_ids"] == got[2]["n_ids"] == 0
    back = {r["doc_id"]: r["decoded"] for r in sentencepiece_codec.decoded(sentencepiece_codec.encoded(odd)).collect()}
    assert all((r["text"] or "") == back[d] for d, r in got.items()) and sentencepiece_codec.encoded(none).count() == 0


def test_stream_is_bounded_and_equals_merging():
    v = sentencepiece_codec.Vocabulary.load()
    r = random.Random(2)
    for alphabet in ("ab", "thein", "aé日#", "▁x"):
        text = "".join(r.choice(alphabet) for _ in range(5000)).replace("▁", "q")
        stream = sentencepiece_codec.Stream(v)
        ids = [i for k in range(0, len(text), 37) for i in stream.feed(text[k : k + 37])] + stream.finish()
        assert stream.widest < 600
        plain = [i for p in v.merged(text[:400]) for i in ([v.id[p]] if p in v.id else [v.bytes[b] for b in p.encode()])]
        assert ids[: len(plain) - 20] == plain[:-20]


def test_chat_format(spark):
    rows = [(1, 0, "user", "a</s>[OUT] \\ b"), (1, 1, "assistant", None), (2, 0, "assistant", "first"), (None, 0, None, "x"), (3, 0, "tool", "[NAME]<s>"), (3, 0, "tool", "[NAME]<s>"), (4, 1, "assistant", "\\\\[INST"), (4, 0, "user", "<")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.formatted(df.select("*", F.lit(1).alias("segments")))
    got = {r["conv_id"]: r for r in out.select("conv_id", "valid", chat_format.parsed(F.col("formatted")).alias("turns")).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "a</s>[OUT] \\ b"), ("assistant", "")] and got[1]["valid"] and not got[2]["valid"]
    assert [tuple(t) for t in got[3]["turns"]] == [("tool", "[NAME]<s>")] * 2 and [tuple(t) for t in got[None]["turns"]] == [("", "x")]
    assert [tuple(t) for t in got[4]["turns"]] == [("user", "<"), ("assistant", "\\\\[INST")]
    assert chat_format.formatted(df.where("false")).count() == 0
