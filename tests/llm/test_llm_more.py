"""Clashing names, other id types, very long texts, hot training rows, and plain versions of scores."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import decontaminate, language_id, license_scan, line_dedup, quality_classifier, quality_rules, runtime, sentencepiece_codec, simhash
from cairn.llm.sentencepiece_codec import MARK, Stream, Vocabulary

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
CLASHES = ["_fp", "_score", "score", "row", "_row", "lost", "_gone", "kept", "_words", "_spans", "_items", "ids", "n_ids", "round_trip", "_id", "h", "n", "k", "y", "i", "v", "root", "first", "fold", "words", "times"]


def sentence(seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(str(k), f"{sentence(k % 7)}\n{sentence(100 + k)}", "en", "s", 1, *(f"{c}{k}" for c in CLASHES)) for k in range(12)] + [(None, None, None, None, None, *([None] * len(CLASHES)))]
    return spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(str(k), k % 2, 0) for k in range(12)], "doc_id string, quality int, toxic int")


def intact(rows, docs):
    """Every column but the text and its length is that of the document."""
    own = {r["doc_id"]: r for r in docs.collect()}
    return all(r[c] == own[r["doc_id"]][c] for r in rows for c in docs.columns if c not in ("text", "n_chars"))


def test_stages_keep_clashing_columns(spark, clashing, labels):
    items = spark.createDataFrame([("b", sentence(3)), ("a", sentence(3)), ("c", None)], "item_id string, text string")
    kept = quality_classifier.accepted(clashing, labels, 0.0)
    assert kept.columns == clashing.columns and kept.count() == 13 and intact(kept.collect(), clashing)
    lines = line_dedup.dedup_lines(clashing)
    got = lines.collect()
    assert lines.columns == clashing.columns and len(got) == 13 and intact(got, clashing)
    assert {r["doc_id"]: len(r["text"].split("\n")) for r in got if r["text"]} == {str(k): 2 if str(k) == min((str(j) for j in range(12) if j % 7 == k % 7), key=str) else 1 for k in range(12)}
    near = simhash.one_of_each(clashing)
    assert near.columns == clashing.columns and near.count() == 13 and intact(near.collect(), clashing)
    clean = decontaminate.decontaminated(clashing, items)
    assert clean.columns == clashing.columns and {r["doc_id"] for r in clean.collect()} == {str(k) for k in range(12) if k % 7 != 3} | {None}
    found = decontaminate.scan(clashing, items)
    words, spans, hits = decontaminate.result_names(clashing)
    assert (words, spans, hits) == ("__words", "__spans", "__items") and found.where(F.size(hits) > 0).select(hits).distinct().collect() == [(["a", "b"],)] and intact(found.collect(), clashing)
    coded = sentencepiece_codec.encoded(clashing)
    assert coded.columns == [*clashing.columns, "_ids", "_n_ids", "_round_trip"] and all(r["_round_trip"] for r in coded.collect()) and intact(coded.collect(), clashing)


def test_text_ids(clashing, labels):
    made = (quality_rules.quality_rules(clashing, labels), quality_classifier.quality_classifier(clashing, labels), simhash.near_duplicates(clashing), language_id.language_id(clashing), license_scan.license_scan(clashing), line_dedup.repeated_lines(clashing))
    for out in made:
        assert dict(out.dtypes)["doc_id"] == "string" and {r["doc_id"] for r in out.collect()} <= {None, *map(str, range(12))}


def test_pipeline_stages_on_odd_tables(spark, tmp_path, labels):
    """Nulls, an empty and a very long text, repeated rows and no rows at all, through every stage."""
    long = " ".join(sentence(k, 1000) for k in range(300))
    rows = [(1, None), (2, ""), (None, sentence(1)), (None, sentence(2)), (3, sentence(3)), (3, sentence(3)), (3, sentence(4)), (4, long)]
    docs = spark.createDataFrame([(d, t, None, None, None, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _row string")
    spark.createDataFrame([(1, sentence(5000))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.where("false").write.parquet(f"{tmp_path}/labels.parquet")  # so the classifier keeps all
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, str(tmp_path)), stage(spark, docs.where("false"), str(tmp_path))
        got = sorted(((r["doc_id"] or -1, r["text"] or "") for r in out.collect()))
        everything = sorted(((d or -1, t or "") for d, t in rows))
        whole = [x for k, x in enumerate(everything) if x not in everything[:k]] if name in ("line dedup", "near dedup") else everything
        if name == "near dedup":  # the null and the empty text have one fingerprint
            whole.remove((2, ""))
        assert none.count() == 0 and none.columns == out.columns and got == whole, name


def test_one_training_row_for_a_hot_id(spark):
    docs = spark.createDataFrame([(k if k < 40 else 7, sentence(k % 2) + " w%d" % k, "en" if k % 2 else "de") for k in range(400)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    one = docs.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("lang").alias("lang"))
    assert np.array_equal(quality_classifier.fit(docs, labels), quality_classifier.fit(one, labels))
    rows = [{r["doc_id"]: r["score"] for r in quality_rules.quality_rules(d, labels).where("doc_id <> 7").collect()} for d in (docs.repartition(5), docs.repartition(1))]
    assert rows[0] == rows[1]


def features_by_hand(text):
    """Feature number to value, with the hashes of single words as they are."""
    words = text.encode().split()
    out = {quality_classifier.BIAS: 1.0}

    def add(h):
        k = int(quality_classifier.mixed(np.array([h], np.uint64))[0] >> np.uint64(64 - quality_classifier.BITS))
        out[k] = out.get(k, 0.0) + 1 / math.sqrt(len(words))

    for table in (quality_classifier._words, quality_classifier._shapes):
        hashes = [np.uint64(table[w]) for w in words]
        for h in hashes:
            add(h)
        for a, b in zip(hashes, hashes[1:], strict=False):
            with np.errstate(over="ignore"):
                add(quality_classifier.mixed(np.array([a * np.uint64(0x9E3779B97F4A7C15) + b], np.uint64))[0])
    for a, b in zip(words, words[1:], strict=False):
        if a == b:
            add(np.uint64(0x1F83D9ABFB41BD6B))
    return out


def test_classifier_scores_by_hand(spark, monkeypatch):
    texts = ["", "one", "Two two 2two two two", sentence(5, 300)]
    weights = np.random.default_rng(2).normal(size=1 << quality_classifier.BITS).astype(np.float32)
    plain = [sum(float(weights[k]) * x for k, x in features_by_hand(t).items()) for t in texts]
    assert np.allclose(quality_classifier.margins([t.encode() for t in texts], weights), plain, atol=1e-4)
    monkeypatch.setattr(quality_classifier, "LONG", 64)
    assert np.allclose([quality_classifier.long_margin(t.encode(), weights) for t in texts], plain, atol=1e-4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert np.allclose([r["_score"] for r in quality_classifier.scored(docs, weights).orderBy("doc_id").collect()], 1 / (1 + np.exp(-np.array(plain))), atol=1e-4)


def test_ftrl_by_hand():
    """One row at a time, one feature at a time."""
    r = np.random.default_rng(3)
    rows = [(np.sort(r.choice(50, 6, replace=False)).astype(np.int32), r.random(6).astype(np.float32), float(k % 2)) for k in range(30)]
    got = quality_classifier.fit_ftrl(rows, epochs=2)
    z, n = [0.0] * 50, [0.0] * 50

    def weight(i):
        return 0.0 if abs(z[i]) <= 0.05 else -(z[i] - math.copysign(0.05, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.3 + 1.0)

    order = np.random.default_rng(7)
    for _ in range(2):
        for k in order.permutation(30):
            i, v, y = rows[k]
            w = [weight(j) for j in i]
            p = 1 / (1 + math.exp(-sum(a * float(b) for a, b in zip(w, v, strict=True))))
            for j, a, b in zip(i, w, v, strict=True):
                g = (p - y) * float(b)
                z[j] += g - (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / 0.3 * a
                n[j] += g * g
    assert np.allclose(got[:50], [weight(i) for i in range(50)], atol=1e-5) and not got[50:].any()


def test_language_by_hand():
    """Votes and margins of one text, trigram by trigram."""
    r = np.random.default_rng(5)
    langs = ["de", "en", "fr", "it", "ja"]
    families = ["germanic", "ja", "romance"]
    pairs = [(0, 1), (2, 3)]
    h = language_id.Hierarchy(langs, families, pairs, r.normal(0, 0.2, (1 << language_id.BITS, 5)).astype(np.float32), r.normal(0, 0.1, 5).astype(np.float32))
    texts = ["", "a", "Der Hund schläft", "quattro stagioni", "日本語の文", sentence(2, 80), "12 34"]
    names, scores = h.predict([t.encode() for t in texts])
    for text, name, score in zip(texts, names, scores, strict=True):
        raw = b" " + (text.encode().lower() or b" ") + b" "
        grams = [raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16 for i in range(len(raw) - 2)]
        rows = [((g * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - language_id.BITS) for g in grams]
        m = [float(sum(float(h.weights[i, k]) for i in rows)) * language_id.SCALE / len(rows) + float(h.bias[k]) for k in range(5)]
        chance = [1 / (1 + math.exp(-2 * max(-15, min(15, x)))) for x in m]
        f = max(range(3), key=lambda k: m[k])
        share = chance[f] / sum(chance[:3])
        own = [k for k, x in enumerate(langs) if language_id.family_of(x) == families[f]]
        best, part = own[0], 1.0
        if len(own) == 2:
            p = 3 + pairs.index(tuple(own))
            best, part = (own[0], chance[p]) if m[p] > 0 else (own[1], 1 - chance[p])
        if any(map(str.isalpha, text)):
            assert name == langs[best] and score == pytest.approx(share * part, abs=1e-3)
        else:
            assert (name, score) == ("und", 0)


def test_trees_by_hand():
    r = np.random.default_rng(4)
    x = r.random((300, 4))
    trees = quality_rules.fit_trees(x, (x[:, 0] + x[:, 2] > 1).astype(float), [0, 0, 1, 0], trees=15)
    for row, score in zip(x[:40], trees.score(x[:40]), strict=True):
        margin = trees.bias
        for root in trees.roots:
            node = root
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            margin += trees.value[node]
        assert score == pytest.approx(1 / (1 + math.exp(-margin)))


def every_path(text, pieces, unknown):
    """The largest sum over all ways to cut ``text`` into pieces, or single characters without one."""
    best = [0.0] + [-math.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 8), end):  # no piece is longer
            part = text[start:end]
            score = pieces.get(part, unknown if len(part) == 1 else -math.inf)
            best[end] = max(best[end], best[start] + score)
    return best[-1]


def test_unigram_search_by_brute_force():
    r = random.Random(8)
    bytes_ = [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    for _ in range(30):
        made = {"".join(r.choice("abc") for _ in range(r.randrange(1, 6))): -r.random() * 8 for _ in range(25)} | {MARK: -3.5, MARK + "a": -2.5, MARK + "ab": -4.25}
        v = Vocabulary([*bytes_, *made.items()], {i: "byte" for i in range(256)}, unigram=True)
        text = " ".join("".join(r.choice("abcd") for _ in range(r.randrange(1, 40))) for _ in range(5))
        ids = np.frombuffer(v.encode(text), "<i4").tolist()
        assert v.decode(ids) == text
        got, k = 0.0, 0
        while k < len(ids):
            got += made[v.names[ids[k]]] if ids[k] >= 256 else v.unknown
            k += 1
        assert got == pytest.approx(every_path(MARK + text.replace(" ", MARK), made, v.unknown))
        stream = Stream(v)
        run = "".join(r.choice("abc") for _ in range(5000))
        out = [i for at in range(0, 5000, 37) for i in stream.feed(run[at : at + 37])]
        assert out and stream.widest < 400 and sum(made[v.names[i]] if i >= 256 else v.unknown for i in out + stream.finish()) == pytest.approx(every_path(run, made, v.unknown))


def test_a_very_long_text_in_windows(monkeypatch):
    v = Vocabulary.load()
    text = "\n".join(sentence(k, 60) + "   x" for k in range(40)) + " " + "y" * 3000 + "\n\n  end"
    whole = v.encode(text)
    monkeypatch.setattr(sentencepiece_codec, "_WINDOW", 50)
    assert v.encode(text) == whole and v.decode_bytes(whole) == text and len(list(v.windows(text))) > 100


def test_names_and_folders(spark):
    assert runtime.fresh(["A", "_a"], "a") == "__a" and runtime.fresh([], "a") == "a"


def test_similar_pairs_connect_as_brute_force():
    r = random.Random(1)
    base = "".join(r.choice("abcdefgh ") for _ in range(120))
    for n in (2, 9, 40, 90):
        lines = []
        for _ in range(n):
            x = list(base)
            for _ in range(r.randrange(7)):
                x[r.randrange(len(x))] = r.choice("xyz")
            lines.append("".join(x).encode())
        sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in (x.decode() for x in lines)]
        plain = [(i, j) for i, j in combinations(range(n), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]

        def groups(pairs, n=n):
            up = list(range(n))
            for _ in range(n):
                for a, b in pairs:
                    up[a] = up[b] = min(up[a], up[b])
            return up

        found = line_dedup.similar_pairs(lines)
        assert groups(found) == groups(plain) and {tuple(sorted(p)) for p in found} <= set(plain)


def test_large_buckets_in_blocks(spark, monkeypatch):
    """Buckets cut into blocks give the same components."""
    monkeypatch.setattr(line_dedup, "MOST_TOGETHER", 10)
    base = sentence(1, 30)
    docs = spark.createDataFrame([(k, base[:-3] + f"{k:03d}") for k in range(60)] + [(k, sentence(k)) for k in range(100, 110)], "doc_id long, text string")
    got = line_dedup.repeated_lines(docs).collect()
    assert len(got) == 60 and {r["kept_doc"] for r in got} == {0}


@pytest.mark.parametrize("most", [28, 12])
def test_line_map_loses_no_key(spark, monkeypatch, most):
    """Every key's bit is on, also where the map may not grow; of other keys few are, where it may."""
    monkeypatch.setattr(line_dedup, "_MAP", most)
    rng = np.random.default_rng(4)
    keys, others = rng.integers(-(1 << 63), 1 << 63, (2, 5_000), dtype=np.int64)
    bits, found = line_dedup.key_map(spark.createDataFrame([(int(k),) for k in keys], "s long"), len(keys))
    assert bits <= most and len(found) == (1 << bits) // 8 and line_dedup.in_map(keys, bits, found).all()
    assert most < 28 or line_dedup.in_map(others, bits, found).mean() < 0.2
    assert not len(line_dedup.in_map(keys[:0], bits, found))
