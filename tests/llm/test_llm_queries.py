"""Queries with SQL against DuckDB; the others against brute force on the small tables."""

import zlib
from collections import Counter
from math import log10

import duckdb
import pytest
from brute import line_keepers, near_components
from compare import connection, rows_of_spark, rows_of_sql

from cairn.llm import queries
from cairn.llm.sentencepiece_codec import MODEL


@pytest.fixture(scope="module")
def docs(sf):
    return {d: t or "" for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()}


@pytest.fixture(scope="module")
def labels(sf):
    return dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf, name):
    assert rows_of_spark(queries.queries()[name](spark, sf)) == rows_of_sql(connection(sf), queries.oracle_sql()[name])


def run(spark, sf, name):
    return {r["doc_id"]: r for r in queries.queries()[name](spark, sf).collect()}


def residue(d, m):
    return zlib.crc32(str(d).encode()) % m


def test_op1_counts_and_verdicts(spark, sf, docs, labels):
    got = run(spark, sf, "op1_quality_rules")
    assert got.keys() == docs.keys()
    for d, t in docs.items():
        words = t.encode().split()
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        many = Counter(windows)
        inside = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.encode().strip():
                dup += line in seen
                seen.add(line)
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), dup, len(inside))
        assert r["base_failed"] == (len(words) < 10 or 100 * len(inside) > 20 * len(words)) and not (r["base_failed"] and r["kept"])
    judged = [(got[d]["kept"], q) for d, q in labels.items() if d in got and not got[d]["base_failed"]]
    assert sum(k == (q == 1) for k, q in judged) >= 0.95 * len(judged)


def test_op2_base_scores_and_gain(spark, sf, docs):
    got = run(spark, sf, "op2_maxent_lm")
    split = {d: [*t.encode().lower().split(), b""] for d, t in docs.items()}
    c = Counter(w for d, words in split.items() if residue(d, 7) != 2 for w in words)
    n, v = sum(c.values()), len(c)
    for d, words in split.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (residue(d, 7) == 2, len(words), sum(w in c for w in words), n)
        assert r["base_score"] == pytest.approx(sum(log10((c[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op4_held_out(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # enough labels to learn from
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    got = run(spark, sf, "op4_quality_classifier")
    assert got.keys() == docs.keys() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (residue(d, 5) == 0) for d, r in got.items())
    held = [(got[d]["predicted"], q) for d, q in labels.items() if residue(d, 5) == 0]
    assert sum(p == q for p, q in held) >= 0.9 * len(held)


def test_op5_components(spark, sf, docs):
    got = run(spark, sf, "op5_simhash")
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {d: (f"{f:016x}", c) for d, (f, c) in near_components(docs).items()}


def test_op6_components(spark, sf, docs):
    expected = line_keepers(docs)
    got = {(r["doc_id"], r["line_no"]): (r["kept_doc_id"], r["kept_line_no"]) for r in queries.op6_line_dedup(spark, sf).collect()}
    missed = sum(got.get(p) != keeper for p, keeper in expected.items())
    assert not set(got) - set(expected) and missed <= 0.01 * len(expected)


def test_op7_held_out(spark, sf):
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    got = run(spark, sf, "op7_language_id")
    held = [(r["lang_pred"], langs[d]) for d, r in got.items() if r["held_out"]]
    assert got.keys() == langs.keys() and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_op9_equals_library(spark, sf, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = run(spark, sf, "op9_sentencepiece")
    for d, t in docs.items():
        assert got[d]["round_trip"] and list(got[d]["ids"]) == sp.encode(t) and got[d]["n_ids"] == len(got[d]["ids"])


def test_op10_planted_conversation(spark, sf):
    r = queries.op10_chat_format(spark, sf).where("conv_id = -7").first()
    assert r["n_turns"] == 2 and r["loss_chars"] == len("</s>[INST] ok [/INST]") and r["valid"]
