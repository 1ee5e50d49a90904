"""Each stage against a plain version on the stage's own input."""

import duckdb
from brute import hits, line_keepers, near_components

import corpus_pipeline
from cairn.llm import queries
from cairn.llm.runtime import spill
from cairn.llm.sentencepiece_codec import MODEL


def test_stages(spark, sf):
    import sentencepiece

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = dict(duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spill(stage(spark, docs, sf), f"test{k}")
        before, texts = texts, {r["doc_id"]: r["text"] for r in docs.collect()}
        assert k == 4 or docs.columns == columns
        seen.append((before, texts))

    before, after = seen[0]
    good = {r["doc_id"] for r in queries.op4_quality_classifier(spark, sf).where("predicted = 1").collect()}
    assert after == {d: before[d] for d in good} and 0 < len(after) < len(before)

    before, after = seen[1]
    keepers, expected = line_keepers(before), {}
    for d, t in before.items():
        lines = [line for n, line in enumerate(t.split("\n")) if keepers.get((d, n), (d, n)) == (d, n)]
        if len(lines) == len(t.split("\n")) or any(line.strip() for line in lines):
            expected[d] = "\n".join(lines)
    assert after == expected and after != before

    before, after = seen[2]
    assert after == {d: before[d] for d, (_, first) in near_components(before).items() if first == d}

    before, after = seen[3]
    found = hits(before, items)
    assert set(after) == {d for d, (n, places) in found.items() if not places or 20 * len(places) < n}
    assert all(after[d] == before[d] for d in after if not found[d][1])
    # what is cut is just the hit words, with what stands between words of one span
    for d in after:
        n, places = found[d]
        assert hits({d: after[d]}, {})[d][0] == n - len(places)

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = docs.collect()
    assert {r["doc_id"]: list(r["ids"]) for r in rows} == {d: sp.encode(t) for d, t in seen[3][1].items()} and all(r["round_trip"] for r in rows)
