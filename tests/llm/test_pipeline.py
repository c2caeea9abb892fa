"""The stages one after the other on the small tables."""

from pathlib import Path

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tests.llm.test_operators import brute_groups, nothing, odd, odd_rows  # noqa: F401  fixtures
from weftgraph.llm import near_duplicates, secrets, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        seen[name] = (before, docs)
        if name != "sentencepiece":
            assert docs.columns == columns, name
    before, after = seen["toxicity"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r["doc_id"] for r in after.collect()}
    clean = [i for i, y in labels.items() if not y]
    assert sum(i in left for i in clean) >= 0.95 * len(clean)
    before, after = seen["near_duplicates"]
    gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()}
    assert gone == set(brute_groups([(r["doc_id"], r["text"]) for r in before.collect()]))
    before, after = seen["secrets"]
    assert before.count() == after.count()
    assert not any(secrets.find_spans(r["text"], secrets.default_model()) for r in after.collect())
    before, after = seen["mixing"]
    share = lambda df: {r["source"]: r["count"] for r in df.groupBy("source").count().collect()}
    n, got = before.count(), share(after)
    assert set(got) == set(share(before)) and all(abs(k - n / len(got)) < 6 * (n / len(got)) ** 0.5 for k in got.values())
    assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in before.collect()}
    before, after = seen["sentencepiece"]
    assert before.count() == after.count()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] or "" for r in before.collect()}
    for r in after.collect():
        raw = texts[r["doc_id"]].encode()
        assert r["ids"] == library.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["begins"]) == len(r["ends"])
        assert all(0 <= a <= b <= len(raw) for a, b in zip(r["begins"], r["ends"])) and r["begins"] == sorted(r["begins"])


def test_run_leaves_one_table(spark, tmp_path):
    before = set(Path(spark.conf.get("spark.checkpoint.dir")).iterdir())
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0
    assert len(set(Path(spark.conf.get("spark.checkpoint.dir")).iterdir()) - before) == 1  # what the last stage reads


def test_stages_on_odd_tables(odd, nothing, spark):
    """Nulls in any column, empty and very long texts, repeated rows, an empty table, and columns named like those that stages use."""
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        empty = stage(spark, nothing, SF)
        assert empty.count() == 0 and empty.columns == out.columns
        rows = out.collect()
        if name == "sentencepiece":
            assert len(rows) == odd.count()
            continue
        assert out.columns == odd.columns and rows
        assert all(r[c] == "x" for r in rows for c in ("score", "copy", "n_copies", "mixed_source", "mixed_rate", "same", "keys", "spans")), name
        if name == "toxicity":
            assert len(rows) == odd.count()  # none of these is toxic by labels of other documents
        if name == "secrets":
            assert len(rows) == odd.count() and sum("0123456789abcdef0123456789abcdef" in (r["text"] or "") for r in rows) == 0


def test_near_duplicates_come_through_the_gray_order_index(spark, monkeypatch):
    """With no wide candidates at all, the stage still drops what the index links: copies with one changed word, but none below 0.8."""
    words = [f"w{i}" for i in range(400)]
    changed = [[*words[:k], "other", *words[k + 1 :]] for k in (50, 350)]
    far = [w + "x" for w in words]
    texts = [" ".join(w) for w in (words, *changed, far, words[:3], [*words[:3], "more"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none = lambda listed, *a: spark.createDataFrame([], "key long, a long, b long, over boolean")
    monkeypatch.setattr(near_duplicates, "candidate_pairs", none)
    kept = {r["doc_id"] for r in corpus_pipeline.without_near_duplicates(spark, docs, SF).collect()}
    bits = {i: simhash.fingerprint(t) for i, t in enumerate(texts)}
    close = {i for i in (1, 2) if (bits[i] ^ bits[0]).bit_count() <= 2}
    assert close and kept == set(range(6)) - close
