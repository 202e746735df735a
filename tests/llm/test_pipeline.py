"""The pipeline on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline as P
from tidemark.llm import suffix_dedup


@pytest.fixture
def folder(spark, tmp_path):
    r = random.Random(9)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    rows, labels = [], []
    for i in range(200):
        bad = i % 5 == 0
        rows.append((i, text(60) + (" vile scum" if bad else ""), "en", f"s{i % 3}", 1))
        labels.append((i, 1, int(bad)))
    base, passage = text(200), text(70)
    rows += [(1000, base, "en", "s0", 1), (1001, base.replace(" w", "  w", 1), "en", "s1", 1), (1002, base + " more", "en", "s2", 1)]
    rows += [(1010, text(30) + " " + passage, "en", "s0", 1), (1011, text(30) + " " + passage, "en", "s1", 1), (1012, None, None, None, None), (1013, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = P.drop_toxic(spark, docs, folder)
    ids = {r["doc_id"] for r in clean.collect()}
    assert ids == {r["doc_id"] for r in docs.collect() if not (r["doc_id"] < 200 and r["doc_id"] % 5 == 0)}
    one = P.drop_near_copies(spark, clean, folder)
    assert ids - {r["doc_id"] for r in one.collect()} == {1001, 1002}
    cut = {r["doc_id"]: r for r in P.cut_passages(spark, one, folder).collect()}
    assert len(cut) == one.count() and len(cut[1010]["text"].split()) == 100 and len(cut[1011]["text"].split()) == 30
    assert cut[1011]["n_chars"] == len(cut[1011]["text"]) and cut[1012]["text"] is None and cut[1013]["text"] == ""
    assert P.cut_passages(spark, one, folder).columns == docs.columns
    out = P.run(spark, folder)
    assert set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and out.count() > 150


def test_text_after_a_cut():
    assert suffix_dedup.without_spans(" a b\n c  d ", [(1, 3)]) == " a d "
