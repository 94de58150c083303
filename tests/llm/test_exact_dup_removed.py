"""Shared passages of 400 bytes go from every document, clean documents lose nothing; n_removed says so, n_bytes is the input's."""

import random

import __spark_entry__


def test_shared_passages_and_clean_documents(spark, tmp_path):
    rng = random.Random(1)
    words = lambda n, a, b: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(a, b))) for _ in range(n))
    shared = words(60, 6, 9)
    assert len(shared) >= 400
    texts = {i: f"{words(60, 4, 9)} {shared if i % 2 else words(60, 6, 9)} {words(60, 4, 9)}" for i in range(20)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in __spark_entry__.queries()["op8_exact_dup"](spark, str(tmp_path)).collect()}
    assert all((r["n_removed"] >= len(shared)) == bool(i % 2) and (r["n_removed"] == 0) == (not i % 2) for i, r in got.items())
    assert all(r["n_bytes"] == len(texts[i]) for i, r in got.items())
