"""Passages of over 50 words that stand in several documents are counted, also under 400 bytes, where the contract removes nothing."""

import random

import pytest

import __spark_entry__

rng = random.Random(4)
words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(3, 6))) for _ in range(n))
SHORT, LONG, FEW = words(51), words(100), words(50)
TEXTS = {
    1: f"{words(30)} {SHORT}\n{words(20)}",
    2: f"{words(10)}\n\n{SHORT} {words(40)}",
    3: f"{words(30)} {LONG} {words(20)}",
    4: f"{LONG}",
    5: f"{words(9)} {FEW} {words(9)}",
    6: f"{words(9)} {FEW} {words(9)}",
    7: words(200),
    8: None,
}


@pytest.fixture(scope="module")
def got(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return {r["doc_id"]: r for r in __spark_entry__.queries()["op8_exact_dup"](spark, at).collect()}


def test_passages_counted_in_words(got):
    assert len(SHORT.encode()) < 400 < len(LONG.encode())
    sizes = {1: SHORT, 2: SHORT, 3: LONG, 4: LONG}
    assert {i: r["n_passage_bytes"] for i, r in got.items()} == {i: len(sizes.get(i, "").encode()) for i in TEXTS}


def test_removal_goes_by_bytes_alone(got):
    assert all(r["n_bytes"] == len((TEXTS[i] or "").encode()) for i, r in got.items())
    assert {i for i, r in got.items() if r["n_removed"]} == {3, 4} and got[4]["n_removed"] == len(LONG.encode())
