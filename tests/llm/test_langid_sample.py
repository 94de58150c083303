"""The sample of the language model counts rows, not ids."""

import random

from fieldweave.llm import langid

EN, DE = "the of and that with this from have been which".split(), "der die und nicht auch werden eine über schon größer".split()


def rows(n, seed):
    rng = random.Random(seed)
    text = lambda words: " ".join(rng.choice(words) for _ in range(12))
    return [(7, text(EN), "en") for _ in range(n)] + [(1000 + i, text(DE), "de") for i in range(n)]


def test_repeated_ids_are_drawn_row_by_row(spark):
    learn = spark.createDataFrame(rows(1500, 1), "doc_id long, text string, lang string").repartition(4)
    for most in (500, 2999, 5000):
        held = langid.drawn(learn, 3000, most)
        assert held.count() == min(most, 3000)
        share = held.filter("lang = 'en'").count() / held.count()
        assert 0.4 < share < 0.6
    model = langid.fit(learn, sample_rows=500)
    asked = spark.createDataFrame([(1, "the and of which this"), (2, "der und die nicht eine")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(asked, model).collect()} == {1: "en", 2: "de"}


def test_whole_copies_are_capped_too(spark):
    learn = spark.createDataFrame([(7, "the of and", "en")] * 2000 + [(8, "der die und", "de")], "doc_id long, text string, lang string")
    assert langid.drawn(learn, 2001, 300).count() == 300
