from test_garbled import CLEAN

from lexgrid.llm import garbled as G


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["restored"] for r in G.repair(df, "doc_id", "text").collect()}


def test_words_that_are_rare_in_a_large_corpus_are_known(spark):
    large = ["levy " * 100_000] * 15  # one word in 1.5 million is under 2e-6
    clean = ["The term плательщик means a person who pays.", CLEAN["ru"], "A note on плательщик and склад again."]
    wrong = "Here the " + "плательщик".encode("cp1251").decode("latin-1") + " files the return."
    assert found(spark, [*clean, *large, wrong]) == {len(clean) + len(large): "Here the плательщик files the return."}


def test_a_garbled_text_that_is_copied_often_is_found(spark):
    wrong = "The cafÃ© on the naÃ¯ve faÃ§ade pays."
    clean = ["A café is exempt.", "Some façade and a naïve owner."]
    assert found(spark, [*clean, *[wrong] * 50]) == {k: "The café on the naïve façade pays." for k in range(2, 52)}


def test_garbled_words_of_many_texts_that_stand_nowhere_else(spark):
    wrong = [f"Note {k} by the cafÃ© and the faÃ§ade." for k in range(40)]
    assert found(spark, [*wrong, "A résumé, a leçon and the rôle.", "Un été à Besançon."]) == {k: f"Note {k} by the café and the façade." for k in range(40)}
