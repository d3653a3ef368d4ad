import random

import pytest
from pyspark.sql import functions as F

from lexgrid.llm import splitting as S

PARTS = ["word", "Straße", "x_1", ",", ".", "; ", ". ", "\n", "\n\n", " ", " ", "日本語。", "½", "é", "(a) ", "🙂", "\x1c"]


def count(text):
    return len(S.TOKEN.findall(text or ""))


@pytest.mark.parametrize("seed", range(20))
def test_pieces(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 900)))
    limit, overlap = rng.choice([(20, 5), (50, 0), (64, 63), (512, 48)])
    pieces = list(S.split(text, limit, overlap))
    assert (len(pieces) > 1) == (count(text) > limit)
    if count(text):
        assert "".join(text[p[2] : p[3]] for p in pieces) == text
    for p, before in zip(pieces, [None, *pieces]):
        assert p[4] == count(p[6]) <= limit and p[6] == text[p[1] : p[3]]
        if before:
            assert count(text[p[1] : p[2]]) == min(overlap, count(text[: p[2]]))


def test_strong_boundaries_are_kept():
    text = "one two three four five six.\n\nseven eight nine ten eleven."
    assert [p[5] for p in S.split(text, 9, 1)] == ["paragraph", "end"]


def test_one_endless_word_and_nothing():
    assert [p[4] for p in S.split("a" * 100_000, 10, 2)] == [1]
    assert list(S.split(None, 10, 2)) == list(S.split("", 10, 2)) == list(S.split(" \n ", 10, 2)) == []
    with pytest.raises(ValueError):
        list(S.split("a", 5, 5))


def test_table_with_nulls_and_clashing_columns(spark):
    rows = [("a", "x " * 30, 1), ("b", None, 2), ("c", "", None), ("d", "short", 4), ("e", "x " * 30, 1)]
    df = spark.createDataFrame(rows, "id string, text string, piece int")
    got = S.split_texts(df, ["id"], "text", 20, 4).collect()
    assert sorted({r["id"] for r in got if r["piece"] > 0}) == ["a", "e"] and sorted({r["id"] for r in got}) == ["a", "d", "e"]
    assert S.split_texts(df.limit(0), ["id"], "text", 20, 4).count() == 0


def test_java_counts_as_python(spark):
    texts = [("".join(random.Random(i).choices(PARTS, k=60)),) for i in range(50)]
    got = spark.createDataFrame(texts, "t string").select("t", S.token_count(F.col("t")).alias("n")).collect()
    assert all(r["n"] == count(r["t"]) for r in got)
