import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexgrid.llm import packing as K


@pytest.mark.parametrize("seed", range(6))
def test_assign(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 5, 40, 100, rng.randrange(1, 101)]) for _ in range(300)]
    where = K.assign(sizes, 100)
    used = defaultdict(int)
    for n, k in zip(sizes, where):
        used[k] += n
    assert max(used.values()) <= 100 and len(used) <= 1.1 * -(-sum(sizes) // 100) + 1
    assert K.assign([], 100) == [] and K.assign([100, 100], 100)[0] != K.assign([100, 100], 100)[1]


def test_costs_are_balanced():
    where = K.assign([60, 60, 30, 30, 10, 10], 100)
    assert sorted(where) == [0, 0, 0, 1, 1, 1]


def test_table(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, None, 3, 50, 99, 100, 101, 250, 1000])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long")
    got = K.pack(df, "doc_id", 100, group=20).collect()
    total, used = defaultdict(int), defaultdict(int)
    for r in got:
        total[r["doc_id"]] += r["tokens"]
        if r["container"] is not None:
            used[r["container"]] += r["tokens"]
    assert dict(total) == {i: n or 0 for i, n in rows} and max(used.values()) <= 100
    parts = defaultdict(list)
    for r in got:
        parts[r["doc_id"]].append((r["first_token"], r["tokens"]))
    for i, n in rows:
        assert len(parts[i]) == max(1, -(-(n or 0) // 100))  # whole unless it alone exceeds a container
        assert [a for a, _ in sorted(parts[i])] == [100 * k for k in range(len(parts[i]))]
    fill = K.fill(K.pack(df, "doc_id", 100), 100).first()
    assert fill["fullest"] <= 100 and fill["filled"] > 0.9
    assert K.pack(df.limit(0), "doc_id", 100).count() == 0


def test_emptiest_containers_are_packed_again(spark):
    df = spark.createDataFrame([(i, 3 + i * 37 % 61) for i in range(3000)], "doc_id long, tokens long")
    got = K.pack(df, "doc_id", 100, group=12)
    assert got.count() == got.select("doc_id").distinct().count() == 3000
    assert got.select(F.substring_index("container", "-", 1).alias("turn")).distinct().count() > 2
    one, many = K.fill(K.pack(df, "doc_id", 100), 100).first(), K.fill(got, 100).first()
    assert many["tokens"] == one["tokens"] and many["fullest"] <= 100 and many["filled"] > 0.9
