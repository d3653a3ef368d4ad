import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexgrid.llm import neighbours as N


def clustered(seed=0, groups=60, each=6, alone=800, dim=64, noise=0.03):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    near = np.repeat(centres / np.linalg.norm(centres, axis=1)[:, None], each, 0) + noise * rng.standard_normal((groups * each, dim))
    return np.concatenate([near, rng.standard_normal((alone, dim))]).astype(np.float32)


def brute(keys, x, asked_keys, asked, k=10, least=0.9):
    u, q = (v / np.linalg.norm(v, axis=1)[:, None] for v in (np.asarray(x, float), np.asarray(asked, float)))
    out = {}
    for name, row in zip(asked_keys, q @ u.T):
        best = sorted((-s, key) for s, key in zip(row, keys) if key != name and s >= least)[:k]
        out |= {(name, key): i for i, (s, key) in enumerate(best, 1)}
    return out


def table(spark, keys, x):
    return spark.createDataFrame([(k, None if v is None else [float(n) for n in v]) for k, v in zip(keys, x)], "key string, vector array<float>")


def test_recall_against_brute_force(spark):
    x = clustered()
    keys = [f"{i:05}" for i in range(len(x))]
    want = brute(keys, x, keys, x)
    got = {(r["key"], r["neighbour"]): r["rank"] for r in N.nearest(table(spark, keys, x), leaf_size=64).collect()}
    assert len(want) > 1000 and len(want.keys() & got.keys()) >= 0.97 * len(want) and not got.keys() - brute(keys, x, keys, x, k=12).keys()


def test_copies_questions_and_dirty_vectors(spark):
    x = clustered(1, groups=5, each=3, alone=20)
    one = x[0]
    keys = [f"k{i:02}" for i in range(len(x))] + [f"copy{i:02}" for i in range(15)] + ["k00", "none", "short", "zero", "nan"]
    rows = [*x, *[one] * 15, one, None, [1.0, 2.0], np.zeros(64), np.full(64, np.nan)]
    asked = table(spark, ["q1", "q1", "q2", "bad"], [one, one, x[-1], np.zeros(64)])
    got = {}
    for r in N.nearest(table(spark, keys, rows), asked).collect():
        got.setdefault((r["kind"], r["key"]), []).append((r["rank"], r["neighbour"]))
    good = dict(zip(keys[: len(x) + 15], rows))
    want = brute(list(good), list(good.values()), [*good, "q1", "q2"], [*good.values(), one, x[-1]])
    assert {(k[1], n) for k, v in got.items() for _, n in v} == set(want)
    assert sorted(got["c", "copy03"])[0] == (1, "copy00") and len(got["q", "q1"]) == 10 and ("q", "bad") not in got


def test_empty(spark):
    none = table(spark, [], [])
    assert N.nearest(none).count() == 0 and N.nearest(none, table(spark, ["q"], [np.ones(64)])).count() == 0


def spiky(seed=0, n=400, dim=64):
    """One large number each, the rest small: codes lose most of the rest."""
    rng = np.random.default_rng(seed)
    x = rng.choice([0.0498, 0.0502], (n, dim)) * rng.choice([-1, 1], dim)
    x[np.arange(n), rng.integers(0, 4, n)] = 0.7
    return x.astype(np.float32)


@pytest.mark.parametrize("x", [clustered(2, groups=100, each=4, alone=400), spiky(), np.eye(64, dtype=np.float32)])
def test_codes_lie_within_their_angle(x):
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float64)
    codes, off = N._decode(N._codes(x), 64)
    assert isinstance(N._codes(x), pa.Array) and (np.arccos(np.clip((codes * x).sum(1), -1, 1)) <= off).all()
    sims = codes @ codes.T
    np.fill_diagonal(sims, -2)
    exact = x @ x.T
    np.fill_diagonal(exact, -2)
    kept = set(zip(*(v.tolist() for v in N._chosen(sims.astype(np.float32), off, off, 0.9, 10))))
    for i, row in enumerate(exact):  # none of the ten best is dropped
        tenth = np.sort(row)[-10]
        assert {(i, int(j)) for j in np.flatnonzero((row >= 0.9) & (row > tenth))} <= kept


def test_spiky_vectors_against_brute_force(spark):
    x = np.concatenate([spiky(1, 300), clustered(6, groups=5, each=4, alone=100)])
    keys = [f"{i:05}" for i in range(len(x))]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    cosine = np.round(u @ u.T, 12)
    got = {}
    for r in N.nearest(table(spark, keys, x), leaf_size=64).collect():
        got.setdefault(r["key"], []).append(cosine[int(r["key"]), int(r["neighbour"])])
    for i, row in enumerate(cosine):  # ties are many here: the cosines have to be right, rank by rank
        best = sorted((s for j, s in enumerate(row) if j != i and s >= 0.9), reverse=True)[:10]
        assert np.allclose(sorted(got.get(keys[i], []), reverse=True), best, atol=1e-6)


def test_complete_has_ten_of_every_vector(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 100)
    x = clustered(7, groups=20, each=14, alone=300)
    keys = [f"{i:05}" for i in range(len(x))]
    want = brute(keys, x, [*keys, "q"], [*x, -x[0]], least=-2)
    got = {(r["key"], r["neighbour"]): r["rank"] for r in N.nearest(table(spark, keys, x), table(spark, ["q"], [-x[0]]), complete=F.lit(True), leaf_size=64).collect()}
    assert len(want) == len(got) == 10 * (len(x) + 1) and len(want.keys() & got.keys()) >= 0.995 * len(want)


def test_large_leaves_are_compared_in_blocks(spark):
    x = clustered(8, groups=40, each=10, alone=100)
    keys = [f"{i:05}" for i in range(len(x))]
    want = brute(keys, x, keys, x)
    got = {(r["key"], r["neighbour"]) for r in N.nearest(table(spark, keys, x), leaf_size=8, sample=16).collect()}  # 4 leaves of some 125 rows each
    assert len(want.keys() & got) >= 0.99 * len(want)


def test_leaves_of_a_row_differ():
    x = clustered(3, alone=200)
    leaves = N.Forest(x[:300], 3, 4).leaves(x, 6)
    assert leaves.shape[1] == 9 and all(len(set(r)) == 9 for r in leaves.tolist())
