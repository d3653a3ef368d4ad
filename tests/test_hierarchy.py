import random

import pytest

from lexgrid.operators import hierarchy as H

NODES = "scope string, id string, parent string, mark string"


def brute(rows):
    at = {(s, i): (p if p is not None and p.strip() else None, m or "") for s, i, p, m in rows if i is not None}
    out = {}
    for s, i in at:
        line, k = [], i
        while k is not None and (s, k) in at and k not in line:
            line.append(k)
            k = at[s, k][0]
        if k is None:
            out[s, i] = ("root" if len(line) == 1 else "tree", "".join(at[s, x][1] for x in reversed(line)), len(line), tuple(reversed(line)))
        elif (s, k) not in at:
            out[s, i] = ("no_root", None, None, None)
        else:
            loop = line[line.index(k) :]
            out[s, i] = ("cycle" if i in loop else "below_cycle", None, None, None)
    return out


def run(spark, rows, **more):
    tree = H.hierarchy(spark.createDataFrame(rows, NODES), **more).collect()
    return {(r["scope"], r["id"]): (r["status"], r["path"], r["depth"], None if r["ancestors"] is None else tuple(r["ancestors"])) for r in tree}, tree


def random_rows(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        scope = rng.choice(["v", "w", None])
        parent = rng.choice([None, "", " ", "nobody", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", f"n{rng.randrange(max(1, k))}"])
        rows.append((scope, f"n{k}", parent, rng.choice(["a", "(b)", None])))
    return rows


@pytest.mark.parametrize("largest", [200_000, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, largest):
    rows = random_rows(seed)
    got, tree = run(spark, rows, largest=largest)
    assert got == brute(rows)


def test_loops_chains_and_empty_input(spark):
    ring = [("v", f"r{i}", f"r{(i + 1) % 7}", "x") for i in range(7)] + [("v", "tail", "r3", "x"), ("v", "self", "self", "x"), ("v", None, "r1", "x")]
    chain = [("v", f"c{i:03}", f"c{i - 1:03}" if i else None, f"({i})") for i in range(120)]
    got, tree = run(spark, ring + chain)
    assert got == brute(ring + chain)
    assert sum(r["back_edge"] for r in tree if r["status"] == "cycle") == 2
    assert run(spark, [])[0] == {}


def test_descendants(spark):
    rows = [("v", "a", None, "1"), ("v", "b", "a", "(1)"), ("v", "c", "b", "(a)"), ("v", "d", "a", "(2)")]
    pairs = H.descendants(H.hierarchy(spark.createDataFrame(rows, NODES))).collect()
    assert {(r["ancestor"], r["descendant"], r["distance"]) for r in pairs} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1)}


def test_a_chain_of_a_million_rows_is_walked_in_bounded_memory():
    n = 1_000_000
    rows = [("v", str(i), str(i - 1) if i else None, "x", "root", "0", None) for i in range(n)]
    deepest = 0
    for row in H._walk(rows, full=False):
        deepest = max(deepest, row[4])
        assert row[5] is None and row[6] is None
    assert deepest == n


@pytest.mark.parametrize("largest", [200_000, 3])
def test_expected_paths(spark, largest):
    rows = [
        ("v", "a", None, "1", "1"), ("v", "b", "a", "(1)", "1(1)"), ("v", "c", "b", "(a)", "1(1)(a)"), ("v", "d", "a", "(2)", "2(2)"),  # d is moved
        ("v", "e", "d", "(b)", "1(2)(b)"), ("v", "f", "d", "(b)", "2(2)(b)"), ("v", "g", "a", "é", "1é"), ("v", "h", "g", None, "1é"), ("v", "i", "g", "x", None), ("v", "j", "k", "x", "x"),
    ]
    df = spark.createDataFrame(rows, NODES + ", carry string")
    got = {r["id"]: (r["expected"], r["path"], r["depth"]) for r in H.hierarchy(df, full=False, largest=largest).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": True, "b": True, "c": True, "d": False, "e": True, "f": False, "g": True, "h": True, "i": False, "j": None}
    assert all(v[1] is None for v in got.values()) and got["e"][2] == 3


def test_a_long_chain_beyond_one_task(spark):
    n = 3000
    rows = [("v", f"c{i:05}", f"c{i - 1:05}" if i else None, "ab", "ab" * (i + 1) if i % 7 else "x") for i in range(n)]
    got = H.hierarchy(spark.createDataFrame(rows, NODES + ", carry string"), full=False, largest=100).collect()
    assert sorted(r["depth"] for r in got) == list(range(1, n + 1)) and all(r["root"] == "c00000" for r in got)
    assert all(r["expected"] == bool(int(r["id"][1:]) % 7) for r in got)
