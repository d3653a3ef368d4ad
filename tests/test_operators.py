import math
import random
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgrid.functions import text as T
from lexgrid.operators import evaluation as E
from lexgrid.operators import evidence as V
from lexgrid.operators import fusion as U
from lexgrid.operators import joins as J
from lexgrid.operators import quality as Q
from lexgrid.operators import ranking as R
from lexgrid.operators import sequences as S
from lexgrid.sources import stores
from lexgrid.sources.tables import once

RANK = "query_id string, item_id string, rank int, score double"


def test_bm25_against_brute_force(spark):
    rng = random.Random(1)
    words = "levy rent gain net land the of a".split()
    docs = {f"d{i}": " ".join(rng.choices(words, k=rng.randrange(0, 12))) for i in range(40)} | {"null": None}
    asked = {"q1": "net gain gain", "q2": "absent", "q3": "the land of rent", "q4": ""}
    items = spark.createDataFrame([(k, 0, v) for k, v in docs.items()], "item_id string, tie long, text string")
    queries = spark.createDataFrame(list(asked.items()), "query_id string, text string")
    got = {(r["query_id"], r["rank"]): (r["item_id"], round(r["score"], 6)) for r in R.bm25(items, R.word_weights(queries), 5).collect()}
    toks = {k: (v or "").split() for k, v in docs.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    want = {}
    for q, text in asked.items():
        scores = []
        for d, t in toks.items():
            s = sum(math.log(1 + (n - df + 0.5) / (df + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.7 + 0.3 * len(t) / avg)) for w in set(text.split()) if (df := sum(w in x for x in toks.values())))
            if s > 0:
                scores.append((-round(s, 9), d))
        want |= {(q, i): (d, round(-s, 6)) for i, (s, d) in enumerate(sorted(scores)[:5], 1)}
    assert got == want
    assert R.bm25(items, R.word_weights(queries.limit(0)), 5).count() == 0
    assert R.bm25(items, R.rm3(items, queries), 5).filter("query_id = 'q3'").count() == 5


def test_knn(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((50, 4))
    rows = [(f"i{k}", 0, [float(v) for v in r]) for k, r in enumerate(x)] + [("zero", 0, [0.0] * 4), ("short", 0, [1.0]), ("none", 0, None), ("nan", 0, [float("nan")] * 4)]
    items = spark.createDataFrame(rows, "item_id string, tie long, vector array<double>")
    queries = spark.createDataFrame([("q", [1.0, 2.0, 0.0, 0.0]), ("bad", [0.0] * 4)], "query_id string, vector array<double>")
    got = [r["item_id"] for r in R.knn(items, queries, 5, 4).orderBy("rank").collect()]
    cos = x @ np.array([1, 2, 0, 0]) / np.linalg.norm(x, axis=1)
    assert got == [f"i{k}" for k in np.argsort(-cos)[:5]]


def test_fusion(spark):
    a = spark.createDataFrame([("q", "x", 1, 9.0), ("q", "y", 2, 8.0), ("r", "x", 1, 1.0)], RANK)
    b = spark.createDataFrame([("q", "y", 1, 0.9), ("q", "z", 2, 0.8), ("s", "z", 1, 1.0)], RANK)
    lists = lambda df: {q: [r["item_id"] for r in sorted(df.collect(), key=lambda r: r["rank"]) if r["query_id"] == q] for q in "qrs"}
    assert lists(U.rrf(a, b)) == {"q": ["y", "x", "z"], "r": ["x"], "s": ["z"]}
    assert lists(U.fallback(a, b)) == {"q": ["x", "y"], "r": ["x"], "s": ["z"]}
    assert lists(U.prepend(b, a)) == {"q": ["y", "z", "x"], "r": ["x"], "s": ["z"]}
    assert lists(U.interleave(a, b)) == {"q": ["x", "y", "z"], "r": ["x"], "s": ["z"]}
    scores = spark.createDataFrame([("q", "y", 5.0)], "query_id string, item_id string, new_score double")
    assert lists(U.rerank(a, scores, 2))["q"] == ["y", "x"]


def test_retrieval_scores(spark):
    ranking = spark.createDataFrame([("q", 1, "70"), ("q", 2, "70(1)(a)"), ("q", 3, "9"), ("e", 1, "1")], "query_id string, rank int, path string")
    gold = spark.createDataFrame([("q", "70(1)(a)"), ("q", "9(2)"), ("n", "5")], "query_id string, required string")
    got = {r["query_id"]: r for r in E.retrieval_scores(ranking, gold, 10).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert got["q"]["recall"] == 1 and got["q"]["mrr"] == 1 and abs(got["q"]["ndcg"] - (1 + 0.5) / ideal) < 1e-12
    assert (got["n"]["recall"], got["n"]["mrr"], got["n"]["ndcg"]) == (0, 0, 0)
    strict = {r["query_id"]: r["mrr"] for r in E.retrieval_scores(ranking, gold, 10, lenient=False).collect()}
    assert strict["q"] == 0.5


def test_kappa_percentiles_verdict(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, False), (False, False)], "a boolean, b boolean")
    assert abs(df.agg(E.kappa(F.col("a"), F.col("b"))).first()[0] - 0.5) < 1e-12
    values = list(range(1, 11))
    p = E.percentiles(spark.createDataFrame([("g", v) for v in values], "g string, v int"), "v", ["g"]).first()
    assert (p["floor_50"], p["even_50"], p["ceil_50"], p["ceil_95"], p["floor_99"]) == (6, 5, 5, 10, 10)
    ok, why = E.verdict({"one": F.lit(True), "two": F.lit(False), "three": F.lit(None).cast("boolean")})
    assert spark.range(1).select(ok, why).first()[:] == (False, ["two", "three"])


def test_joins(spark):
    nodes = spark.createDataFrame([("v", "70", "a"), ("v", "70(1)", "b"), ("v", "9", "c")], "scope string, path string, id string")
    cited = spark.createDataFrame([("v", "70(1)(a)"), ("v", "9"), ("v", "5"), ("v", "bad path"), ("v", None)], "scope string, path string")
    assert {(r["path"], r["id"], r["score"]) for r in J.nearest_ancestor(cited, nodes).collect()} == {("70(1)(a)", "b", 0.5), ("9", "c", 1.0)}
    edges = spark.createDataFrame([("v", "b", 0, "70"), ("v", "b", 1, "9(3)"), ("v", "b", 2, "9"), ("v", "c", 0, "70")], "scope string, id string, position int, path string")
    hops = J.one_hop(edges, nodes)
    assert {(r["id"], r["target"], r["position"]) for r in hops.collect()} == {("b", "c", 1), ("c", "a", 0)}
    assert {(r["id"], r["target"], r["hops"]) for r in J.two_hops(hops).collect()} == {("b", "c", 1), ("c", "a", 1), ("b", "a", 2)}
    left, right = (spark.createDataFrame([(x,) for x in v], "k string") for v in (["a", "b", None, "d", "d"], ["b", "c", None, "d"]))
    assert {(r["k"], r["issue"]) for r in J.reconcile(left, right, ["k"]).collect()} == {("a", "only_left"), ("c", "only_right"), ("d", "repeated")}
    points = spark.createDataFrame([("p", float(x)) for x in (0, 5, 10, 11)], "page string, y double")
    boxes = spark.createDataFrame([("p", "box", 5.0, 10.0), ("q", "other", 0.0, 99.0)], "page string, box string, top double, bottom double")
    assert sorted(r["y"] for r in J.within(points, boxes, ["page"], "y", "top", "bottom", 3.0).collect()) == [5.0, 10.0]
    t = lambda d: datetime(2024, 1, d)
    ev = spark.createDataFrame([("k", t(1)), ("k", t(5)), ("k", t(3))], "k string, at timestamp")
    st = spark.createDataFrame([("k", t(3), "x"), ("k", t(4), "y")], "k string, since timestamp, s string")
    assert {(r["at"].day, r["s"]) for r in J.as_of(ev, st, ["k"], "at", "since").collect()} == {(1, None), (3, "x"), (5, "y")}


@pytest.mark.parametrize("amount, tax", [("0", 0), ("400000", 0), ("400001", 0.05), ("1200000", 60000), ("-5", 0)])
def test_bands(spark, amount, tax):
    bands = [(0, 400000, 0), (400000, 800000, 5), (800000, None, 10)]
    assert float(spark.range(1).select(J.banded(F.lit(amount).cast("decimal(18,2)"), bands)).first()[0]) == tax


def test_sequences(spark):
    df = spark.createDataFrame([("d", 0, "x"), ("d", 1, None), ("d", 2, "y"), ("d", 3, None)], "g string, n int, v string")
    got = df.select("n", S.carry_forward(F.col("v"), "g", "n"), S.look_behind(F.col("v"), "g", "n"), S.look_ahead(F.col("v"), "g", "n")).orderBy("n").collect()
    assert [tuple(r)[1:] for r in got] == [("x", None, "y"), ("x", "x", "y"), ("y", "x", None), ("y", "y", None)]
    assert [tuple(r) for r in S.islands(df, "g", "n", F.col("v").isNull()).orderBy("first").collect()] == [("d", 1, 1, 1), ("d", 3, 3, 1)]
    nums = spark.createDataFrame([("g", n) for n in (3, 5, 5, 8)], "g string, n int")
    assert sorted(r["number"] for r in S.missing_numbers(nums, "g", "n").collect()) == [1, 2, 4, 6, 7]
    w = spark.createDataFrame([([100, 60, 10, 200, 5],), ([],)], "s array<int>").select(S.windows(F.col("s"), F.col("s"), 150)).collect()
    assert [(x["first"], x["last"], x["total"]) for x in w[0][0]] == [(0, 1, 160), (2, 3, 210), (4, 4, 5)] and w[1][0] == []
    t = spark.createDataFrame([("k", datetime(2024, 1, 1, 0, m)) for m in (0, 5, 15)], "k string, at timestamp")
    assert [r[0] for r in t.withColumn("c", S.in_window(t, "k", "at", 900)).orderBy("at").select("c").collect()] == [1, 2, 2]


def test_fact_state_equals_a_fold(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice("xy"), rng.choice(["stated", "inferred", "missing"]), i, str(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "e string, f string, s string, o int, v string")
    state, log = {}, set()
    for e, f, s, o, v in rows:
        if s == "missing" or (s == "inferred" and state.get((e, f), ("",))[0] == "stated"):
            continue
        if (e, f) in state:
            log.add((e, f, o, state[e, f][1], v))
        state[e, f] = (s, v)
    assert {(r["e"], r["f"]): (r["s"], r["v"]) for r in S.merge_facts(df, "e", "f", "s", ["o"]).collect()} == state
    assert {tuple(r) for r in S.overrides(df, "e", "f", "s", "v", "o").collect()} == log


def test_pack(spark):
    rows = [("q", 1, "b", ["b", "a"], 40), ("q", 2, "big", ["big"], 900), ("q", 3, "a", ["a"], 50), ("q", 4, "c", ["c", "a"], 10), ("q", 5, "d", ["d"], 45)]
    got = V.pack(spark.createDataFrame(rows, "query_id string, rank int, item_id string, lineage array<string>, tokens int"), 100).orderBy("position").collect()
    assert [(r["item_id"], r["rank"], r["tokens"]) for r in got] == [("a", 1, 50), ("d", 5, 45)]


def evidence_by_hand(hits, refs, defs, budget, expand, fill):
    """One query: hits and defs [(item, lineage, tokens)], refs {item: [(item, lineage, tokens)]}."""
    out = []  # (item, rank, tokens, lineage, role, cited_by)

    def offer(item, line, n, rank, role, by):
        if {u[0] for u in out} & set(line):
            return
        gone = [u for u in out if item in u[3]]
        if n + sum(u[2] for u in out if u not in gone) > budget:
            return
        ranks = [u[1] for u in gone if u[4] == "retrieved"] + [rank] * (role == "retrieved")
        new = (item, min(ranks), n, line, "retrieved", None) if ranks else (item, rank, n, line, role, by)
        at = out.index(gone[0]) if gone else len(out)
        out[:] = [u for u in out[:at]] + [new] + [u for u in out[at:] if u not in gone]

    def refer():
        for u in [u for u in out if u[4] == "retrieved"]:
            for t in refs.get(u[0], ()):
                offer(*t, u[1], "referenced", u[0])

    head = expand or len(hits)
    for r, h in enumerate(hits, 1):
        if r == head + 1:
            refer()
        offer(*h, r, "retrieved", None)
    if expand and len(hits) <= head:
        refer()
    if fill and not expand:
        refer()
    for x in defs:
        offer(*x, len(hits) + 1, "definition", None)
    return [(u[0], u[1], u[2], u[4], u[5]) for u in out]


def test_evidence_against_a_plain_walk(spark):
    rng = random.Random(5)
    names = [f"{r}{c}" for r in "abcdef" for c in ("", "1", "11", "12", "2", "21")]
    line = {n: [n[:k] for k in range(len(n), 0, -1)] for n in names}
    size = {n: rng.randrange(5, 60) for n in names}
    refs = {n: rng.sample(names, rng.randrange(3)) for n in names}
    refs = {n: [t for t in v if t not in line[n]] for n, v in refs.items()}
    full = lambda n: (n, line[n], size[n])
    targets = spark.createDataFrame([(n, i, t, line[t], size[t]) for n, v in refs.items() for i, t in enumerate(v)], "id string, position int, target string, lineage array<string>, tokens int")
    hits = {f"q{i}": rng.sample(names, 9) for i in range(12)}
    cand = spark.createDataFrame([(q, i, *full(n)) for q, v in hits.items() for i, n in enumerate(v, 1)], "query_id string, rank int, item_id string, lineage array<string>, tokens int")
    defs = {q: rng.sample(names, 2) for q in hits}
    told = spark.createDataFrame([(q, i, *full(n)) for q, v in defs.items() for i, n in enumerate(v)], "query_id string, seq int, item_id string, lineage array<string>, tokens int")
    for expand, fill in ((0, False), (0, True), (4, False)):
        got = {}
        for r in V.rows(V.evidence(cand, 150, targets, told, expand, fill)).orderBy("query_id", "position").collect():
            got.setdefault(r["query_id"], []).append((r["item_id"], r["rank"], r["tokens"], r["role"], r["cited_by"]))
        want = {q: evidence_by_hand([full(n) for n in v], {n: [full(t) for t in x] for n, x in refs.items()}, [full(n) for n in defs[q]], 150, expand, fill) for q, v in hits.items()}
        assert got == want
    assert V.pack(cand.limit(0)).count() == 0


def test_excerpts(spark):
    text = "\n".join(["opening words " * 10] + ["filler line " * 10] * 6 + ["the rare quokka " * 10])
    cut = lambda t, q, room: spark.range(1).select(V.excerpt(F.lit(t), F.lit(q), F.lit(room), 20)).first()[0]
    got = cut(text, "quokka", 80)
    assert got == "\n".join(["opening words " * 10, "[...]", "the rare quokka " * 10])
    assert cut(text, "quokka", 59) is None and cut(text, "quokka", 60) == got  # 20 + 30 and two marks of 5
    assert cut(text, "opening", 500) is None and cut(text, "filler", 500) is None and cut(None, "quokka", 500) is None and cut(text, None, 500) is None  # in most runs, or nowhere else
    assert cut("", "quokka", 500) is None
    many = "\n".join(["first " * 20, "alpha beta " * 10, "alpha x " * 10, "y z " * 10, "u v " * 10])
    assert cut(many, "alpha beta", 500) == "\n".join(["first " * 20, "alpha beta " * 10, "alpha x " * 10, "[...]"])
    assert cut(many, "alpha beta", 50) == "\n".join(["first " * 20, "alpha beta " * 10, "[...]"])


def test_oversize_hits_become_excerpts(spark):
    text = "\n".join(["opening words " * 80] + ["filler line " * 80] * 8 + ["the rare quokka " * 60])
    rows = [("q", 1, "s", ["s"], 900, "small", 0), ("q", 2, "big", ["big"], 1500, text, 3), ("q", 3, "t", ["t"], 500, "other", 0)]
    df = spark.createDataFrame(rows, "query_id string, rank int, item_id string, lineage array<string>, tokens int, text string, context int").withColumn("query", F.lit("quokka"))
    got = [(r["item_id"], r["rank"], r["tokens"]) for r in V.rows(V.evidence(df, 1350)).orderBy("position").collect()]
    assert got == [("s", 1, 900), ("big", 2, 348)]  # 160 + 180 + 5 tokens and the lead-in's 3; t does not fit beside the reserve
    below = df.unionByName(df.filter("rank = 3").select("query_id", F.lit(4).alias("rank"), F.lit("under").alias("item_id"), F.array(F.lit("under"), F.lit("big")).alias("lineage"), F.lit(5).alias("tokens"), "text", "context", "query"))
    assert "big" not in {r["item_id"] for r in V.rows(V.evidence(below, 1350)).collect()}


def test_lines_and_markers(spark):
    lines = spark.createDataFrame([(["levy on rent is due", "levy on rent is due now", "other matter", None],), (None,)], "l array<string>")
    assert [r[0] for r in lines.select(V.drop_repeats(F.col("l"))).collect()] == [[0, 2, 3], []]
    assert spark.range(1).select(V.collapse_markers(F.lit("x [4] [4][5]"))).first()[0] == "x [4][5]"


def test_quality_and_once(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("a", 1)], "k string, n int")
    assert Counter(tuple(r) for r in Q.violations(df, "k", {"present": F.col("n").isNotNull(), "small": F.col("n") < 1}).collect()) == Counter({("present", "b"): 1, ("small", "a"): 2, ("small", "b"): 1})
    assert [r["key"] for r in Q.not_unique(df, ["k"], "u").collect()] == ["a"]
    assert once(df, ["k"]).count() == 2 and once(df.limit(0), ["k"]).count() == 0


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "o int, text string")
    stores.write_jsonl(df.repartition(3), f"{tmp_path}/s", "o", corpus_version="v1")
    back = stores.read_jsonl(spark, f"{tmp_path}/s", df.schema, "o", corpus_version="v1")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(stores.StoreMismatch):
        stores.read_jsonl(spark, f"{tmp_path}/s", df.schema, "o", corpus_version="v2")
    assert stores.digest(df, "o") == stores.digest(df.repartition(5), "o") != stores.digest(df.limit(19), "o")
    chunks = spark.createDataFrame([("v", "a", "x", ["1"]), ("v", "b", "y", [])], "corpus_version string, chunk_id string, text string, outgoing_refs array<string>")
    vectors = spark.createDataFrame([("v", "a", [1.0]), ("v", "b", [1.0])], "corpus_version string, chunk_id string, embedding array<double>")
    assert stores.ingest(chunks, vectors, f"{tmp_path}/db") == "written" and stores.ingest(chunks, vectors, f"{tmp_path}/db") == "present"
    with pytest.raises(stores.StoreMismatch):
        stores.ingest(chunks.withColumn("text", F.lit("z")), vectors, f"{tmp_path}/db")
    assert stores.migration_gaps(["0001_a.sql", "0003_b.sql"]) == [2]
    (tmp_path / "book.txt").write_text("one\ftwo")
    assert [(r["page"], r["text"]) for r in stores.read_pages(spark, f"{tmp_path}/book.txt").collect()] == [(0, "one"), (1, "two")]


def test_stub_embedding_has_unit_length(spark):
    v = spark.range(1).select(T.stub_embedding("query", F.lit("levy"))).first()[0]
    assert len(v) == 32 and abs(sum(x * x for x in v) - 1) < 1e-9
