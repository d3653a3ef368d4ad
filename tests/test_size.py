"""Queries at size: what used to be sent or held whole."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexgrid.functions import text as T
from lexgrid.operators import fusion as U
from lexgrid.operators import joins as J
from lexgrid.operators import ranking as R
from lexgrid.plans import relations, retrieval, selection


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_phrases_are_found_with_the_texts_words_kept_out_of_the_lookup(spark):
    """terms_in and root_shares: every row that was looked up held the whole text, and that side was the one broadcast."""
    texts = spark.createDataFrame([("a", "the net rent of land"), ("b", "net net rent"), ("c", "rent net"), ("d", ""), ("e", "net rent")], "id string, text string")
    terms = spark.createDataFrame([("net rent", "net rent"), ("land", "land"), ("none", ""), ("rent of", "rent of")], "term string, text string")
    hits = J.phrase_hits(texts.select("id", T.tokens(F.col("text")).alias("words")), terms.select("term", T.tokens(F.col("text")).alias("words")))
    assert rows(hits, "id", "term") == [("a", "land"), ("a", "net rent"), ("a", "rent of"), ("b", "net rent"), ("e", "net rent")]
    assert hits.columns == ["id", "term"]


def test_a_task_holds_and_sends_k_rows_a_query_whatever_it_reads():
    """Before, every batch of 1,000 items sent k rows a query, as tuples held for the whole batch."""
    rng, best = np.random.default_rng(3), R._Best(40, 5)
    q, s = rng.integers(0, 40, 20_000), np.round(rng.random(20_000), 2)
    for a in range(0, 20_000, 1000):
        best.add(q[a : a + 1000], s[a : a + 1000], np.arange(a, a + 1000))
    assert best.score.shape == best.no.shape == (40, 5)
    for i in range(40):
        want = sorted((-s[j], j) for j in np.flatnonzero(q == i))[:5]
        assert list(zip(-best.score[i], best.no[i])) == want
    assert sum(len(b["data"][0].as_py()) for b in best.packets()) == 40 * 5 * 16


def test_rankings_over_many_blocks_and_ties_are_whole_and_stored(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(300)] * 20
    items = spark.createDataFrame([(f"i{i:05}", i % 7, t) for i, t in enumerate(texts)], "item_id string, tie long, text string")
    queries = spark.createDataFrame([("a", "w1 w2 w3"), ("b", "w3 w2 w1"), (None, "w4")], "query_id string, text string")
    got = R.bm25(items, R.word_weights(queries), 50)
    assert got._materialized  # read twice, ranked once
    df = {w: sum(w in t.split() for t in texts) for w in words}
    mean = sum(len(t.split()) for t in texts) / len(texts)
    for name, asked in (("a", "w1 w2 w3"), ("b", "w1 w2 w3"), (None, "w4")):
        scores = []
        for i, t in enumerate(texts):
            own = t.split()
            s = sum(np.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * own.count(w) * 2.5 / (own.count(w) + 1.5 * (0.7 + 0.3 * len(own) / mean)) for w in asked.split() if w in own)
            scores.append((-round(s, 9), i % 7, f"i{i:05}"))
        want = [x[2] for x in sorted(scores)[:50]]
        assert [r["item_id"] for r in got.filter(F.col("query_id").eqNullSafe(F.lit(name))).orderBy("rank").collect()] == want


def test_near_and_knn_agree_with_doubles(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 4))
    items = spark.createDataFrame([(f"i{i:05}", 0, [float(v) for v in r]) for i, r in enumerate(x)] + [("hole", 0, [1.0, None, 0.0, 0.0])], "item_id string, tie long, vector array<double>")
    queries = spark.createDataFrame([(f"q{i}", [float(v) for v in r]) for i, r in enumerate(x[:7])], "query_id string, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cosine = np.round(unit[:7] @ unit.T, 9)
    assert rows(R.near(items, queries, 0.9, 4), "query_id", "item_id") == sorted((f"q{q}", f"i{i:05}") for q, i in np.argwhere(cosine >= 0.9))
    knn = R.knn(items, queries, 100, 4)
    for q in range(7):
        assert [r["item_id"] for r in knn.filter(F.col("query_id") == f"q{q}").orderBy("rank").collect()] == [f"i{i:05}" for i in np.argsort(-cosine[q], kind="stable")[:100]]
    assert knn._materialized


def test_sums_of_words_that_queries_share_are_made_once_and_scores_stay_those_of_doubles():
    """bm25_topk: before, every query went through all its words in every block of items, in doubles."""
    rng, k = np.random.default_rng(6), 3
    names, code, value, length = [f"w{i:02}" for i in range(40)], [], [], []
    for i in range(60):
        own = [0, 1, *(2 + rng.choice(38, rng.integers(1, 6), replace=False))] if i < 59 else list(range(40))
        code += own
        value += [1.0, 0.5, *rng.choice([0.25, 1.0, 3.0], len(own) - 2)]
        length.append(len(own))
    code, value, length = np.array(code), np.array(value), np.array(length)
    turns = R._in_turn(code, value, length)
    assert sorted(q for q, _, _ in turns) == list(range(60)) and all(len(w) == length[q] for q, _, w in turns)
    assert sum(len(w) - same for _, same, w in turns) <= length.sum() - 2 * 59
    texts = [[names[w] for w in rng.choice(40, rng.integers(0, 12))] for _ in range(3001)]
    mean = np.mean([len(t) for t in texts])
    for weights in (value, np.where(code == 5, -value, value), np.ones(len(code))):
        table = pa.table({"_no": pa.array(range(3001), pa.int64()), "words": pa.array(texts, pa.list_(pa.string()))})
        best = R._bm25_best(R._regrouped(iter(table.to_batches(700)), 1000), names, code, weights, length, mean, k, 1.5, 0.3)
        for q, end in enumerate(np.cumsum(length)):
            scores = []
            for i, t in enumerate(texts):
                s = sum(v * t.count(names[w]) * 2.5 / (t.count(names[w]) + 1.5 * (0.7 + 0.3 * len(t) / mean)) for w, v in zip(code[end - length[q] : end], weights[end - length[q] : end]))
                scores.append((-round(s, 9), i))
            assert list(zip(-best.score[q], best.no[q])) == sorted(scores)[:k]


def test_references_of_some_chunks_alone_are_resolved_as_among_those_of_all(spark):
    """evidence_pack: before, the references of every chunk were taken apart into prefixes, and those of the ranked chunks chosen afterwards."""
    d = "/root/testdata/sf0.001"
    whole = relations._hops(spark, d).select("id", "target", "position").cache()
    ids = whole.select("id").distinct().orderBy("id").limit(40)
    some = relations._hops(spark, d, ids)
    assert rows(some, "id", "target", "position") == rows(whole.join(ids, "id", "left_semi"), "id", "target", "position") != []


def asked_by_words(monkeypatch):
    """The ids of the questions that BM25 ranks, by call."""
    seen, bm25 = [], R.bm25
    monkeypatch.setattr(R, "bm25", lambda items, weights, *a, **k: (seen.append({r[0] for r in weights.select("query_id").distinct().collect()}), bm25(items, weights, *a, **k))[1])
    return seen


def test_fallback_ranks_by_words_only_questions_without_a_near_chunk(spark, monkeypatch):
    """fallback_leg: before, all questions were ranked by words, and ten deep by vectors."""
    d = "/root/testdata/sf0.01"
    dense, lexical = retrieval._knn(spark, d).filter("score >= 0.75"), retrieval._bm25(spark, d)
    want = rows(retrieval._shown(U.fallback(dense, lexical)), "query_id", "item_id", "rank", "score")
    near = {r[0] for r in dense.select("query_id").distinct().collect()}
    seen = asked_by_words(monkeypatch)
    assert rows(retrieval.fallback_leg(spark, d), "query_id", "item_id", "rank", "score") == want
    assert near and seen[0] and len(seen) == 1 and not seen[0] & near


def test_metrics_rank_only_questions_that_ask_for_something(spark, monkeypatch):
    """retrieval_metrics, metrics_by_slice and miss_causes: before, all questions were ranked, those without a wanted path too."""
    d = "/root/testdata/sf0.01"
    gold = retrieval._gold(spark, d).cache()
    run = retrieval._bm25(spark, d, 20).join(retrieval._paths(spark, d), "item_id")
    want = rows(retrieval.E.retrieval_scores(run.select("query_id", "rank", "path"), gold, 10).select("query_id", "required", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")]), "query_id", "required", "recall", "mrr", "ndcg")
    asked = {r[0] for r in gold.select("query_id").distinct().collect()}
    seen = asked_by_words(monkeypatch)
    assert rows(retrieval.retrieval_metrics(spark, d), "query_id", "required", "recall", "mrr", "ndcg") == want != []
    assert sum(r["wanted"] for r in selection.miss_causes(spark, d).collect()) == gold.count()
    assert len(seen) == 2 and all(ids and ids <= asked for ids in seen) and len(asked) < retrieval.questions(spark, d).count()
