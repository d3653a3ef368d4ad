"""Queries do the whole job: what a fixed limit used to drop."""

import random
from datetime import datetime

import pytest

from lexgrid.operators import evaluation as E
from lexgrid.operators import joins as J
from lexgrid.plans import grounding, relations, retrieval


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_short_spans_and_spans_without_a_page_hold_chunks(spark, folder):
    spans = {"a": (0, 400, 1), "b": (100, 900, None), "c": (150, 160, 3), "d": (900, 950, 3), "e": (None, 10, 1), "f": (50, 40, 1)}
    rows = [(k, "v", None, lo, hi, page, None) for k, (lo, hi, page) in spans.items()] + [("g", "w", None, 120, 121, 1, None)]
    write(spark, folder, "chunks", rows, "chunk_id string, corpus_version string, node_path string, char_start int, char_end int, page_start int, removed_at timestamp")
    whole = {k: v for k, v in spans.items() if v[0] is not None}
    want = {k: n for k, (lo, hi, _) in whole.items() if (n := sum(lo <= v[0] <= hi for j, v in whole.items() if j != k))}
    assert {r["span_id"]: r["holds"] for r in relations.page_containment(spark, folder).collect()} == want and len(want) == 2


def test_gold_has_all_near_chunks(spark, folder):
    vector = lambda *x: [float(v) for v in x] + [0.0] * (64 - len(x))
    write(spark, folder, "query_vectors", [("q", vector(1)), ("none", vector(0, 1))], "query_id string, vectors array<float>")
    write(spark, folder, "chunk_embeddings", [(f"c{i:02}", vector(1, -i / 20)) for i in range(25)] + [("zero", vector(0)), ("null", None)], "chunk_id string, embedding array<float>")
    write(spark, folder, "chunks", [(f"c{i:02}", str(i + 1)) for i in range(25)], "chunk_id string, node_path string")
    got = {(r["query_id"], r["required"]) for r in retrieval._gold(spark, folder).collect()}
    assert got == {("q", str(i + 1)) for i in range(18)}  # 1 / sqrt(1 + (i / 20) ^ 2) >= 0.75


def test_rerank_scores_every_head_item(spark, folder):
    vector = lambda *x: [float(v) for v in x] + [0.0] * (64 - len(x))
    chunks = [("a", 1, "levy levy", vector(0.1, 1)), ("b", 2, "levy levy", vector(0.2, 1)), ("c", 3, "levy levy", None)]
    chunks += [(f"n{i:03}", 10 + i, "other", vector(1, i / 1000)) for i in range(120)]
    write(spark, folder, "query_vectors", [("q", "s", "levy", vector(1))], "query_id string, slice string, question string, vectors array<float>")
    write(spark, folder, "chunk_embeddings", [(k, v) for k, _, _, v in chunks], "chunk_id string, embedding array<float>")
    columns = "chunk_id string, ordinal int, chapter_numeral string, chapter_title string, node_path string, root_title string, text string, removed_at timestamp"
    write(spark, folder, "chunks", [(k, n, None, None, "1", "t", text, None) for k, n, text, _ in chunks], columns)
    got = [r["item_id"] for r in retrieval.rerank_head(spark, folder).orderBy("rank").collect()]
    assert got == ["b", "a", "c"]  # none is among the question's 100 nearest


def test_adoption_counts_what_a_slice_loses(spark):
    """Before, a run was adopted on its means alone, whatever a slice lost."""
    run = lambda recall: spark.createDataFrame([(q, float(r), float(r)) for q, r in recall.items()], "query_id string, recall double, ndcg double")
    old = dict(a1=1, a2=1, a3=0, b1=0, b2=0, b3=0, n1=1, n2=0.5)
    slices = spark.createDataFrame([(q, {"a": "alone", "b": "both"}.get(q[0])) for q in old], "query_id string, slice string")
    judged = lambda **new: E.judge(run(old | new), run(old), slices).first()
    got = judged(a1=0, a2=0, b1=1, b2=1, b3=1)
    assert got["new_recall"] > got["old_recall"] and got["new_ndcg"] > got["old_ndcg"]
    assert (got["adopted"], got["reasons"]) == (False, ["slice_loses:alone:2.00"])
    assert judged(a1=0, b1=1, b2=1)["adopted"]  # one query of a slice may be lost
    assert judged(n1=0, n2=0, b1=1, b2=1)["reasons"] == ["slice_loses:none:1.50"]
    assert judged(a1=0, a2=0, n1=0, n2=0)["reasons"] == ["recall_falls", "ndcg_falls", "nothing_rises", "slice_loses:alone:2.00", "slice_loses:none:1.50"]
    assert judged()["reasons"] == ["nothing_rises"]


def test_terms_are_found_as_parts_of_texts(spark, folder):
    """Before, a term was found only as whole words, chunks were counted and the order of the glossary was lost."""
    lines = [("d2", "x\n“Rent” means a\n“net rent” means b"), ("d1", "(1) “levy” means c\n(2) “कर” means d\n“rent” means e"), ("d0", "“x” is not"), ("d3", None)]
    write(spark, folder, "documents", lines, "doc_id string, text string")
    texts = {"a": "Parents' NET\xa0RENTS", "b": "net\nrent of the le\xadvy", "c": "सेवाकर", "d": "none", "e": "", "f": None, "gone": "levy"}
    rows = [(k, t, None if k != "gone" else datetime(2024, 1, 1)) for k, t in texts.items()]
    write(spark, folder, "chunks", rows, "chunk_id string, text string, removed_at timestamp")
    got = {r["chunk_id"]: r["terms"] for r in grounding.terms_in(spark, folder).collect()}
    assert got == {"a": ["rent", "Rent", "net rent"], "b": ["levy", "rent", "Rent"], "c": ["कर"], "d": [], "e": []}


def test_parts_of_texts_are_those_of_a_plain_search(spark):
    rng = random.Random(5)
    some = lambda signs, most: "".join(rng.choice(signs) for _ in range(rng.randint(0, most)))
    texts = [some("abAB  \n§é税😀", 30) for _ in range(300)] + ["", " ", "税" * 3000 + "務😀A", "İstanbul Straße"]
    phrases = sorted({some("abA §é税😀", 5) for _ in range(150)} | {"", " ", "  ", "務😀a", "i̇s", "SSE", "ßE"})
    found = J.substrings_in(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), spark.createDataFrame([(p, n) for n, p in enumerate(phrases)], "phrase string, place int"))
    assert {r["id"]: r["phrases"] for r in found.collect()} == {n: [p for p in phrases if p.lower() in t.lower()] for n, t in enumerate(texts)}
