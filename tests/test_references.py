from datetime import datetime

from pyspark.sql import functions as F

from lexgrid.operators import references as R

T = lambda day: datetime(2024, 1, day)
REF = "ref_table string, ref_field string, ref_key string, scope string, key string, at timestamp"
REC = "scope string, key string, seen_at timestamp, removed_at timestamp"


def run(spark, refs, records):
    r, c = spark.createDataFrame(refs, REF), spark.createDataFrame(records, REC)
    state = R.fold(R.reference_deltas(r), R.record_deltas(c))
    return {(x["ref_key"], x["reason"], x["period"]) for x in R.orphans(r, state).collect()}


def test_reasons(spark):
    ref = lambda k, key, day=5, scope="v": ("t", "f", k, scope, key, T(day) if day else None)
    refs = [ref("1", "a"), ref("2", "b"), ref("3", "c"), ref("4", "d"), ref("5", "gone", None), ref("6", "a", scope="w"), ref("7", "c", None), ref("8", "half"), ref("9", "n", scope=None)]
    records = [("v", "a", T(1), None), ("v", "b", T(1), T(2)), ("v", "c", T(9), None), ("v", "d", T(5), None), ("v", "half", T(1), T(2)), ("v", "half", T(9), None), (None, "n", T(1), None)]
    assert run(spark, refs, records) == {("2", "deleted", "2024-01"), ("3", "late", "2024-01"), ("5", "missing", "unknown"), ("6", "missing", "2024-01")}


def test_folding_in_parts_is_folding_at_once(spark):
    refs = spark.createDataFrame([("t", "f", str(i), "v", f"k{i % 3}", T(5)) for i in range(9)], REF)
    recs = spark.createDataFrame([("v", "k0", T(1), None), ("v", "k1", T(1), T(3))], REC)
    whole = R.fold(R.reference_deltas(refs), R.record_deltas(recs))
    parts = R.fold(R.fold(R.reference_deltas(refs.limit(4))), R.record_deltas(recs), R.reference_deltas(refs.exceptAll(refs.limit(4))))
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, parts.collect()), key=str)


def test_batches_of_signed_deltas_maintain_the_state(spark):
    refs = spark.createDataFrame([("t", "f", str(i), "v", f"k{i % 4}", T(5)) for i in range(12)] + [("t", "f", "x", None, "n", None)], REF)
    recs = spark.createDataFrame([("v", "k0", T(1), None), ("v", "k1", T(1), T(3)), ("v", "k2", T(9), None), (None, "n", T(1), T(2))], REC)
    back = refs.filter("key = 'k3'")  # these are withdrawn later
    one = R.maintain(None, R.reference_deltas(refs), R.insert_deltas(recs.filter("key <> 'k2'")))
    assert {r["key"] for r in R.suspects(one).collect()} == {"k2", "k3"}
    two = R.maintain(one, R.reference_deltas(back, -1), R.insert_deltas(recs.filter("key = 'k2'")), R.removal_deltas(recs.filter("removed_at is not null")))
    kept = refs.filter("key <> 'k3'")
    whole = R.fold(R.reference_deltas(kept), R.record_deltas(recs))
    assert sorted(map(tuple, two.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert {(r["key"], r["reason"]) for r in R.orphans(kept, two).collect()} == {("k1", "deleted"), ("k2", "late"), ("n", "deleted")}
    none = R.maintain(two, R.reference_deltas(kept, -1))
    assert none.filter("refs <> 0").count() == 0 and R.suspects(none).count() == 0


def test_hot_key_and_empty_tables(spark):
    refs = [("t", "f", str(i), "v", "hot", T(5)) for i in range(3000)] + [("t", "f", "x", "v", "ok", T(5))]
    found = run(spark, refs, [("v", "ok", T(1), None)])
    assert len(found) == 3000
    assert run(spark, [], [("v", "ok", T(1), None)]) == set()
    assert len(run(spark, refs[:2], [])) == 2


def test_spellings(spark):
    paths = ["12(1)(a)", " 12 (1)(a)", "Section 12(1)(a)", "sec 12(1)\n(a)", "S.12(1)(a)", "u/s 12(1)(a)", " 12(1)(a)", "SEC. 12(1)(a)"]
    df = spark.createDataFrame([(p,) for p in [*paths, "12(1)(A)", "Schedule II(1)"]], "p string")
    got = [r[0] for r in df.select(R.same_citation(F.col("p"))).collect()]
    assert set(got[:8]) == {"12(1)(a)"} and got[8:] == ["12(1)(A)", "ScheduleII(1)"]
    blanks = spark.createDataFrame([(None,), ("",), ("  \t",), ("x",)], "p string").select(R.blank(F.col("p"))).collect()
    assert [r[0] for r in blanks] == [True, True, True, False]
