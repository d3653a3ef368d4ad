from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lexgrid.plans.streams import _run
from lexgrid.streaming import state as S

START = datetime(2024, 1, 1)


def stream(spark, path, rows, schema, files=3):
    for i in range(files):
        spark.createDataFrame(rows[i::files] if files > 1 else rows, schema).coalesce(1).write.mode("append").json(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)


def test_rate_limit(spark, tmp_path):
    rows = [("k", i, START + timedelta(minutes=5 * i)) for i in range(6)]
    df = stream(spark, f"{tmp_path}/a", rows, "k string, id int, at timestamp", files=1)
    got = {r["id"]: (r["in_window"], r["refused"]) for r in _run(S.rate_limit(df, "k", "id", "at", 900, 2), "update").collect()}
    assert got == {0: (1, False), 1: (2, False), 2: (3, True), 3: (3, True), 4: (3, True), 5: (3, True)}


def test_line_buffer(spark, tmp_path):
    path, schema = f"{tmp_path}/b", "k string, seq int, delta string"
    for n, piece in enumerate(["one\ntw", "o\nthree", "\n", "rest"]):
        spark.createDataFrame([("k", n, piece)], schema).coalesce(1).write.mode("append").json(path)
    df = spark.readStream.schema(schema).json(path)
    assert sorted(r["line"] for r in _run(S.line_buffer(df, "k", "seq", "delta"), "append").collect()) == ["one", "three", "two"]


def test_windows_and_repeats(spark, tmp_path):
    rows = [("a", i % 4, START + timedelta(minutes=i)) for i in range(12)]
    df = stream(spark, f"{tmp_path}/c", rows, "k string, id int, at timestamp")
    counts = _run(S.window_counts(df, "at", "5 minutes", ["k"], "1 day"), "update").groupBy("start").agg(F.max("n").alias("n")).orderBy("start").collect()
    assert [r["n"] for r in counts] == [5, 5, 2]
    assert _run(S.once_within(stream(spark, f"{tmp_path}/d", rows, "k string, id int, at timestamp"), ["id"], "at", "1 day"), "append").count() == 4
