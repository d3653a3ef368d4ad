from pyspark.sql import functions as F

from lexgrid.operators import selection as X


def test_best_parameters(spark):
    grid = spark.createDataFrame([(1.5, 0.3, 0.8), (1.5, 0.75, 0.8), (0.9, 0.9, 0.8), (2.1, 0.3, 0.7)], "k1 double, b double, score double")
    assert X.best_parameters(grid, "score", ["k1", "b"]).first()[:2] == (0.9, 0.9)
    assert X.best_parameters(grid, "score", ["k1", "b"], prefer=(1.5, 0.75)).first()[:2] == (1.5, 0.75)
    assert X.best_parameters(grid, "score", ["k1", "b"], prefer=(2.1, 0.3)).first()[:2] == (0.9, 0.9)
    assert X.best_parameters(grid.limit(0), "score", ["k1", "b"]).count() == 0


def test_first_source(spark):
    a, b = (spark.createDataFrame(v, "k string, v string") for v in ([("x", "1"), ("n", None)], [("x", "2"), ("y", "3")]))
    assert {tuple(r) for r in X.first_source(["k"], a, b).collect()} == {("x", "1", 0), ("n", None, 0), ("y", "3", 1)}


def test_first_failing_and_rates(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (-1, 5)], "a int, b int")
    got = [r[0] for r in df.select(X.first_failing({"positive": F.col("a") > 0, "known": F.col("b") > 0})).collect()]
    assert got == ["known", None, "positive"]
    r = X.rates(df.withColumn("g", F.lit("g")), ["g"], {"high": (F.col("a") > 1, F.col("b").isNotNull()), "none": (F.lit(True), F.lit(False))}).first()
    assert (r["rows"], r["high"], r["none"]) == (3, 0.5, None)
