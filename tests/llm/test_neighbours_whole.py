import numpy as np
from test_neighbours import brute, clustered, table

from lexgrid.llm import neighbours as N


def test_dense_cluster_is_exact(spark):
    x = clustered(4, groups=1, each=300, alone=100, noise=0.01)
    keys = [f"{i:05}" for i in range(len(x))]
    want = brute(keys, x, [*keys, "q"], [*x, x[0] + 0.001])
    got = {(r["key"], r["neighbour"]) for r in N.nearest(table(spark, keys, x), table(spark, ["q"], [x[0] + 0.001])).collect()}
    assert len(want) == 3010 and got == want.keys()


def test_deep_trees_keep_their_recall(spark):
    x = clustered(5, groups=400, each=3, alone=800, noise=0.035)
    keys = [f"{i:05}" for i in range(len(x))]
    want = brute(keys, x, keys, x)
    got = {(r["key"], r["neighbour"]) for r in N.nearest(table(spark, keys, x), leaf_size=1).collect()}
    assert len(want) > 1000 and len(want.keys() & got) >= 0.99 * len(want)
