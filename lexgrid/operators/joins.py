"""Joins that have no name of their own in SQL, expressed as equi-joins.

Null keys match nothing. No join here compares all rows with all rows: prefixes are exploded into keys, ranges go through
buckets, bands through a small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..session import materialize


def nearest_ancestor(citations: DataFrame, nodes: DataFrame) -> DataFrame:
    """citations(..., path), nodes(scope, path, id) in the same scope -> the node of the path itself (score 1.0) or of its longest existing prefix (0.5).

    citations needs a column scope; citations that are no paths, or have no ancestor among the nodes, have no row.
    """
    ways = citations.withColumn("_p", F.explode(P.prefixes(F.col("path"))))
    up = nodes.groupBy("scope", F.col("path").alias("_p")).agg(F.min("id").alias("id"))
    hit = ways.join(up, ["scope", "_p"])
    best = hit.groupBy(*citations.columns).agg(F.max_by(F.struct(F.col("_p").alias("found"), "id"), F.length("_p")).alias("b"))
    return best.select(*citations.columns, "b.found", "b.id", F.when(F.col("b.found") == F.col("path"), 1.0).otherwise(0.5).alias("score"))


def lineage(nodes: DataFrame) -> DataFrame:
    """nodes(scope, path, id) -> (scope, id, ancestor, distance) for every proper ancestor that exists."""
    ways = nodes.select("scope", "id", P.depth(F.col("path")).alias("_d"), F.posexplode(P.prefixes(F.col("path"))).alias("_at", "_p"))
    up = nodes.select("scope", F.col("path").alias("_p"), F.col("id").alias("ancestor"))
    return ways.filter(F.col("_at") < F.col("_d") - 1).join(up, ["scope", "_p"]).select("scope", "id", "ancestor", (F.col("_d") - 1 - F.col("_at")).alias("distance"))


def one_hop(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges(scope, id, position, path), nodes(scope, path, id) -> (scope, id, target, position): what a node refers to, resolved to the
    nearest node, without itself and its own ancestors, each target once at its first position."""
    found = nearest_ancestor(edges.withColumnRenamed("id", "citer"), nodes).select("scope", F.col("citer").alias("id"), F.col("id").alias("target"), "position")
    above = lineage(nodes).select("scope", "id", F.col("ancestor").alias("target"))
    other = found.filter(F.col("id") != F.col("target")).join(above, ["scope", "id", "target"], "left_anti")
    return other.groupBy("scope", "id", "target").agg(F.min("position").alias("position"))


def two_hops(hops: DataFrame) -> DataFrame:
    """hops(scope, id, target) -> (scope, id, target, hops): 1 where direct, 2 where over one node between; the least counts. A node is no target of its own."""
    h = hops.select("scope", "id", "target").distinct()
    over = h.join(h.select("scope", F.col("id").alias("target"), F.col("target").alias("_far")), ["scope", "target"]).filter(F.col("id") != F.col("_far"))
    both = h.withColumn("hops", F.lit(1)).unionByName(over.select("scope", "id", F.col("_far").alias("target"), F.lit(2).alias("hops")))
    return both.groupBy("scope", "id", "target").agg(F.min("hops").alias("hops"))


def reconcile(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand on one side alone, or more than once on a side: (key..., in_left, in_right, issue). Null keys count like others."""
    count = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    a, b = count(left, "in_left").withColumns({f"_{k}": F.col(k) for k in key}).drop(*key), count(right, "in_right")
    on = [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in key]
    both = a.join(b, on, "full_outer")
    issue = F.when(F.col("in_right").isNull(), "only_left").when(F.col("in_left").isNull(), "only_right").when((F.col("in_left") > 1) | (F.col("in_right") > 1), "repeated")
    keys = [F.when(F.col("in_right").isNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in key]
    return both.select(*keys, F.coalesce("in_left", F.lit(0)).alias("in_left"), F.coalesce("in_right", F.lit(0)).alias("in_right"), issue.alias("issue")).filter("issue is not null")


def within(points: DataFrame, ranges: DataFrame, key: list[str], at: str, low: str, high: str, bucket: float) -> DataFrame:
    """points joined with the ranges (bounds included) of the same key that hold them. Buckets of the given width make it an equi-join;
    a wide range stands in as many buckets as it covers."""
    floor = lambda c: F.floor(F.col(c) / bucket)
    spread = ranges.filter(F.col(low) <= F.col(high)).withColumn("_b", F.explode(F.sequence(floor(low), floor(high))))
    return points.withColumn("_b", floor(at)).join(spread, [*key, "_b"]).filter((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("_b")


def count_within(points: DataFrame, ranges: DataFrame, key: list[str], at: str, low: str, high: str) -> DataFrame:
    """The ranges (bounds included, whole numbers) with the number `holds` of points of the same key that they hold, without making the pairs:
    points up to the upper bound less points below the lower one, by running sums over the distinct places of a key."""
    ranges = ranges.filter(F.col(low) <= F.col(high)).withColumns({"_below": F.col(low).cast("bigint") - 1, "_high": F.col(high).cast("bigint")})
    n = points.groupBy(*key, F.col(at).cast("bigint").alias("_at")).agg(F.count("*").alias("_n"))
    bounds = [ranges.select(*key, F.col(c).alias("_at")).distinct().withColumn("_n", F.lit(0).cast("bigint")) for c in ("_below", "_high")]
    places = n.unionByName(bounds[0]).unionByName(bounds[1]).groupBy(*key, "_at").agg(F.sum("_n").alias("_n"))
    upto = places.withColumn("_n", F.sum("_n").over(Window.partitionBy(*key).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)))
    side = lambda c: upto.select(*key, F.col("_at").alias(c), F.col("_n").alias(f"_n{c}"))
    both = ranges.join(side("_high"), [*key, "_high"]).join(side("_below"), [*key, "_below"])
    return both.withColumn("holds", F.col("_n_high") - F.col("_n_below")).drop("_below", "_high", "_n_below", "_n_high")


def as_of(events: DataFrame, states: DataFrame, key: list[str], at: str, since: str) -> DataFrame:
    """Each event with the last state of its key at or before it, by one sort of both together; states' columns are null before the first."""
    values = [c for c in states.columns if c not in key]
    e = events.select(*key, F.col(at).alias("_t"), F.lit(1).alias("_e"), F.struct(*events.columns).alias("_row"), F.lit(None).cast(states.select(F.struct(*values).alias("s")).schema["s"].dataType).alias("_s"))
    s = states.select(*key, F.col(since).alias("_t"), F.lit(0).alias("_e"), F.lit(None).cast(e.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_s"))
    order = Window.partitionBy(*key).orderBy("_t", "_e").rowsBetween(Window.unboundedPreceding, 0)
    return s.unionByName(e).withColumn("_last", F.last("_s", ignorenulls=True).over(order)).filter("_e = 1").select("_row.*", *[F.col("_last").getField(v).alias(v if v not in events.columns else f"state_{v}") for v in values])


def banded(amount: Column, bands: list[tuple[float, float | None, float]]) -> Column:
    """The sum over bands (lower, upper, rate in percent) of the amount's part in each, times its rate, as DECIMAL(20,4); null for null, 0 below all bands."""
    part = lambda lo, hi: F.greatest((amount if hi is None else F.least(amount, F.lit(hi).cast("decimal(20,4)"))) - F.lit(lo).cast("decimal(20,4)"), F.lit(0).cast("decimal(20,4)"))
    total = None
    for lo, hi, rate in bands:
        each = (part(lo, hi) * F.lit(rate).cast("decimal(7,4)") * F.lit("0.01").cast("decimal(4,2)")).cast("decimal(20,4)")
        total = each if total is None else (total + each).cast("decimal(20,4)")
    return total


def phrase_hits(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """texts(words ARRAY, ...), phrases(words ARRAY, ...) -> one row for each text and phrase in it: the columns of both but for the words.

    A phrase is looked up by its first word. Only numbers, words and phrases take part in that lookup: the texts come in once more for the pairs it finds, so
    no side of a join holds a text's words once a word. Phrases without words are in no text.
    """
    rest = [c for c in texts.columns if c != "words"]
    stored = materialize(texts.withColumnRenamed("words", "_all").withColumn("_text", F.monotonically_increasing_id()))
    sought = materialize(phrases.withColumn("_first", F.try_element_at("words", F.lit(1))).filter("_first is not null"))
    firsts = stored.select("_text", F.explode(F.array_distinct("_all")).alias("_first"))
    pairs = firsts.join(sought, "_first").drop("_first")
    hit = stored.join(pairs, "_text").filter(T.has_phrase(F.col("_all"), F.col("words")))
    return hit.select(*rest, *[c for c in phrases.columns if c != "words"])


#: Fixed value: how many first signs of a piece make the key by which it is looked up.
KEY = 3


def substrings_in(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """texts(text, ...), phrases(phrase, place) -> the other columns of every text and `phrases`, those that it has as a part in any case of letters, by place.

    Texts and phrases are cut at white space. Of each phrase the longest piece is looked up among the distinct pieces of all texts, by its first signs; a text that has the
    phrase has a piece with that one in it, so only such pairs of texts and phrases are compared. A phrase of white space alone is compared with every text.
    """
    rest = [c for c in texts.columns if c != "text"]
    cut = lambda c: F.split(c, r"\s+")
    stored = materialize(texts.select(*rest, F.lower("text").alias("_low"), F.monotonically_increasing_id().alias("_text")))
    longest = F.array_max(F.transform(cut("_sought"), lambda p: F.struct(F.length(p).alias("n"), p.alias("piece"))))["piece"]
    sought = phrases.filter("phrase is not null").select("place", "phrase", F.lower("phrase").alias("_sought")).withColumn("_anchor", longest)
    sought = materialize(sought.withColumn("_key", F.substring("_anchor", 1, KEY)))
    pieces = stored.select("_text", F.explode(F.array_distinct(cut("_low"))).alias("_piece"))
    keys = F.array_distinct(F.concat(F.array(F.lit("")), *[F.regexp_extract_all("_piece", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, KEY + 1)]))
    keyed = pieces.select("_piece").distinct().select("_piece", F.explode(keys).alias("_key"))
    among = materialize(keyed.join(sought.select("_key", "_anchor").distinct(), "_key").filter(F.col("_piece").contains(F.col("_anchor"))).select("_piece", "_anchor"))
    near = pieces.join(among, "_piece").join(sought.drop("_key"), "_anchor").groupBy("_text").agg(F.collect_set(F.struct("place", "phrase", "_sought")).alias("_near"))
    held = F.array_sort(F.filter("_near", lambda x: F.col("_low").contains(x["_sought"])))
    return stored.join(near, "_text", "left").select(*rest, F.coalesce(F.transform(held, lambda x: x["phrase"]), F.array().cast("array<string>")).alias("phrases"))
