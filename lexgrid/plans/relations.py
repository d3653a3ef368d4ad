"""Queries over the joins: citations, lineage, references between chunks, ranges and bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import joins as J
from ..operators import references as R
from ..sources.tables import once, table
from .corpus import CHUNKS, chunks


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Live chunks with valid paths; of several with one path the least id counts."""
    c = chunks(spark, d, "corpus_version", "node_path").filter(P.parts(F.col("node_path")).isNotNull())
    return c.groupBy(F.col("corpus_version").alias("scope"), F.col("node_path").alias("path")).agg(F.min("chunk_id").alias("id"))


def ancestor_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Each reference's target, or its nearest ancestor that exists."""
    refs = once(table(spark, d, "cross_references", "ref_id", "corpus_version", "target_path"), ["ref_id"])
    cited = refs.select("ref_id", F.col("corpus_version").alias("scope"), P.canonical(F.col("target_path")).alias("path")).filter("path is not null")
    return J.nearest_ancestor(cited, _nodes(spark, d)).select("ref_id", "found", F.col("id").alias("chunk_id"), "score")


def lineage(spark: SparkSession, d: str) -> DataFrame:
    return J.lineage(_nodes(spark, d)).select(F.col("id").alias("chunk_id"), "ancestor", "distance")


def _hops(spark: SparkSession, d: str, ids: DataFrame | None = None) -> DataFrame:
    """What chunks refer to; of ids(id) alone if given, before references are resolved by all their prefixes."""
    edges = chunks(spark, d, "corpus_version", "outgoing_refs").select(F.col("corpus_version").alias("scope"), F.col("chunk_id").alias("id"), F.posexplode("outgoing_refs").alias("position", "path"))
    edges = edges if ids is None else edges.join(ids, "id", "left_semi").select("scope", "id", "position", "path")
    return J.one_hop(edges.filter(P.parts(F.col("path")).isNotNull()), _nodes(spark, d))


def xref_one_hop(spark: SparkSession, d: str) -> DataFrame:
    return _hops(spark, d).select(F.col("id").alias("chunk_id"), "target", "position")


def two_hop(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 24 references or less, which two hops lead to, counted."""
    return J.two_hops(_hops(spark, d)).groupBy(F.col("id").alias("chunk_id"), "hops").agg(F.count("*").alias("targets"))


def vector_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without a vector, vectors without a live chunk."""
    v = once(table(spark, d, "chunk_embeddings", "chunk_id", "corpus_version"), ["chunk_id", "corpus_version"])
    return J.reconcile(chunks(spark, d, "corpus_version").select("corpus_version", "chunk_id"), v, ["corpus_version", "chunk_id"]).select("corpus_version", "chunk_id", "issue")


def resolution_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of references whose target stands among the live chunks, against the share that claims so, per type."""
    refs = once(table(spark, d, "cross_references", "ref_id", "corpus_version", "target_path", "ref_type", "resolved"), ["ref_id"])
    nodes = chunks(spark, d, "corpus_version", "node_path").select("corpus_version", R.same_citation(F.col("node_path")).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    joined = refs.withColumn("_k", R.same_citation(F.col("target_path"))).join(nodes, ["corpus_version", "_k"], "left")
    rate = lambda c: F.round(F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(1.0)), 6)
    return joined.groupBy("ref_type").agg(F.count("*").alias("refs"), rate(F.col("_hit")).alias("resolved"), rate(F.col("resolved")).alias("claimed"))


def ordered_targets(spark: SparkSession, d: str) -> DataFrame:
    """The targets of every citing path in the order of extraction."""
    refs = once(table(spark, d, "cross_references", "ref_id", "corpus_version", "from_path", "target_path"), ["ref_id"])
    listed = refs.groupBy("corpus_version", "from_path").agg(F.array_sort(F.collect_list(F.struct("ref_id", "target_path"))).alias("t"))
    return listed.select("corpus_version", "from_path", F.size("t").alias("refs"), F.substring(F.sha2(F.concat_ws("|", F.transform("t", lambda x: F.coalesce(x["target_path"], F.lit("")))), 256), 1, 16).alias("digest"))


def subtree_refs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct references of a root and all below it."""
    c = chunks(spark, d, "corpus_version", "node_path", "outgoing_refs").filter(P.parts(F.col("node_path")).isNotNull())
    each = c.select("corpus_version", P.parts(F.col("node_path"))[0].alias("root"), F.explode("outgoing_refs").alias("ref"))
    return each.groupBy("corpus_version", "root").agg(F.count("*").alias("refs"), F.countDistinct("ref").alias("different"))


def own_text_end(spark: SparkSession, d: str) -> DataFrame:
    """Where a chunk's own lines end: the start of its first child within it."""
    c = chunks(spark, d, "corpus_version", "parent_id", "char_start")
    up = c.select("corpus_version", F.col("chunk_id").alias("parent_id"), F.col("char_start").alias("_s"))
    return c.join(up, ["corpus_version", "parent_id"]).groupBy(F.col("parent_id").alias("chunk_id")).agg(F.min(F.col("char_start") - F.col("_s")).alias("own_end")).filter("own_end is not null")


def page_containment(spark: SparkSession, d: str) -> DataFrame:
    """How many other chunks of its version begin within each chunk's span, whatever its length and with or without a page. Counted without
    making the pairs, which grow faster than the chunks: the spans of a version overlap."""
    c = chunks(spark, d, "corpus_version", "char_start", "char_end").filter("char_start is not null and char_end is not null")
    spans = c.select("corpus_version", F.col("chunk_id").alias("span_id"), F.col("char_start").alias("lo"), F.col("char_end").alias("hi"))
    held = J.count_within(c, spans, ["corpus_version"], "char_start", "lo", "hi")
    return held.select("span_id", (F.col("holds") - 1).alias("holds")).filter("holds > 0")  # a span holds its own start


def version_as_of(spark: SparkSession, d: str) -> DataFrame:
    """For each document the corpus version that was the latest when it was published: versions as intervals, joined by months."""
    docs = table(spark, d, "documents", "doc_id", "published_at").filter("published_at is not null").withColumn("at", F.unix_micros("published_at"))
    versions = table(spark, d, "corpus_versions", "corpus_version", "ingested_at").distinct().withColumn("low", F.unix_micros("ingested_at"))
    until = F.coalesce(F.lead("low").over(Window.orderBy("low")) - 1, F.lit(4102444800000000))  # one row a version: a small table
    spans = versions.withColumn("high", until).withColumn("all", F.lit(1))
    held = J.within(docs.withColumn("all", F.lit(1)), spans, ["all"], "at", "low", "high", 30 * 86400 * 1e6).select("doc_id", "corpus_version")
    return docs.select("doc_id").join(held, "doc_id", "left")


def band_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Order totals through bands, as exact decimals."""
    amount = F.round(F.col("o_totalprice"), 2).cast("decimal(18,2)")
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", J.banded(amount, [(0, 50000, 0), (50000, 100000, 5), (100000, 200000, 10.5), (200000, None, 20)]).cast("double").alias("amount"))


_ROOT = "regexp_extract({p}, '^(Schedule [IVXLC]+|[0-9]{{1,3}}[A-Z]{{0,3}})', 1)"
_VALID = r"regexp_matches({p}, '^(Schedule [IVXLC]+|[0-9]{{1,3}}[A-Z]{{0,3}})(\([0-9A-Za-z]+\))*$')"
_NODES = f"nodes AS MATERIALIZED (SELECT corpus_version AS v, node_path AS p, min(chunk_id) AS id FROM {CHUNKS} WHERE {_VALID.format(p='node_path')} GROUP BY ALL)"
_PRE = "SELECT {c}, i, len(b) AS n, r || array_to_string(b[:i], '') AS pre FROM (SELECT *, unnest(generate_series(0, len(b))) AS i FROM (SELECT *, " + _ROOT.replace("{p}", "p") + r" AS r, regexp_extract_all(p, '\([0-9A-Za-z]+\)') AS b FROM {t}))"
_SP = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_CANON = rf"regexp_replace(regexp_replace(regexp_replace(min(target_path), '^{_SP}+|{_SP}+$', '', 'g'), '^(?i:sections?|sec\.?|s\.|u/s\.?){_SP}*', ''), '{_SP}+\(', '(', 'g')"
_HOP = f"""{_NODES}, e AS (SELECT corpus_version AS v, chunk_id AS id, generate_subscripts(outgoing_refs, 1) - 1 AS pos, unnest(outgoing_refs) AS p FROM {CHUNKS}), ev AS (SELECT * FROM e WHERE {_VALID.format(p='p')}),
w AS ({_PRE.format(c='v, id, pos', t='ev')}), f AS (SELECT w.v, w.id, pos, arg_max(nodes.id, i) AS target FROM w JOIN nodes ON nodes.v = w.v AND nodes.p = w.pre GROUP BY ALL),
l AS (SELECT x.id, nodes.id AS a FROM ({_PRE.format(c='v, id', t='nodes')}) x JOIN nodes ON nodes.v = x.v AND nodes.p = x.pre WHERE i < n),
hop AS MATERIALIZED (SELECT v, id, target, min(pos) AS position FROM f WHERE id <> target AND NOT EXISTS (SELECT 1 FROM l WHERE l.id = f.id AND l.a = f.target) GROUP BY ALL)"""

SQL = {
    "ancestor_resolve": f"""WITH {_NODES}, c AS (SELECT * FROM (SELECT ref_id, min(corpus_version) AS v, {_CANON} AS p FROM cross_references GROUP BY 1) WHERE {_VALID.format(p='p')}), w AS ({_PRE.format(c='ref_id, v, p', t='c')}),
        h AS (SELECT ref_id, w.p, arg_max(nodes.p, i) AS found, arg_max(nodes.id, i) AS chunk_id FROM w JOIN nodes ON nodes.v = w.v AND nodes.p = w.pre GROUP BY ALL) SELECT ref_id, found, chunk_id, CASE WHEN found = p THEN 1.0 ELSE 0.5 END AS score FROM h""",
    "lineage": f"WITH {_NODES} SELECT x.id AS chunk_id, nodes.id AS ancestor, CAST(n - i AS INT) AS distance FROM ({_PRE.format(c='v, id', t='nodes')}) x JOIN nodes ON nodes.v = x.v AND nodes.p = x.pre WHERE i < n",
    "xref_one_hop": f"WITH {_HOP} SELECT id AS chunk_id, target, CAST(position AS INT) AS position FROM hop",
    "two_hop": f"WITH {_HOP}, b AS (SELECT v, id, target, min(hops) AS hops FROM (SELECT v, id, target, 1 AS hops FROM hop UNION ALL SELECT a.v, a.id, c.target, 2 FROM hop a JOIN hop c ON a.v = c.v AND a.target = c.id WHERE a.id <> c.target) GROUP BY ALL) SELECT id AS chunk_id, hops, count(*) AS targets FROM b GROUP BY ALL",
    "vector_reconciliation": f"""WITH c AS (SELECT corpus_version, chunk_id FROM {CHUNKS}), v AS (SELECT DISTINCT corpus_version, chunk_id FROM chunk_embeddings)
        SELECT *, 'only_left' AS issue FROM (SELECT * FROM c EXCEPT SELECT * FROM v) UNION ALL SELECT *, 'only_right' FROM (SELECT * FROM v EXCEPT SELECT * FROM c)""",
    "resolution_rate": rf"""WITH k AS (SELECT ref_id, min(corpus_version) AS v, min(target_path) AS t, min(ref_type) AS ref_type, any_value(resolved) AS resolved FROM cross_references GROUP BY 1),
        n AS (SELECT DISTINCT corpus_version AS v, regexp_replace(regexp_replace(node_path, '{_SP}+', '', 'g'), '^(section|sec\.?|s\.|u/s)', '', 'i') AS p FROM {CHUNKS})
        SELECT ref_type, count(*) AS refs, round(avg(CASE WHEN n.p IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS resolved, round(avg(CASE WHEN resolved THEN 1.0 ELSE 0 END), 6) AS claimed FROM k LEFT JOIN n ON n.v = k.v AND n.p = regexp_replace(regexp_replace(k.t, '{_SP}+', '', 'g'), '^(section|sec\.?|s\.|u/s)', '', 'i') GROUP BY 1""",
    "ordered_targets": "WITH k AS (SELECT ref_id, min(corpus_version) AS corpus_version, min(from_path) AS from_path, min(target_path) AS t FROM cross_references GROUP BY 1) SELECT corpus_version, from_path, CAST(count(*) AS INT) AS refs, left(sha256(string_agg(coalesce(t, ''), '|' ORDER BY ref_id)), 16) AS digest FROM k GROUP BY ALL",
    "subtree_refs": f"SELECT corpus_version, {_ROOT.format(p='node_path')} AS root, count(*) AS refs, count(DISTINCT ref) AS different FROM (SELECT corpus_version, node_path, unnest(outgoing_refs) AS ref FROM {CHUNKS} WHERE {_VALID.format(p='node_path')}) GROUP BY ALL",
    "own_text_end": f"WITH c AS (SELECT * FROM {CHUNKS}) SELECT p.chunk_id, min(c.char_start - p.char_start) AS own_end FROM c JOIN c p ON p.corpus_version = c.corpus_version AND p.chunk_id = c.parent_id GROUP BY 1 HAVING min(c.char_start - p.char_start) IS NOT NULL",
    "page_containment": f"WITH c AS (SELECT * FROM {CHUNKS} WHERE char_start IS NOT NULL AND char_end IS NOT NULL), s AS (SELECT * FROM c WHERE char_start <= char_end) SELECT s.chunk_id AS span_id, count(*) AS holds FROM s JOIN c ON c.corpus_version = s.corpus_version AND c.char_start BETWEEN s.char_start AND s.char_end AND c.chunk_id <> s.chunk_id GROUP BY 1",
    "version_as_of": "SELECT doc_id, corpus_version FROM (SELECT doc_id, published_at FROM documents WHERE published_at IS NOT NULL) d ASOF LEFT JOIN (SELECT DISTINCT corpus_version, ingested_at FROM corpus_versions) v ON d.published_at >= v.ingested_at",
    "band_amounts": """SELECT o_orderkey, CAST(CAST((greatest(least(a, 100000) - 50000, 0) * 5) * 0.01 AS DECIMAL(20,4)) + CAST((greatest(least(a, 200000) - 100000, 0) * 10.5) * 0.01 AS DECIMAL(20,4)) + CAST((greatest(a - 200000, 0) * 20) * 0.01 AS DECIMAL(20,4)) AS DOUBLE) AS amount
        FROM (SELECT o_orderkey, CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS a FROM orders)""",
}
QUERIES = {q.__name__: q for q in (ancestor_resolve, lineage, xref_one_hop, two_hop, vector_reconciliation, resolution_rate, ordered_targets, subtree_refs, own_text_end, page_containment, version_as_of, band_amounts)}
