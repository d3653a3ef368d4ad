"""Queries over ranking, fusion and evaluation: questions against chunks and chunk vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import evaluation as E
from ..operators import fusion as U
from ..operators import ranking as R
from ..session import materialize
from ..sources.tables import once, table
from .corpus import CHUNKS, QUESTIONS, chunks, questions


def _items(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "ordinal", "chapter_numeral", "chapter_title", "node_path", "root_title", "text")
    crumb = P.breadcrumb(F.col("chapter_numeral"), F.col("chapter_title"), F.col("node_path"), F.col("root_title"))
    return c.select(F.col("chunk_id").alias("item_id"), F.col("ordinal").cast("bigint").alias("tie"), F.concat_ws("\n", crumb, "text").alias("text"))


def _weights(spark: SparkSession, d: str, of: DataFrame | None = None, but: DataFrame | None = None) -> DataFrame:
    asked = questions(spark, d).select("query_id", F.col("question").alias("text"))
    for some, how in ((of, "left_semi"), (but, "left_anti")):
        if some is not None:
            asked = asked.join(some.select("query_id").distinct(), "query_id", how)
    return R.word_weights(asked)


def _bm25(spark: SparkSession, d: str, k: int = 10, of: DataFrame | None = None, but: DataFrame | None = None) -> DataFrame:
    """of(query_id): the questions whose ranking is read, if not all are; but(query_id): those whose ranking nothing reads."""
    return R.bm25(_items(spark, d), _weights(spark, d, of, but), k)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "chunk_embeddings", "chunk_id", "embedding"), ["chunk_id"]).select(F.col("chunk_id").alias("item_id"), F.lit(0).cast("bigint").alias("tie"), F.col("embedding").alias("vector"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "query_vectors", "query_id", "vectors"), ["query_id"]).select("query_id", F.col("vectors").alias("vector"))


def _knn(spark: SparkSession, d: str, k: int = 10, of: DataFrame | None = None) -> DataFrame:
    """of as for _bm25."""
    asked = _asked(spark, d)
    return R.knn(_vectors(spark, d), asked if of is None else asked.join(of.select("query_id").distinct(), "query_id", "left_semi"), k)


def _shown(ranking: DataFrame) -> DataFrame:
    return ranking.withColumn("score", F.round("score", 6))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of any state with valid paths: (item_id, path)."""
    return once(table(spark, d, "chunks", "chunk_id", "node_path"), ["chunk_id"]).filter(P.parts(F.col("node_path")).isNotNull()).select(F.col("chunk_id").alias("item_id"), F.col("node_path").alias("path"))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """What a question asks for: the paths of chunks whose vector has a cosine of 0.75 or more with its own, however many."""
    near = R.near(_vectors(spark, d), _asked(spark, d), 0.75)
    return near.join(_paths(spark, d), "item_id").select("query_id", F.col("path").alias("required")).distinct()


def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and idf of every word of the live chunks."""
    items = _items(spark, d).select(T.tokens(F.col("text")).alias("words"))
    n = items.agg(F.count("*").alias("n"))
    df = items.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("word", "df", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_bm25(spark, d))


def bm25_rm3(spark: SparkSession, d: str) -> DataFrame:
    """The ranking by queries that a relevance model of their first ten chunks has widened."""
    tokens = R.tokenized(_items(spark, d))
    asked = questions(spark, d).select("query_id", F.col("question").alias("text"))
    return _shown(R.bm25(tokens, R.rm3(tokens, asked)))


def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_knn(spark, d))


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return _shown(U.rrf(_bm25(spark, d, 100), _knn(spark, d, 100)))


def rerank_head(spark: SparkSession, d: str) -> DataFrame:
    """The lexical ranking with its first 20 re-sorted by cosine, each pair's own."""
    lexical = _bm25(spark, d, 40)
    new = R.pair_cosines(lexical.filter("rank <= 20"), _vectors(spark, d), _asked(spark, d))
    return U.rerank(lexical, new.withColumnRenamed("score", "new_score"))


def fallback_leg(spark: SparkSession, d: str) -> DataFrame:
    """Vector ranking of near chunks, lexical ranking for questions that have none, which are the only ones ranked by words."""
    near = materialize(U.ranked(R.near(_vectors(spark, d), _asked(spark, d), 0.75), k=10))
    return _shown(U.fallback(near, _bm25(spark, d, but=near)))


def interleaved(spark: SparkSession, d: str) -> DataFrame:
    return U.interleave(_bm25(spark, d, 20), _knn(spark, d, 20), k=20).drop("score")


def shortcut(spark: SparkSession, d: str) -> DataFrame:
    """Near chunks first, then the lexical ranking."""
    return U.prepend(_knn(spark, d).filter("score >= 0.75"), _bm25(spark, d), k=10).drop("score")


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Of every question that asks for something; the others are not ranked."""
    gold = materialize(_gold(spark, d))
    ranking = _bm25(spark, d, 20, of=gold).join(_paths(spark, d), "item_id").select("query_id", "rank", "path")
    scores = E.retrieval_scores(ranking, gold, 10)
    return scores.select("query_id", "required", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


def metrics_by_slice(spark: SparkSession, d: str) -> DataFrame:
    return E.by_slice(retrieval_metrics(spark, d), questions(spark, d))


def metrics_at_k(spark: SparkSession, d: str) -> DataFrame:
    """One ranking scored at k = 1, 5, 10 and 20, strictly and leniently."""
    ranking = materialize(_bm25(spark, d, 20).join(_paths(spark, d), "item_id").select("query_id", "rank", "path"))
    gold = materialize(_gold(spark, d))
    out = None
    for k in (1, 5, 10, 20):
        for lenient in (True, False):
            s = E.retrieval_scores(ranking, gold, k, lenient).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("recall", "mrr", "ndcg")]).select(F.lit(k).alias("k"), F.lit(lenient).alias("lenient"), "*")
            out = s if out is None else out.unionByName(s)
    return out


def run_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Lexical against vector ranking, ten deep."""
    return E.agreement(_bm25(spark, d), _knn(spark, d), 10).withColumn("jaccard", F.round("jaccard", 6))


def vector_guard(spark: SparkSession, d: str) -> DataFrame:
    """Usable, unit and missing vectors per corpus version."""
    v = once(table(spark, d, "chunk_embeddings", "corpus_version", "chunk_id", "embedding"), ["corpus_version", "chunk_id"])
    x = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y))
    finite = F.coalesce((F.size("embedding") == 64) & (norm > 0) & (norm < float("inf")) & ~F.isnan(norm), F.lit(False))
    return v.groupBy("corpus_version").agg(F.count("*").alias("vectors"), F.count_if(finite).alias("usable"), F.count_if(finite & (F.abs(norm - 1) <= 1e-4)).alias("of_unit_length"))


def intrusions(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that stand among the first ten of eight questions or more without earning credit there."""
    gold = _gold(spark, d).withColumn("path", F.explode(P.prefixes(F.col("required")))).select("query_id", "path").distinct()
    run = _bm25(spark, d).join(_paths(spark, d), "item_id").select("query_id", "item_id", "path")
    return run.join(gold, ["query_id", "path"], "left_anti").groupBy("item_id").agg(F.count("*").alias("queries")).filter("queries >= 8")


def adoption(spark: SparkSession, d: str) -> DataFrame:
    """Whether fusion may replace the lexical ranking: no measure falls, one rises, no slice of questions loses more than one. Both are of the questions that ask for something."""
    gold, paths = materialize(_gold(spark, d)), materialize(_paths(spark, d))
    lexical, dense = _bm25(spark, d, 100, of=gold), _knn(spark, d, 100, of=gold)
    scores = lambda r: E.retrieval_scores(r.join(paths, "item_id").select("query_id", "rank", "path"), gold, 10)
    judged = E.judge(scores(U.rrf(lexical, dense, k=20)), scores(lexical.filter("rank <= 20")), questions(spark, d))
    measures = [c for c in judged.columns if c not in ("adopted", "reasons")]
    return judged.select(*[F.round(c, 6).alias(c) for c in measures], "adopted", F.array_join("reasons", ",").alias("reasons"))


_N = "translate({x}, chr(160) || chr(173), ' ')"
_T = "regexp_extract_all(" + T.folded_sql(_N) + ", '[a-z0-9]+')"
_CRUMB = "concat_ws(chr(10), concat_ws(' / ', CASE WHEN chapter_numeral <> '' THEN concat_ws(' — ', 'Chapter ' || chapter_numeral, chapter_title) END, concat_ws(' — ', CASE WHEN node_path LIKE 'Schedule%' THEN node_path ELSE 'Section ' || node_path END, root_title)), text)"
_ITEMS = f"""items AS MATERIALIZED (SELECT chunk_id AS item_id, ordinal AS tie, {_T.format(x=_CRUMB)} AS words FROM {CHUNKS})"""
_BM = f"""{_ITEMS}, n AS (SELECT count(*) AS n, avg(len(words)) AS a FROM items), tok AS MATERIALIZED (SELECT item_id, tie, len(words) AS l, unnest(words) AS w FROM items),
tf AS MATERIALIZED (SELECT item_id, tie, l, w, count(*) AS c FROM tok GROUP BY ALL), df AS (SELECT w, count(*) AS d FROM tf GROUP BY w),
qw AS (SELECT DISTINCT query_id, unnest({_T.format(x='question')}) AS w FROM {QUESTIONS}),
bms AS MATERIALIZED (SELECT query_id, item_id, tie, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * c * 2.5 / (c + 1.5 * (0.7 + 0.3 * l / a))), 9) AS score FROM qw JOIN tf USING (w) JOIN df USING (w), n GROUP BY ALL),
bm AS MATERIALIZED (SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tie, item_id) AS INT) AS rank, score FROM bms WHERE score > 0)"""
_UNIT = "(SELECT {k} AS k, list_transform(v, lambda x: CAST(x AS DOUBLE) / s) AS v FROM (SELECT {k}, v, sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN v])) AS s FROM (SELECT {k}, min({v}) AS v FROM {t} GROUP BY 1) WHERE len(v) = 64) WHERE s > 0 AND isfinite(s) AND len([x FOR x IN v IF x IS NULL]) = 0)"
_KN = f"""cosines AS MATERIALIZED (SELECT q.k AS query_id, c.k AS item_id, round(list_dot_product(q.v, c.v), 9) AS score FROM {_UNIT.format(k='query_id', v='vectors', t='query_vectors')} q, {_UNIT.format(k='chunk_id', v='embedding', t='chunk_embeddings')} c),
kn AS MATERIALIZED (SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INT) AS rank, score FROM cosines QUALIFY rank <= 100)"""
_VALIDP = r"regexp_matches(p, '^(Schedule [IVXLC]+|[0-9]{1,3}[A-Z]{0,3})(\([0-9A-Za-z]+\))*$')"
_PATHS = f"paths AS (SELECT chunk_id AS item_id, p AS path FROM (SELECT chunk_id, min(node_path) AS p FROM chunks GROUP BY 1) WHERE {_VALIDP})"
_GOLD = "gold AS (SELECT DISTINCT query_id, path AS required FROM cosines JOIN paths USING (item_id) WHERE score >= 0.75)"
_WAYS = r"""ways AS (SELECT query_id, required, r || array_to_string(b[:i], '') AS path FROM (SELECT *, unnest(generate_series(0, len(b))) AS i FROM (SELECT *, regexp_extract(required, '^(Schedule [IVXLC]+|[0-9]{1,3}[A-Z]{0,3})', 1) AS r, regexp_extract_all(required, '\([0-9A-Za-z]+\)') AS b FROM gold)))"""
_MET = f"""WITH {_BM}, {_KN}, {_PATHS}, {_GOLD}, {_WAYS},
run AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), path) AS rank FROM bm JOIN paths USING (item_id) WHERE rank <= 20 GROUP BY query_id, path),
hit AS (SELECT w.query_id, required, min(rank) AS rank FROM ways w LEFT JOIN (SELECT * FROM run WHERE rank <= 10) r ON r.query_id = w.query_id AND r.path = w.path GROUP BY ALL),
met AS (SELECT query_id, count(*) AS required, round(count(rank) / count(*), 6) AS recall, round(coalesce(1.0 / min(rank), 0), 6) AS mrr,
round(coalesce(list_sum([1 / log2(r + 1) FOR r IN list_distinct(list(rank))]), 0) / list_sum([1 / log2(i + 1) FOR i IN range(1, count(*) + 1)]), 6) AS ndcg FROM hit GROUP BY 1)"""

SQL = {
    "bm25_idf": f"WITH {_ITEMS}, n AS (SELECT count(*) AS n FROM items) SELECT w AS word, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM (SELECT w, count(*) AS df FROM (SELECT unnest(list_distinct(words)) AS w FROM items) GROUP BY 1), n",
    "bm25_topk": f"WITH {_BM} SELECT query_id, item_id, rank, round(score, 6) AS score FROM bm WHERE rank <= 10",
    "bm25_rm3": f"""WITH {_BM}, top AS (SELECT query_id, item_id, score / sum(score) OVER (PARTITION BY query_id) AS share FROM bm WHERE rank <= 10),
        rel AS (SELECT query_id, w, rel FROM (SELECT query_id, w, sum(share * c / l) AS rel FROM top JOIN tf USING (item_id) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rel, 12) DESC, w) <= 10),
        nw AS (SELECT query_id, w, sum(x) AS x FROM (SELECT query_id, w, 0.5 / count(*) OVER (PARTITION BY query_id) AS x FROM qw UNION ALL SELECT query_id, w, 0.5 * rel / sum(rel) OVER (PARTITION BY query_id) FROM rel) GROUP BY ALL),
        s AS (SELECT query_id, item_id, tie, round(sum(x * ln(1 + (n - d + 0.5) / (d + 0.5)) * c * 2.5 / (c + 1.5 * (0.7 + 0.3 * l / a))), 9) AS score FROM nw JOIN tf USING (w) JOIN df USING (w), n GROUP BY ALL)
        SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tie, item_id) AS INT) AS rank, round(score, 6) AS score FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "knn_exact": f"WITH {_KN} SELECT query_id, item_id, rank, round(score, 6) AS score FROM kn WHERE rank <= 10",
    "rrf_fuse": f"""WITH {_BM}, {_KN}, u AS (SELECT query_id, item_id, rank, 0 AS src FROM bm WHERE rank <= 100 UNION ALL SELECT query_id, item_id, rank, 1 FROM kn),
        f AS (SELECT query_id, item_id, sum(1.0::DOUBLE / (60 + rank)) AS s, min(rank * 10 + src) AS b FROM u GROUP BY ALL)
        SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 14) DESC, b, item_id) AS INT) AS rank, round(s, 6) AS score FROM f QUALIFY rank <= 10""",
    "rerank_head": f"""WITH {_BM}, {_KN}, h AS (SELECT b.*, k.score AS ns, count(*) OVER (PARTITION BY b.query_id) AS n FROM bm b LEFT JOIN cosines k USING (query_id, item_id) WHERE b.rank <= 40)
        SELECT query_id, item_id, CAST(p AS INT) AS rank, CAST(n - p + 1 AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank > 20, CASE WHEN rank <= 20 THEN ns END DESC NULLS LAST, rank) AS p FROM h)""",
    "fallback_leg": f"WITH {_BM}, {_KN}, f AS (SELECT * FROM kn WHERE rank <= 10 AND score >= 0.75) SELECT query_id, item_id, rank, round(score, 6) AS score FROM (SELECT * FROM f UNION ALL SELECT * FROM bm WHERE rank <= 10 AND query_id NOT IN (SELECT query_id FROM f))",
    "interleaved": f"""WITH {_BM}, {_KN}, u AS (SELECT query_id, item_id, min(rank * 10 + src) AS o FROM (SELECT query_id, item_id, rank, 0 AS src FROM bm WHERE rank <= 20 UNION ALL SELECT query_id, item_id, rank, 1 FROM kn WHERE rank <= 20) GROUP BY ALL)
        SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o, item_id) AS INT) AS rank FROM u QUALIFY rank <= 20""",
    "shortcut": f"""WITH {_BM}, {_KN}, u AS (SELECT query_id, item_id, min(src * 1000 + rank) AS o FROM (SELECT query_id, item_id, rank, 0 AS src FROM kn WHERE rank <= 10 AND score >= 0.75 UNION ALL SELECT query_id, item_id, rank, 1 FROM bm WHERE rank <= 10) GROUP BY ALL)
        SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o, item_id) AS INT) AS rank FROM u QUALIFY rank <= 10""",
    "retrieval_metrics": _MET + " SELECT * FROM met",
    "metrics_by_slice": _MET + f" SELECT coalesce(s, 'all') AS slice, count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM (SELECT met.*, coalesce(slice, 'none') AS s FROM met JOIN {QUESTIONS} USING (query_id)) GROUP BY ROLLUP (s)",
    "run_agreement": f"""WITH {_BM}, {_KN}, a AS (SELECT query_id, list(item_id ORDER BY rank) AS x FROM bm WHERE rank <= 10 GROUP BY 1), b AS (SELECT query_id, list(item_id ORDER BY rank) AS y FROM kn WHERE rank <= 10 GROUP BY 1),
        j AS (SELECT query_id, coalesce(x, []) AS x, coalesce(y, []) AS y FROM a FULL JOIN b USING (query_id)), s AS (SELECT *, len(list_intersect(x, y)) AS s FROM j)
        SELECT query_id, CASE WHEN x = y THEN 'identical' WHEN s = len(x) AND s = len(y) THEN 'reordered' ELSE 'different' END AS kind, CAST(s AS INT) AS shared, round(s / nullif(len(x) + len(y) - s, 0), 6) AS jaccard FROM s""",
    "vector_guard": """WITH v AS (SELECT corpus_version, chunk_id, min(embedding) AS e FROM chunk_embeddings GROUP BY ALL), m AS (SELECT corpus_version, len(e) AS l, sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN e])) AS s, e IS NOT NULL AND len([x FOR x IN e IF x IS NULL]) = 0 AS whole FROM v)
        SELECT corpus_version, count(*) AS vectors, count(*) FILTER (whole AND l = 64 AND s > 0 AND isfinite(s)) AS usable, count(*) FILTER (whole AND l = 64 AND abs(s - 1) <= 1e-4) AS of_unit_length FROM m GROUP BY 1""",
    "intrusions": f"WITH {_BM}, {_KN}, {_PATHS}, {_GOLD}, {_WAYS} SELECT item_id, count(*) AS queries FROM bm JOIN paths USING (item_id) WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM ways w WHERE w.query_id = bm.query_id AND w.path = paths.path) GROUP BY 1 HAVING count(*) >= 8",
}
QUERIES = {q.__name__: q for q in (bm25_idf, bm25_topk, bm25_rm3, knn_exact, rrf_fuse, rerank_head, fallback_leg, interleaved, shortcut, retrieval_metrics, metrics_by_slice, metrics_at_k, run_agreement, vector_guard, intrusions, adoption)}
