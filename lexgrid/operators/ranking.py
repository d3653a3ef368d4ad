"""Ranking whole tables of queries against whole tables of items, in blocks.

Items are stored in the order of (tie, item_id) with numbers in that order. Each task goes through its share of them once with a block of
queries and holds the k best (score, number) of each query. All items are scored in single precision (BM25: queries with the same first words share
the sums of these); an item is scored in doubles if that score, with its error, reaches the k-th best so far.
No item and no query is left out. What a task found is sent as packed numbers, k a query and task at most, and merged by queries. Queries that ask for the same are
ranked once. The queries travel to the tasks; a query table beyond QUERY_BLOCK rows is searched block by block.

Every ranking is a stored table (query_id, item_id, rank, score); rank counts from 1; scores are compared after rounding to 9 digits, ties
go to the smaller tie key and then to the smaller item_id. Empty queries and items without a common word have no rows;
null texts count as empty ones (and towards the average length).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import forget, materialize

QUERY_BLOCK = 20_000
#: Up to so many results that a task holds, a block of BM25 may have three times as many queries.
MOST_HELD = 2_000_000
#: Rows of the first block of items that a task scores, the factor by which blocks grow, the most rows of one for BM25, and what a packet holds.
FIRST, GROWTH, ROWS, PACKET = 512, 4, 1 << 15, 8192
#: Sums of first words that are kept for the queries after; rows of the sums that are looked through at once.
KEPT, FOLD = 32, 64
#: The parameters of BM25.
K1, B = 1.5, 0.3
#: Rounding to 9 digits, the order of sums and single precision of unit vectors move a score by less.
SLACK, SINGLE = 1e-8, 1e-5
PACKED, FOUND = "part int, data binary", "query_id string, _no bigint, rank int, score double"


class _Best:
    """The k best (score, number) of each of n queries, best first; what is missing has the score -inf."""

    def __init__(self, n: int, k: int) -> None:
        self.score, self.no = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, score: np.ndarray, no: np.ndarray) -> None:
        keep = score >= self.score[query, -1]
        if not keep.any():
            return
        touched, at = np.unique(query[keep], return_inverse=True)
        k = self.score.shape[1]
        q = np.concatenate([np.repeat(np.arange(len(touched)), k), at])
        s, n = np.concatenate([self.score[touched].ravel(), score[keep]]), np.concatenate([self.no[touched].ravel(), no[keep]])
        order = np.lexsort((n, -s, q))
        take = order[np.searchsorted(q[order], np.arange(len(touched)))[:, None] + np.arange(k)]
        self.score[touched], self.no[touched] = s[take], n[take]

    def packets(self) -> Iterator[pa.RecordBatch]:
        n, k = self.score.shape
        step = max(1, PACKET // k)
        for i in range(0, n, step):
            s, no = self.score[i : i + step], self.no[i : i + step]
            if (s > -np.inf).any():
                yield pa.RecordBatch.from_arrays([pa.array([i // step], pa.int32()), pa.array([s.tobytes() + no.tobytes()], pa.binary())], ["part", "data"])


def _merged(packed: DataFrame, names: list[list], k: int) -> DataFrame:
    """The packets of all tasks as rows; names: the query ids of each place."""
    sent, step = packed.sparkSession.sparkContext.broadcast(names), max(1, PACKET // k)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["part"].iloc[0]) * step
        own = sent.value[first : first + step]
        best, q = _Best(len(own), k), np.repeat(np.arange(len(own)), k)
        for data in pdf["data"]:
            half = len(data) // 2
            s, no = np.frombuffer(data[:half]), np.frombuffer(data[half:], np.int64)
            real = s > -np.inf
            best.add(q[real], s[real], no[real])
        real = best.score > -np.inf
        many = np.array([len(x) for x in own])[np.nonzero(real)[0]]  # queries that ask for the same
        pick = lambda a: [x for i in range(len(own)) for _ in own[i] for x in a[i][real[i]].tolist()]
        ids = [name for i in range(len(own)) for name in own[i] for _ in range(int(real[i].sum()))]
        assert len(ids) == many.sum()
        ranks = np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), best.score.shape)
        return pd.DataFrame({"query_id": pd.Series(ids, dtype=object), "_no": np.array(pick(best.no), np.int64), "rank": np.array(pick(ranks), np.int32), "score": np.array(pick(best.score), float)})

    return packed.groupBy("part").applyInPandas(merge, FOUND)


def _ranking(items: DataFrame, found: list[DataFrame]) -> DataFrame:
    """Stored, with the items' own ids."""
    if not found:
        return items.sparkSession.createDataFrame([], "query_id string, item_id string, rank int, score double")
    each = found[0]
    for f in found[1:]:
        each = each.unionByName(f)
    return materialize(each.join(items.select("_no", "item_id"), "_no").select("query_id", "item_id", "rank", "score"))


def _numbered(items: DataFrame, *columns) -> DataFrame:
    """A stored table with _no, whose order is that of (tie, item_id)."""
    return materialize(items.orderBy("tie", "item_id").select("item_id", "tie", *columns, F.monotonically_increasing_id().alias("_no")))


def _dealt(items: DataFrame, blocks: int) -> DataFrame:
    """A stored table in about two shares a core over all blocks of queries, one at least: every share sends k rows a query. What has about as many stays as it is stored, without a shuffle."""
    cores = items.sparkSession.sparkContext.defaultParallelism
    shares = max(cores, math.ceil(2 * cores / blocks))
    have = items._jdf.queryExecution().toRdd().getNumPartitions()
    return items.coalesce(shares) if have >= 2 * shares else items if have >= 2 * cores else items.repartition(shares)


def _regrouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows in blocks that grow from FIRST to `most`."""
    size, held, n = FIRST, [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        while n >= size:
            whole = pa.Table.from_batches(held)
            yield whole.slice(0, size).combine_chunks()
            rest = whole.slice(size)
            held, n, size = rest.to_batches(), len(rest), min(size * GROWTH, most)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def bm25_statistics(tokens: DataFrame, words: DataFrame | None = None) -> tuple[int, float, dict[str, int]]:
    """Number of items, average length and document frequencies (of words(word) alone if given); tokens(item_id, words ARRAY)."""
    n, average = tokens.agg(F.count("*"), F.avg(F.size("words"))).first()
    each = tokens.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count()
    if words is not None:
        each = each.join(words.select("word").distinct(), "word", "left_semi")
    return n, average or 0.0, {r[0]: r[1] for r in each.collect()}


def tokenized(items: DataFrame, tokenizer=T.tokens) -> DataFrame:
    """items(item_id, tie, text) -> a stored table (item_id, tie, words, _no), which every pass of a ranking reads."""
    return _numbered(items, F.coalesce(tokenizer(F.col("text")), F.array().cast("array<string>")).alias("words"))


def bm25(items: DataFrame, weights: DataFrame, k: int = 10, k1: float = K1, b: float = B, tokenizer=T.tokens) -> DataFrame:
    """items(item_id, tie, text) or tokenized(items), weights(query_id, word, weight) -> ranking by the sum of weight * idf * saturated frequency."""
    tokens = items if "_no" in items.columns else _numbered(items, "words") if "words" in items.columns else tokenized(items, tokenizer)
    weights = materialize(weights.select("query_id", "word", "weight"))
    n, average, df = bm25_statistics(tokens, weights)
    vocabulary = sorted(df)
    idf = np.array([math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w in vocabulary])
    table = weights.filter(F.col("word").isNotNull()).toArrow()  # the stated query set
    code = pc.fill_null(pc.index_in(table["word"], value_set=pa.array(vocabulary, pa.string())), -1).to_numpy()
    query = _one(table["query_id"]).dictionary_encode(null_encoding="encode")
    names, place, weight = query.dictionary.to_pylist(), query.indices.to_numpy(), table["weight"].to_numpy()
    order = np.lexsort((weight, code, place))
    order = order[code[order] >= 0]
    place, code, value = place[order], code[order].astype(np.int64), weight[order] * idf[code[order]] if len(order) else weight[order]
    alike: dict[tuple[bytes, bytes], list] = {}
    ends = np.searchsorted(place, np.arange(len(names) + 1))
    for i, name in enumerate(names):
        a, z = ends[i], ends[i + 1]
        if z > a:
            alike.setdefault((code[a:z].tobytes(), value[a:z].tobytes()), []).append(name)
    asked = list(alike.items())
    step = max(QUERY_BLOCK, min(MOST_HELD // k, 3 * QUERY_BLOCK))
    blocks = [asked[i : i + step] for i in range(0, len(asked), step)]
    found = [_bm25_block(_dealt(tokens, len(blocks)), block, vocabulary, average, k, k1, b) for block in blocks]
    out = _ranking(tokens, found)
    forget(weights)
    if tokens is not items:
        forget(tokens)
    return out


def _bm25_block(tokens: DataFrame, asked: list, vocabulary: list[str], average: float, k: int, k1: float, b: float) -> DataFrame:
    length = np.array([len(key[0]) // 8 for key, _ in asked])
    code, value = (np.frombuffer(b"".join(key[i] for key, _ in asked), t) for i, t in ((0, np.int64), (1, np.float64)))
    own, code = np.unique(code, return_inverse=True)
    sent = tokens.sparkSession.sparkContext.broadcast(([vocabulary[w] for w in own], code, value, length))  # a block of the query set

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _bm25_best(_regrouped(batches, ROWS), *sent.value, average, k, k1, b).packets()

    return _merged(tokens.select("_no", "words").mapInArrow(score, PACKED), [names for _, names in asked], k)


def _postings(words: pa.Array, vocabulary: pa.Array, average: float, k1: float, b: float) -> tuple:
    """By word and item: their keys word * rows + item, what the word adds to the item, and where each word begins."""
    size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = pc.fill_null(pc.index_in(pc.list_flatten(words), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    known = at >= 0
    key, times = np.unique(at[known] * np.int64(len(size)) + np.repeat(np.arange(len(size)), size)[known], return_counts=True)
    adds = times * (k1 + 1) / (times + k1 * (1 - b + b * size[key % len(size)] / (average or 1.0)))
    return key, adds, np.searchsorted(key, np.arange(len(vocabulary) + 1) * len(size))


def _in_turn(code: np.ndarray, value: np.ndarray, length: np.ndarray) -> list[tuple[int, int, list[tuple[int, float]]]]:
    """The queries so that those with the same first words follow each other, frequent words first: (query, number of first words it has in common with the one before, words and weights)."""
    (word, weight), pair, often = np.unique(np.stack([code.astype(np.float64), value]), axis=1, return_inverse=True, return_counts=True)
    frequent = np.argsort(-often, kind="stable")
    rank = np.empty(len(often), np.int64)
    rank[frequent] = np.arange(len(often))
    rank = rank[pair.ravel()]
    rank = rank[np.lexsort((rank, np.repeat(np.arange(len(length)), length)))]
    pairs, numbers = list(zip(word[frequent].astype(int).tolist(), weight[frequent].tolist())), list(range(len(often)))  # each object once
    ends = np.cumsum(length)
    each = sorted(([numbers[x] for x in rank[z - n : z].tolist()], q) for q, (z, n) in enumerate(zip(ends, length.tolist())))
    out, last = [], []
    for own, q in each:
        same = next((i for i, (x, y) in enumerate(zip(own, last)) if x != y), min(len(own), len(last)))
        out.append((q, same, [pairs[x] for x in own]))
        last = own
    return out


def _bm25_best(tables: Iterator[pa.Table], names: list[str], code: np.ndarray, value: np.ndarray, length: np.ndarray, average: float, k: int, k1: float, b: float) -> _Best:
    """The k best of each query. All items are scored in single precision, with the sums of the words that a query has in common with the one before it kept;
    those that may be among the k best as far as single precision can tell are scored again in doubles."""
    vocabulary, n = pa.array(names, pa.string()), len(length)
    best, turns, begin = _Best(n, k), _in_turn(code, value, length), np.cumsum(length) - length
    total = np.bincount(np.repeat(np.arange(n), length), np.abs(value), n)
    error = (length + 4) * 2.0**-22 * (k1 + 1) * total + SLACK  # twice what the sums in single precision may be off, and the rounding
    alone, scale = np.zeros(len(names)), np.ones(len(names))
    alone[code] = value
    if fixed := bool((alone[code] == value).all()):  # a word weighs the same for all queries
        scale = alone
    floor = 1e-30 if (value >= 0).all() else -np.inf  # without negative weights an item without a common word has no more than nothing
    for table in tables:
        no, rows = _one(table["_no"]).to_numpy(), len(table)
        key, adds, start = _postings(_one(table["words"]), vocabulary, average, k1, b)
        item, single, start, wide = key % rows, (adds * scale[key // rows]).astype(np.float32), start.tolist(), -(-rows // FOLD) * FOLD
        whole = {}  # words of many items, as a column
        for w in range(len(names)):
            if start[w + 1] - start[w] > rows / 64:
                whole[w] = np.zeros(wide, np.float32)
                whole[w][item[start[w] : start[w + 1]]] = single[start[w] : start[w + 1]]
        low = np.maximum(np.where(best.score[:, -1] > 0, best.score[:, -1], 0.0) - error, floor).astype(np.float32)
        sums, part, some, held = [np.zeros(wide, np.float32)], np.empty(wide, np.float32), [], 0
        off = (2 * error).tolist()
        for q, same, words in turns:
            for depth in range(min(same, KEPT - 1), len(words)):
                w, times = words[depth]
                at = min(depth + 1, KEPT)  # beyond that depth sums are not kept for others
                if at == len(sums):
                    sums.append(np.empty(wide, np.float32))
                if w in whole:
                    np.add(sums[min(depth, KEPT)], whole[w] if fixed else np.multiply(whole[w], np.float32(times), out=part), out=sums[at])
                else:
                    if depth < KEPT:
                        np.copyto(sums[at], sums[depth])
                    sums[at][item[start[w] : start[w + 1]]] += single[start[w] : start[w + 1]] if fixed else np.float32(times) * single[start[w] : start[w + 1]]
            last = sums[min(len(words), KEPT)].reshape(FOLD, -1)
            column = np.flatnonzero(np.maximum.reduce(last) >= low[q])
            if not len(column):
                continue
            near, at = np.nonzero(last[:, column] >= low[q])
            at = near * last.shape[1] + column[at]
            last = last.ravel()
            if wide > rows:
                at = at[at < rows]
            if len(at) > k:
                own = last[at]
                at = at[own >= np.partition(own, -k)[-k] - off[q]]
            some.append((q, at))
            held += len(at)
            if held > 100_000:
                _settle(best, some, no, key, adds, rows, code, value, begin, length)
                some, held = [], 0
        _settle(best, some, no, key, adds, rows, code, value, begin, length)
    return best


def _settle(best: _Best, some: list[tuple], no: np.ndarray, key: np.ndarray, adds: np.ndarray, rows: int, code: np.ndarray, value: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
    """Scores the chosen items of some queries in doubles."""
    if not some or not len(key):
        return
    query, at = np.repeat([q for q, _ in some], [len(x) for _, x in some]), np.concatenate([x for _, x in some])
    own = np.zeros(len(at))
    for j in range(int(length[query].max())):
        more = np.flatnonzero(length[query] > j)
        place = begin[query[more]] + j
        wanted = code[place] * rows + at[more]
        found = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        own[more] += np.where(key[found] == wanted, value[place] * adds[found], 0.0)
    own = np.round(own, 9)
    keep = own > 0
    best.add(query[keep], own[keep], no[at[keep]])


def word_weights(queries: DataFrame, tokenizer=T.tokens) -> DataFrame:
    """queries(query_id, text) -> (query_id, word, weight 1): each word of a query once."""
    return queries.select("query_id", F.explode(F.array_distinct(tokenizer(F.col("text")))).alias("word"), F.lit(1.0).alias("weight"))


def rm3(items: DataFrame, queries: DataFrame, docs: int = 10, words: int = 10, original: float = 0.5) -> DataFrame:
    """Query expansion by a relevance model: (query_id, word, weight) of the best words of the best items, mixed with the query's own."""
    tokens = items if "words" in items.columns else tokenized(items)
    first = materialize(bm25(tokens, word_weights(queries), docs))
    whole = first.groupBy("query_id").agg(F.sum("score").alias("_all"))
    top = materialize(first.join(whole, "query_id").select("query_id", "item_id", (F.col("score") / F.col("_all")).alias("share")))
    each = top.join(tokens.select("item_id", "words"), "item_id").select("query_id", "share", F.size("words").alias("n"), F.explode("words").alias("word"))
    model = each.groupBy("query_id", "word").agg(F.sum(F.col("share") / F.col("n")).alias("rel"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("rel", 12)), "word")
    model = materialize(model.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= words).drop("_r"))
    total = model.groupBy("query_id").agg(F.sum("rel").alias("_all"))
    model = model.join(total, "query_id").select("query_id", "word", ((1 - original) * F.col("rel") / F.col("_all")).alias("weight"))
    asked = materialize(word_weights(queries).select("query_id", "word"))
    count = asked.groupBy("query_id").agg(F.count("*").alias("_n"))
    own = asked.join(count, "query_id").select("query_id", "word", (F.lit(original) / F.col("_n")).alias("weight"))
    return own.unionByName(model).groupBy("query_id", "word").agg(F.sum("weight").alias("weight"))


def units(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors and their unit vectors, in doubles; all have `dim` numbers or nulls."""
    x = pc.fill_null(vectors.flatten().cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((x * x).sum(1))
    good = np.flatnonzero(np.isfinite(norm) & (norm > 0))
    return good, x[good] / norm[good, None]


def _usable(df: DataFrame, dim: int, *columns: str) -> DataFrame:
    return df.filter(F.size("vector") == dim).select(*columns, "vector")


def _asked(queries: DataFrame, dim: int) -> list[tuple[list, np.ndarray]]:
    """Blocks of the query set: ids and unit vectors."""
    table = _usable(queries, dim, "query_id").toArrow()
    if not len(table):
        return []
    rows, q = units(_one(table["vector"]), dim)
    ids = table["query_id"].take(pa.array(rows)).to_pylist()
    return [(ids[i : i + QUERY_BLOCK], q[i : i + QUERY_BLOCK]) for i in range(0, len(ids), QUERY_BLOCK)]


def _pairs(q: np.ndarray, single: np.ndarray, x: np.ndarray, x_single: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs whose cosine reaches their query's least: places of queries and items, cosines to 9 digits."""
    near = np.flatnonzero(single @ x_single.T >= (least - SINGLE).astype(np.float32)[:, None])
    i, j = np.divmod(near, len(x))
    score = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", q[i[a : a + 50_000]], x[j[a : a + 50_000]]) for a in range(0, len(i), 50_000))])
    score = np.round(score, 9)
    keep = score >= least[i]
    return i[keep], j[keep], score[keep]


def knn(items: DataFrame, queries: DataFrame, k: int = 10, dim: int = 64) -> DataFrame:
    """items(item_id, tie, vector), queries(query_id, vector) -> exact ranking by cosine. Vectors without direction, with numbers that are not finite or of another length take no part."""
    stored = _numbered(items.filter(F.size("vector") == dim), "vector")
    blocks = _asked(queries, dim)
    found = []
    for names, q in blocks:
        sent = items.sparkSession.sparkContext.broadcast(q)

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q = sent.value
            single, best = q.astype(np.float32), _Best(len(q), k)
            for table in _regrouped(batches, 1 << 14):
                rows, x = units(_one(table["vector"]), dim)
                no, x_single = _one(table["_no"]).to_numpy()[rows], x.astype(np.float32)
                for a in range(0, len(q) if len(x) else 0, 256):
                    i, j, s = _pairs(q[a : a + 256], single[a : a + 256], x, x_single, best.score[a : a + 256, -1])
                    best.add(a + i, s, no[j])
            yield from best.packets()

        found.append(_merged(_dealt(stored, len(blocks)).select("_no", "vector").mapInArrow(score, PACKED), [[x] for x in names], k))
    out = _ranking(stored, found)
    forget(stored)
    return out


def near(items: DataFrame, queries: DataFrame, at_least: float, dim: int = 64) -> DataFrame:
    """As knn, but all items of cosine `at_least` or more, however many: a stored table (query_id, item_id, score)."""
    schema = pa.schema([("query_id", pa.string()), ("item_id", pa.string()), ("score", pa.float64())])
    out = items.sparkSession.createDataFrame([], "query_id string, item_id string, score double")
    stored = materialize(_usable(items, dim, "item_id"))
    blocks = _asked(queries, dim)
    for names, q in blocks:
        sent = items.sparkSession.sparkContext.broadcast((names, q))

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            ids, single = pa.array(names, pa.string()), q.astype(np.float32)
            for table in _regrouped(batches, 1 << 14):
                rows, x = units(_one(table["vector"]), dim)
                own, x_single = _one(table["item_id"]).take(pa.array(rows)), x.astype(np.float32)
                for a in range(0, len(q) if len(x) else 0, 256):
                    part = q[a : a + 256]
                    i, j, s = _pairs(part, single[a : a + 256], x, x_single, np.full(len(part), at_least))
                    for c in range(0, len(s), 50_000):
                        e = c + 50_000
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + i[c:e])), own.take(pa.array(j[c:e])), pa.array(s[c:e])], schema=schema)

        out = out.unionByName(_dealt(stored, len(blocks)).mapInArrow(score, out.schema))
    out = materialize(out)
    forget(stored)
    return out


def pair_cosines(pairs: DataFrame, items: DataFrame, queries: DataFrame, dim: int = 64) -> DataFrame:
    """pairs(query_id, item_id) -> (query_id, item_id, score) of the pairs whose vectors both are usable: the cosine, to 9 digits."""
    x, y = F.col("_x").cast("array<double>"), F.col("_y").cast("array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    own = lambda df, key, name: df.filter(F.size("vector") == dim).select(key, F.col("vector").alias(name))
    both = pairs.select("query_id", "item_id").join(own(items, "item_id", "_x"), "item_id").join(own(queries, "query_id", "_y"), "query_id")
    each = both.select("query_id", "item_id", F.sqrt(dot(x, x)).alias("_a"), F.sqrt(dot(y, y)).alias("_b"), dot(x, y).alias("_d"))
    usable = lambda c: (F.col(c) > 0) & (F.col(c) < float("inf"))
    return each.filter(usable("_a") & usable("_b")).select("query_id", "item_id", F.round(F.col("_d") / F.col("_a") / F.col("_b"), 9).alias("score"))
