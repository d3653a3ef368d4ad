"""The most similar vectors for every vector.

A forest of random-projection trees: in each tree all nodes of a level share one direction, of several random ones that along which the
sample spreads most, and split at the median that the sample has there. Every vector goes to its leaf in each tree; the branches not taken, of all trees
together, wait in one priority queue by how narrowly they were missed, and the nearest `probes` of them are descended too, more of them the deeper the trees are.
Vectors that share a leaf are compared in blocks over 6-bit codes.

A code lies within a known angle of its vector: at most asin(sqrt(dim) / 2 / length of the code). A pair is dropped only if that angle leaves no
room for a cosine of `at_least`, or for a place among the row's k nearest of that leaf. What is left is reranked with exact cosines. Where codes can't
choose, because rows have many more candidates than k in a leaf, the exact vectors of the whole leaf are compared instead.

Rows that are asked for in full (`complete`) and that the forest gave fewer than k neighbours, having few vectors as near as `at_least`, are compared with all
chunk vectors exactly, block by block: isolated vectors have no neighbourhood that an index could bound, so this takes such rows x chunks.

Only codes (six bits a dimension) travel to the leaves, once to each subtree in which a vector has leaves; exact vectors are read again for candidates alone. The forest is fitted on `sample` vectors
at most (the index holds every vector), so a tree has at most sample / 4 leaves; beyond that leaves grow, and a leaf that the sample shows to be
larger than four leaves is compared in pairs of blocks, each a task of its own.

Exact copies of a vector form a class; the forest sees one representative of each, so a group of copies, however large,
is one row there, and its members take their neighbours from the class.

Defined results: vectors that are null, of another length, all zero or not finite take no part; a repeated row counts
once; a key with several vectors has the neighbours of all of them; cosines are compared after rounding to 12 digits, ties go to the smaller key;
a vector is no neighbour of itself; an empty side gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of one or three numbers: some 50 MB at most.
BROADCAST_ROWS = 1_000_000
#: Rows of a block where all of one block are compared with all of another.
BLOCK = 65_536
#: Chunk rows compared at a time within a block.
STRIP = 16_384
#: Random directions of which a level takes one.
CHOICE = 16
#: Trees of more than FLAT levels have MORE further probes for each level beyond, since each split parts some neighbours.
FLAT, MORE = 7, 1
#: Pairs of blocks of a large leaf are numbered with so many bits.
SPLITS = 12
#: Stands in the place of such a number where a leaf is whole.
WHOLE = (1 << 2 * SPLITS) - 1


class Forest:
    """Directions (trees, depth, dim) and thresholds (trees, 2^depth), fitted on a sample of unit vectors; counts (trees, 2^depth): sample rows of each leaf."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        offered = rng.standard_normal((trees * depth, CHOICE, dim)).astype(np.float32)
        offered /= np.linalg.norm(offered, axis=2, keepdims=True)
        wide = (sample[:8192] @ offered.reshape(-1, dim).T).std(0).reshape(-1, CHOICE).argmax(1) if len(sample) else np.zeros(trees * depth, int)
        self.directions = offered[np.arange(trees * depth), wide].reshape(trees, depth, dim)
        self.thresholds = np.zeros((trees, 1 << depth), np.float32)
        self.counts = np.zeros((trees, 1 << depth), np.int64)
        for t in range(trees):
            node = np.ones(len(sample), np.int64)
            for level in range(depth):
                p = sample @ self.directions[t, level]
                order = np.lexsort((p, node))
                sorted_node, sorted_p = node[order], p[order]
                first = np.flatnonzero(np.diff(sorted_node, prepend=-1))
                count = np.diff(first, append=len(order))
                # nodes that the sample hardly reaches split where the whole level does
                self.thresholds[t, 1 << level : 2 << level] = np.median(p) if len(p) else 0
                known = count >= 8
                self.thresholds[t, sorted_node[first[known]]] = sorted_p[(first + count // 2)[known]]
                node = 2 * node + (p >= self.thresholds[t, node])
            self.counts[t] = np.bincount(node - (1 << depth), minlength=1 << depth)

    def leaves(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Leaf codes (rows, trees + probes); the leaves of a row are all different."""
        trees, depth, dim = self.directions.shape
        n, rows = len(x), np.arange(len(x))
        p = (x @ self.directions.reshape(trees * depth, dim).T).reshape(n, trees, depth)
        waiting = np.full((n, (trees + probes) * depth), np.inf, np.float32)
        branch = np.zeros(waiting.shape, np.int32)
        out = np.empty((n, trees + probes), np.int32)
        for t in range(trees):
            node = np.ones(n, np.int64)
            for level in range(depth):
                margin = p[:, t, level] - self.thresholds[t, node]
                right = margin >= 0
                waiting[:, t * depth + level] = np.abs(margin)
                branch[:, t * depth + level] = (t << 24) | (2 * node + ~right)
                node = 2 * node + right
            out[:, t] = (t << 24) | node
        used = trees * depth
        for k in range(probes):
            best = waiting[:, :used].argmin(1)
            missed, code = waiting[rows, best], branch[rows, best]
            waiting[rows, best] = np.inf
            t, node = code >> 24, (code & 0xFFFFFF).astype(np.int64)
            at = np.frexp(node.astype(np.float64))[1] - 1  # the level of the node
            for level in range(1, depth):
                active = at <= level
                margin = p[rows, t, level] - self.thresholds[t, np.minimum(node, (1 << depth) - 1)]
                right = margin >= 0
                waiting[:, used + level] = np.where(active, np.maximum(missed, np.abs(margin)), np.inf)
                branch[:, used + level] = (t << 24) | (2 * node + ~right)
                node = np.where(active, 2 * node + right, node)
            out[:, trees + k] = (t << 24) | node
            used += depth
        return out


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors, and their unit vectors."""
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    rows = np.flatnonzero(size == dim)
    flat = column.take(pa.array(rows)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0) & np.isfinite(x).all(1)
    return rows[good], x[good] / norm[good, None]


def _codes(x: np.ndarray) -> pa.Array:
    """Codes of 6 bits a dimension, four dimensions in three bytes; the direction counts, so each vector uses the whole range."""
    q = np.rint(x * (31 / np.abs(x).max(1, keepdims=True))).astype(np.int32) + 32
    q = np.pad(q, ((0, 0), (0, -q.shape[1] % 4)), constant_values=32)
    word = q[:, ::4] << 18 | q[:, 1::4] << 12 | q[:, 2::4] << 6 | q[:, 3::4]
    packed = np.ascontiguousarray(np.stack((word >> 16, word >> 8 & 255, word & 255), 2).astype(np.uint8).reshape(len(x), -1))
    offsets = np.arange(len(packed) + 1, dtype=np.int32) * packed.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])


def _decode(column: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of codes, and the angle within which each one's own vector lies: rounding moves no number by more than one half."""
    wide = -(-dim // 4)
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, wide, 3).astype(np.int32)
    word = raw[:, :, 0] << 16 | raw[:, :, 1] << 8 | raw[:, :, 2]
    x = np.stack((word >> 18, word >> 12 & 63, word >> 6 & 63, word & 63), 2).reshape(-1, 4 * wide)[:, :dim].astype(np.float32) - 32
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / size, np.arcsin(np.minimum(1, math.sqrt(dim) / 2 / size[:, 0])) + 1e-6


def _hashed(raw: DataFrame) -> DataFrame:
    """Adds two hashes of the vector, which name its class of exact copies, and an id (its lowest bit tells questions from chunks).

    Two classes with one id would only add candidates, which the exact reranking then drops.
    """
    question = (F.col("kind") == "q").cast("bigint")
    hashed = raw.withColumns({"h1": F.xxhash64("kind", "vector"), "h2": F.xxhash64("vector", "kind")})
    return hashed.withColumn("id", F.col("h1").bitwiseAND(F.lit(-2)).bitwiseOR(question))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only what is known to have BROADCAST_ROWS rows at most; beyond that the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _coded(df: DataFrame, dim: int) -> DataFrame:
    """(kind, id, key, h1, h2, code) of the usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = _matrix(b.column(5), dim)
            if len(rows):
                keep = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column(i).take(keep) for i in range(5)] + [_codes(x)], names=["kind", "id", "key", "h1", "h2", "code"])

    wanted = df.select("kind", "id", "key", "h1", "h2", "vector").filter(F.size("vector") == dim)
    return wanted.mapInArrow(run, "kind string, id bigint, key string, h1 bigint, h2 bigint, code binary")


def _vectors(raw: DataFrame, dim: int) -> DataFrame:
    """One row for each class of usable vectors: (kind, id, h1, h2, vector, key)."""
    return raw.filter(F.size("vector") == dim).groupBy("id", "kind", "h1", "h2").agg(F.first("vector").alias("vector"), F.min("key").alias("key"))


def _place(df: DataFrame, forest: Forest, probes: int, n: int, leaf_size: int, dim: int, column: str, schema: str, shift: int) -> DataFrame:
    """Rows of df with the leaves of their `column`, codes or vectors. A row travels once to each subtree, of 2^shift leaves, that it has leaves in, and
    `rest` names these (two bytes each); a leaf beyond four times its size stands for pairs of blocks, each with a key of its own."""
    parts = np.ceil(forest.counts * (n / max(1, forest.counts[0].sum())) / (4 * leaf_size)).clip(1, (1 << SPLITS) - 1).astype(np.int64)
    names = df.columns
    sent = df.sparkSession.sparkContext.broadcast((forest, parts))  # a few bytes for each row of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, parts = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            given = b.column(names.index(column))
            x = _decode(given, dim)[0] if column == "code" else _matrix(given, dim)[1].astype(np.float32)
            leaves = forest.leaves(x, probes)
            row, leaf = np.repeat(np.arange(b.num_rows), leaves.shape[1]), leaves.ravel().astype(np.int64)
            tree, node = leaf >> 24, leaf & 0xFFFFFF
            many = parts[tree, node - parts.shape[1]]
            plain = many == 1
            key = ((tree << 24 | node >> shift) << 2 * SPLITS) | WHOLE
            order = np.lexsort((key[plain], row[plain]))
            r, k, rest = row[plain][order], key[plain][order], (node[plain][order] & ((1 << shift) - 1)).astype(np.uint16)
            first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (k[1:] != k[:-1]))) if len(r) else np.empty(0, np.int64)
            yield _rows(b, names, r[first], k[first], rest, np.append(first, len(r)))
            if not plain.all():
                row, leaf, many = row[~plain], leaf[~plain], many[~plain]
                mine = b.column(names.index("id")).to_numpy()[row] // 2 % many
                again = np.repeat(np.arange(len(row)), many)
                other = np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many)
                low, high = np.minimum(mine[again], other), np.maximum(mine[again], other)
                yield _rows(b, names, row[again], (leaf[again] << 2 * SPLITS) | (low << SPLITS) | high, np.zeros(len(again), np.uint16), np.arange(len(again) + 1))

    return df.mapInArrow(run, f"leaf bigint, rest binary, {schema}")


def _rows(b: pa.RecordBatch, names: list[str], row: np.ndarray, key: np.ndarray, rest: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    rests = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rest))])
    take = pa.array(row)
    return pa.RecordBatch.from_arrays([pa.array(key), rests, *[b.column(i).take(take) for i in range(len(names))]], names=["leaf", "rest", *names])


def _leaves_of(table: pa.Table, shift: int) -> Iterator[tuple[int, np.ndarray]]:
    """(key of the leaf, its rows) for each leaf of a subtree's rows."""
    key = table.column("leaf")[0].as_py()
    rests = table.column("rest").to_pylist()
    rest = np.frombuffer(b"".join(rests), np.uint16)
    row = np.repeat(np.arange(len(rests)), [len(x) // 2 for x in rests])
    order = np.argsort(rest, kind="stable")
    edge = np.append(np.flatnonzero(np.diff(rest[order].astype(np.int64), prepend=-1)), len(order))
    for a, b in zip(edge, edge[1:]):
        code = key >> 2 * SPLITS
        whole = key & WHOLE == WHOLE
        yield (((code >> 24 << 24 | (code & 0xFFFFFF) << shift | int(rest[order[a]])) << 2 * SPLITS) | WHOLE) if whole else key, row[order[a:b]]


def _by_leaf(placed: DataFrame, each: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """each(all rows of one leaf or subtree) over all of them; leaf is the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            leaf = table.column(0).to_numpy()
            edge = np.append(np.flatnonzero(np.diff(leaf, prepend=-1)), len(leaf))
            for a, b in zip(edge, edge[1:]):
                yield from each(table.slice(a, b - a))

        for b in batches:
            if not b.num_rows:
                continue
            leaf = b.column(0).to_numpy()
            cut = int(np.searchsorted(leaf, leaf[-1]))  # the last one may go on
            if cut or (held and held[-1].column(0)[-1].as_py() != leaf[0]):
                yield from done(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = [b.slice(cut)]
            else:
                held.append(b)
        if held:
            yield from done(pa.Table.from_batches(held))

    return placed.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(run, schema)


def _chosen(sims: np.ndarray, off: np.ndarray, off_c: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, chunk) of sims that may be exact cosines of `least` or more and among the row's k best, given the angles by which codes may be off."""
    lowest = math.cos(min(math.pi, math.acos(least) + float(off.max() + off_c.max()))) if len(off_c) else least
    hit = np.flatnonzero(sims >= lowest)
    i, j = np.divmod(hit, max(1, sims.shape[1]))
    s, away = np.minimum(sims.ravel()[hit], 1), off[i] + off_c[j]
    room = np.sqrt(1 - s * s) * away + away * away / 2
    keep = s + room >= least
    i, j, low, high = i[keep], j[keep], (s - room)[keep], (s + room)[keep]
    size = np.bincount(i, minlength=len(sims))
    if len(i) and size.max() > k:
        order = np.lexsort((-low, i))
        first = np.cumsum(size) - size
        kth = np.full(len(sims), -2.0)
        full = size >= k
        kth[full] = low[order[first[full] + k - 1]]
        keep = high >= kth[i]
        i, j = i[keep], j[keep]
    return i, j


def _candidates(placed: DataFrame, at_least: float, k: int, dim: int, shift: int) -> DataFrame:
    """(a, b): ids of representatives that share a leaf and may be neighbours; of two chunks a is the smaller, else a is the question.
    A leaf with rows of more than 8 k candidates has one row (leaf, null) instead."""

    def within(ids: np.ndarray, x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        question = (ids & 1) == 1
        chunks = np.flatnonzero(~question)
        c, found = x[chunks], []
        for rows in (chunks, np.flatnonzero(question)):
            for s in range(0, len(rows) if len(chunks) else 0, 1024):
                some = rows[s : s + 1024]
                sims = x[some] @ c.T
                if rows is chunks:
                    sims[np.arange(len(some)), s + np.arange(len(some))] = -2
                i, j = _chosen(sims, off[some], off[chunks], at_least, k)
                if len(i) and np.bincount(i).max() > 8 * k:
                    return None
                found.append((ids[some[i]], ids[chunks[j]]))
        return tuple(np.concatenate(v) for v in zip(*found)) if found else (ids[:0], ids[:0])

    def each(subtree: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = subtree.column("id").to_numpy()
        x, off = _decode(subtree.column("code"), dim)
        found, crowded = [], []
        for leaf, rows in _leaves_of(subtree, shift):
            pairs = within(ids[rows], x[rows], off[rows])
            if pairs is None:
                crowded.append(leaf)
            else:
                found.append(pairs)
        if found:
            i, j = (np.concatenate(v) for v in zip(*found))
            swap = ((i & 1) == 0) & (i > j)
            pairs = np.unique(np.stack((np.where(swap, j, i), np.where(swap, i, j)), 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])
        if crowded:
            yield pa.RecordBatch.from_arrays([pa.array(crowded, pa.int64()), pa.nulls(len(crowded), pa.int64())], names=["a", "b"])

    return _by_leaf(placed, each, "a bigint, b bigint").distinct()


_RANKED = "kind string, a string, b string, cosine double"


def _exact_block(table: pa.Table, asked: np.ndarray, chunks: np.ndarray, at_least: float, k: int, dim: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of the chunk rows for each of the asked rows, by exact vectors; table has columns kind, key, vector."""
    kind, key = (np.array(table.column(c).to_pylist(), object) for c in ("kind", "key"))
    rows, x = _matrix(table.column("vector").combine_chunks(), dim)
    exact = np.full((len(table), dim), np.nan)
    exact[rows] = x
    single = exact.astype(np.float32)
    asked, chunks = asked[~np.isnan(exact[asked, 0])], chunks[~np.isnan(exact[chunks, 0])]
    text = key.astype(str)
    _, code = np.unique(text, return_inverse=True)
    sorted_chunks = chunks[np.argsort(code[chunks], kind="stable")]
    codes = code[sorted_chunks]
    for s in range(0, len(asked) if len(chunks) else 0, 512):
        some = asked[s : s + 512]
        least, found = np.full(len(some), max(at_least, -1.0), np.float32), []
        for c in range(0, len(chunks), STRIP):
            strip = sorted_chunks[c : c + STRIP]
            sims = single[some] @ single[strip].T
            for r in np.flatnonzero(kind[some] == "c"):  # a vector is no neighbour of itself: its key's chunks lie side by side
                lo, hi = np.searchsorted(codes[c : c + STRIP], (code[some[r]], code[some[r]] + 1))
                sims[r, lo:hi] = -2
            if len(strip) > k and not c:  # what comes later has to be as near as the k best of the first strip
                least = np.maximum(least, np.partition(sims, -k, axis=1)[:, -k])
            i, j = np.nonzero(sims >= least[:, None] - 1e-5)
            found.append((i, strip[j]))
        i, other = (np.concatenate(v) for v in zip(*found))
        score = np.round((exact[some[i]] * exact[other]).sum(1), 12)
        keep = score >= at_least
        i, other, score = i[keep], other[keep], score[keep]
        order = np.lexsort((code[other], -score, i))
        i, other, score = i[order], other[order], score[order]
        top = np.arange(len(i)) - np.searchsorted(i, i) < k
        a, b = some[i[top]], other[top]
        yield pa.RecordBatch.from_arrays([pa.array(kind[a], pa.string()), pa.array(key[a], pa.string()), pa.array(key[b], pa.string()), pa.array(score[top])], names=["kind", "a", "b", "cosine"])


def _crowded(raw: DataFrame, crowded: DataFrame, place: Callable[[DataFrame, str, str, int], DataFrame], at_least: float, k: int, dim: int) -> DataFrame:
    """The k nearest of each row in each of the crowded(leaf) leaves, by exact vectors."""
    count = crowded.count()
    vectors = _vectors(raw, dim).select("id", "kind", "key", "vector")
    placed = place(vectors, "vector", "id bigint, kind string, key string, vector array<float>", 0).join(_small(crowded, count), "leaf", "left_semi")

    def each(leaf: pa.Table) -> Iterator[pa.RecordBatch]:
        return _exact_block(leaf, np.arange(len(leaf)), np.flatnonzero(leaf.column("id").to_numpy() & 1 == 0), at_least, k, dim)

    return _by_leaf(placed, each, _RANKED)


def _against_all(vectors: DataFrame, asked: DataFrame, count: int, n: int, k: int, dim: int) -> DataFrame:
    """vectors(kind, key, vector), asked(kind, key): the k nearest chunks of each asked row among all, block against block."""
    wide, high = max(1, -(-count // BLOCK)), max(1, -(-n // BLOCK))
    place = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m))
    q = vectors.join(_small(asked, count), ["kind", "key"], "left_semi").select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(high - 1)), lambda i: place("key", wide) * high + i)).alias("leaf"), F.lit(True).alias("asks"), "kind", "key", "vector"
    )
    c = vectors.filter("kind = 'c'").select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda i: i * high + place("key", high))).alias("leaf"), F.lit(False).alias("asks"), "kind", "key", "vector"
    )

    def each(leaf: pa.Table) -> Iterator[pa.RecordBatch]:
        asks = np.asarray(leaf.column("asks").combine_chunks())
        return _exact_block(leaf, np.flatnonzero(asks), np.flatnonzero(~asks), -1.0, k, dim)

    found = _by_leaf(q.unionByName(c), each, _RANKED)
    best = Window.partitionBy("kind", "a").orderBy(F.desc("cosine"), "b")
    return found.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).drop("_r")


def _asked(raw: DataFrame, classes: DataFrame, complete: Column) -> DataFrame:
    """(kind, key) of the representatives of the classes in which a row is asked for."""
    wanted = raw.filter(complete).select("kind", "h1", "h2").distinct()
    return classes.join(wanted, ["kind", "h1", "h2"], "left_semi").select("kind", "key")


def _cosine(a: str, b: str):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.round(dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), 12)


def nearest(
    chunks: DataFrame, questions: DataFrame | None = None, k: int = 10, at_least: float = 0.9, complete: Column | None = None, dim: int = 64,
    trees: int = 3, probes: int = 8, leaf_size: int = 512, sample: int = 262_144,
) -> DataFrame:
    """chunks(key, vector), questions(key, vector) -> (kind, key, neighbour, cosine, rank).

    kind is c where the row's vector is a chunk's and q where it is a question's; neighbours are chunks; rank counts from 1.
    The forest returns neighbours of cosine `at_least`; rows for which `complete`, a condition on kind and key, holds have all k, however far they are.
    """
    parts = [df.select(F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"), F.col("vector").cast("array<float>").alias("vector")) for kind, df in (("c", chunks), ("q", questions)) if df is not None]
    raw = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    raw = _hashed(raw.filter(F.col("key").isNotNull()))
    classes = materialize(
        _coded(raw, dim).groupBy("kind", "h1", "h2").agg(F.min(F.struct("key", "id", "code")).alias("r"), F.max("key").alias("last"))
        .select("kind", "h1", "h2", "r.id", "r.key", "r.code", (F.col("r.key") != F.col("last")).alias("many"))
    )
    n = classes.count()
    depth = max(1, min(math.ceil(math.log2(max(n, 2) / leaf_size)), int(math.log2(sample / 4))))
    probes = min(probes + MORE * max(0, depth - FLAT), trees * ((1 << depth) - 1))  # no more than there are leaves
    every = max(1, -(-n // sample))
    picked = classes.filter((F.col("kind") == "c") & (F.pmod(F.col("h1"), F.lit(every)) == 0)).select("code").toArrow()  # about `sample` codes, chosen by their hashes
    forest = Forest(_decode(picked.column(0), dim)[0], trees, depth)
    shift = depth - depth // 2  # subtrees of as many leaves as there are subtrees
    place = lambda df, column, schema, shift: _place(df, forest, probes, n, leaf_size, dim, column, schema, shift)

    candidates = materialize(_candidates(place(classes.select("id", "code"), "code", "id bigint, code binary", shift), at_least, k + 1, dim, shift))
    pairs, crowded = candidates.filter("b is not null"), candidates.filter("b is null").select(F.col("a").alias("leaf"))

    # exact vectors of the candidates alone
    used = materialize(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    exact = _vectors(raw.join(_small(used, used.count()), "id", "left_semi"), dim)
    of_a = exact.select(F.col("id").alias("ia"), "kind", F.col("key").alias("a"), F.col("vector").alias("va"))
    of_b = exact.filter("kind = 'c'").select(F.col("id").alias("ib"), F.col("key").alias("b"), F.col("vector").alias("vb"))
    named = pairs.select(F.col("a").alias("ia"), F.col("b").alias("ib")).join(of_a, "ia").join(of_b, "ib")
    ranked = materialize(named.select("kind", "a", "b", _cosine("va", "vb").alias("cosine")).filter(F.col("cosine") >= at_least))
    directed = ranked.unionByName(ranked.filter("kind = 'c'").select("kind", F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    if not crowded.isEmpty():
        directed = materialize(directed.unionByName(_crowded(raw, crowded, place, at_least, k + 1, dim)).distinct())
    if complete is not None:
        vectors = _vectors(raw, dim)
        have = directed.groupBy("kind", F.col("a").alias("key")).agg(F.count("*").alias("n")).filter(F.col("n") >= k)
        rest = materialize(_asked(raw, classes, complete).join(have, ["kind", "key"], "left_anti"))
        directed = directed.unionByName(_against_all(materialize(vectors.select("kind", "key", "vector")), rest, rest.count(), n, k + 1, dim)).distinct()

    # classes of copies: the first k + 1 keys of a class stand for it as neighbours, each member is a row of its own
    many = classes.filter("many").select("kind", "h1", "h2", F.col("key").alias("rep"))
    members = materialize(raw.select("kind", "key", "h1", "h2").join(_small(many, many.count()), ["kind", "h1", "h2"]).select("kind", "rep", "key").distinct())
    by_key = Window.partitionBy("rep").orderBy("key")
    firsts = members.filter("kind = 'c'").withColumn("_r", F.row_number().over(by_key)).filter(F.col("_r") <= k + 1).select("rep", F.col("key").alias("first"))
    own = firsts.select(F.lit("c").alias("kind"), F.col("rep").alias("a"), F.col("first").alias("neighbour"), F.lit(1.0).alias("cosine"))
    near = directed.join(firsts, F.col("b") == F.col("rep"), "left").select("kind", "a", F.coalesce("first", "b").alias("neighbour"), "cosine").unionByName(own)
    best = Window.partitionBy("kind", "a").orderBy(F.desc("cosine"), "neighbour")
    near = near.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1).drop("_r")
    each = near.join(members.withColumnRenamed("rep", "a"), ["kind", "a"], "left").select("kind", F.coalesce("key", "a").alias("key"), "neighbour", "cosine")
    each = each.filter((F.col("kind") == "q") | (F.col("key") != F.col("neighbour"))).groupBy("kind", "key", "neighbour").agg(F.max("cosine").alias("cosine"))
    last = Window.partitionBy("kind", "key").orderBy(F.desc("cosine"), "neighbour")
    return each.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
