"""Parent-child links to full hierarchies.

1. Components: every node follows its parent by pointer doubling (each round a self-join, the distance doubles) until
   it stands on a root, on a missing parent, or, after the images stop shrinking, on a loop. The end reached labels
   the component; a loop is labelled by its least id.
2. Each component is co-located by its label and walked depth-first with node colouring (white, grey, black): a child
   that is still grey closes a loop (back edge).
   Nothing but the line from the root to the node at hand is held besides the component itself; lists of ancestors and joined paths are
   made for the output alone, and only if they are asked for.
3. A component of more than `largest` rows is never put into one task: depth and place come by doubling too, with the same
   results. Whether a path is the one expected is told by its length and two hashes, which combine along the line, so a row stays as small as it is; only
   paths and ancestors that are asked for become arrays.

Input: nodes(scope, id, parent, mark) and, if wanted, carry, which comes out with the node as it is; (scope, id) is unique. Defined results: null or blank parents make roots; a parent
that is no node of the scope gives `no_root` for the node and all below it; a node that is its own parent is a `cycle`;
null ids take no part; a null scope is a scope like any other; a null mark counts as an empty one. Empty input gives an empty result.

Output: scope, id, status (root, tree, no_root, cycle, below_cycle), root, depth (a root has 1), path (marks joined from
root to node), ancestors (ids from the root to the node itself), expected (whether path is the node's carry), back_edge. root, depth, path, ancestors and
expected are null for no_root, cycle and below_cycle; path and ancestors are null too where they are not asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, materialize

OUT = "scope string, id string, status string, root string, depth int, path string, ancestors array<string>, expected boolean, back_edge boolean, carry string"
#: Primes and bases of the two hashes of a path.
HASHES = [(2_147_483_647, 1_000_003), (2_147_483_629, 998_244_353)]
NO_SCOPE = "\x00"  # stands for a null scope, so that joins may use plain equality


def _double(open_: DataFrame, state: DataFrame) -> DataFrame:
    """Each open node takes over where the node it points to points."""
    to = state.select(F.col("scope").alias("_s"), F.col("id").alias("_i"), F.col("ptr").alias("_p"), F.col("kind").alias("_kind"), F.col("least").alias("_m"))
    return open_.join(to, (F.col("scope") == F.col("_s")) & (F.col("ptr") == F.col("_i"))).select(
        "scope", "id", F.col("_p").alias("ptr"), F.col("_kind").alias("kind"), F.least("least", "_m").alias("least")
    )


def components(nodes: DataFrame) -> DataFrame:
    """nodes(scope, id, parent) -> (scope, id, ptr, kind, least, label); kind is root, no_root or loop; ptr is the end reached."""
    up = nodes.select(F.col("scope").alias("_s"), F.col("id").alias("_i"))
    kind = F.when(F.col("parent").isNull(), "root").when(F.col("_i").isNull(), "no_root")
    state = materialize(
        nodes.join(up, (F.col("scope") == F.col("_s")) & (F.col("parent") == F.col("_i")), "left")
        .select("scope", "id", F.when(kind.isNotNull(), F.col("id")).otherwise(F.col("parent")).alias("ptr"), kind.alias("kind"), F.col("id").alias("least"))
    )
    before = None
    while True:
        still = state.filter("kind is null")
        now = still.agg(F.count("*"), F.countDistinct("scope", "ptr"), F.sum(F.xxhash64("scope", "id", "least").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            break
        before, old = now, state
        state = materialize(state.filter("kind is not null").unionByName(_double(still, state)))
        forget(old)
    if now[0]:  # nodes that never end stand on loops now: the image of the last round is exactly the loops' nodes
        still, ends = state.filter("kind is null"), state.select(F.col("scope").alias("_s"), F.col("id").alias("_i"), F.col("least").alias("_m"))
        loop = still.join(ends, (F.col("scope") == F.col("_s")) & (F.col("ptr") == F.col("_i"))).select("scope", "id", "ptr", F.lit("loop").alias("kind"), "least", F.col("_m").alias("label"))
        return state.filter("kind is not null").withColumn("label", F.col("ptr")).unionByName(loop)
    return state.withColumn("label", F.col("ptr"))


def _walk(rows: list[tuple], full: bool = True) -> Iterator[tuple]:
    """Walks one or more whole components; rows: (scope, id, parent, mark, kind, label, carry) in any order."""
    children: dict[str, list[str]] = {}
    mark, starts, of, carried = {}, [], {}, {}
    for scope, node, parent, own, kind, label, carry in rows:
        mark[node], of[node], carried[node] = own, scope, carry
        if label == node:
            starts.append((node, kind))
        if parent is not None and not (kind == "no_root" and label == node):
            children.setdefault(parent, []).append(node)
    for start, kind in starts:
        grey: dict[str, int] = {}  # the nodes on the line, with their places
        line: list[str] = []
        size, same = [0], [True]  # of the path down to each node of the line: its length, and whether it is the node's carry
        on_loop, found, last = set(), [], None
        stack = [(start, False)]
        while stack:
            node, leave = stack.pop()
            if leave:
                del grey[node]
                line.pop()
                size.pop()
                same.pop()
                continue
            grey[node] = len(line)
            line.append(node)
            own, carry = mark[node], carried[node] or ""
            length, above = size[-1] + len(own), carried[line[-2]] or "" if len(line) > 1 else ""
            if len(carry) != length:
                equal = False
            elif same[-1]:
                equal = carry.endswith(own) and carry.startswith(above)
            else:
                equal = carry == "".join(mark[x] for x in line)
            size.append(length)
            same.append(equal)
            stack.append((node, True))
            if kind == "root":
                path, up = ("".join(mark[x] for x in line), list(line)) if full else (None, None)
                yield of[node], node, "root" if node == start else "tree", start, len(line), path, up, equal, False, carried[node]
            else:
                found.append(node)
            for child in children.get(node, ()):
                if child in grey:  # a back edge: all on the line from child to node is a loop
                    on_loop.update(line[grey[child] :])
                    last = child
                else:
                    stack.append((child, False))
        for node in found:
            status = "no_root" if kind == "no_root" else "cycle" if node in on_loop else "below_cycle"
            yield of[node], node, status, None, None, None, None, None, node == last, carried[node]


def _walk_all(batches: Iterator[pd.DataFrame], full: bool) -> Iterator[pd.DataFrame]:
    """Components arrive one after the other; only the last one may go on in the next batch."""
    held: list[tuple] = []
    cols = ["scope", "id", "parent", "mark", "kind", "label", "carry"]
    names = [c.split()[0] for c in OUT.split(", ")]

    def out(rows: list[tuple]) -> pd.DataFrame:
        by: dict[str, list] = {}
        for r in rows:
            by.setdefault(r[0], []).append(r)
        done = pd.DataFrame([x for group in by.values() for x in _walk(group, full)], columns=names)
        done["depth"] = done["depth"].astype("Int32")
        return done

    for pdf in batches:
        pdf = pdf.astype(object).where(pdf.notna(), None)
        held += list(zip(*(pdf[c] for c in cols)))
        if not held:
            continue
        end = (held[-1][0], held[-1][5])
        cut = len(held)
        while cut and (held[cut - 1][0], held[cut - 1][5]) == end:
            cut -= 1
        if cut:
            yield out(held[:cut])
            held = held[cut:]
    if held:
        yield out(held)


def _hashed(text: str, at: int) -> str:
    """SQL of a text's hash as one number and of the base to the power of its length, as a struct."""
    prime, base = HASHES[at]
    return f"aggregate(split({text}, ''), named_struct('h', 0L, 'p', 1L), (s, c) -> if(c = '', s, named_struct('h', (s.h * {base}L + ascii(c)) % {prime}L, 'p', s.p * {base}L % {prime}L)))"


def _by_doubling(big: DataFrame, full: bool) -> DataFrame:
    """The same results for components too large for one task: places on the line grow by doubling, the rest follows from kind and ptr."""
    both = range(len(HASHES))
    tree = big.filter("kind = 'root'").withColumns({f"_{k}": F.expr(_hashed("mark", k)) for k in both}).select(
        "scope", "id", F.col("parent").alias("ptr"), F.lit(1).alias("depth"), F.length("mark").cast("bigint").alias("size"), F.col("id").alias("root"), *[c for k in both for c in (F.col(f"_{k}.h").alias(f"h{k}"), F.col(f"_{k}.p").alias(f"p{k}"))],
        *([F.array("id").alias("line"), F.array("mark").alias("marks")] if full else []), "carry",
    )
    while not tree.filter("ptr is not null").isEmpty():
        to = tree.select(*[F.col(c).alias(f"_{c}") for c in tree.columns if c != "carry"])
        ended = F.col("_id").isNull()
        grown = {"depth": F.col("depth") + F.col("_depth"), "size": F.col("size") + F.col("_size"), "root": F.col("_root")}
        for k in both:
            prime = HASHES[k][0]
            grown |= {f"h{k}": (F.col(f"_h{k}") * F.col(f"p{k}") + F.col(f"h{k}")) % prime, f"p{k}": F.col(f"_p{k}") * F.col(f"p{k}") % prime}
        grown |= {c: F.concat(f"_{c}", c) for c in ("line", "marks") if full}
        before = tree
        tree = materialize(
            tree.join(to, (F.col("scope") == F.col("_scope")) & (F.col("ptr") == F.col("_id")), "left").select(
                "scope", "id", F.col("_ptr").alias("ptr"), *[F.when(ended, F.col(c)).otherwise(grown[c]).alias(c) for c in tree.columns if c in grown], "carry"
            ).select(*tree.columns)
        )
        forget(before)
    tree = tree.withColumn("_c", F.coalesce("carry", F.lit("")))
    equal = F.length("_c") == F.col("size")
    for k in both:
        equal = equal & (F.expr(_hashed("_c", k))["h"] == F.col(f"h{k}"))
    none = lambda kind: F.lit(None).cast(kind)
    whole = tree.select(
        "scope", "id", F.when(F.col("depth") == 1, "root").otherwise("tree").alias("status"), "root", "depth", (F.array_join("marks", "") if full else none("string")).alias("path"),
        (F.col("line") if full else none("array<string>")).alias("ancestors"), equal.alias("expected"), F.lit(False).alias("back_edge"), "carry",
    )
    on = big.filter("kind = 'loop'").select(F.col("scope").alias("_s"), F.col("ptr").alias("_i")).distinct()
    rest = big.filter("kind <> 'root'").join(on, (F.col("scope") == F.col("_s")) & (F.col("id") == F.col("_i")), "left")
    status = F.when(F.col("kind") == "no_root", "no_root").when(F.col("_i").isNotNull(), "cycle").otherwise("below_cycle")
    lost = rest.select(
        "scope", "id", status.alias("status"), none("string").alias("root"), none("int").alias("depth"), none("string").alias("path"), none("array<string>").alias("ancestors"),
        none("boolean").alias("expected"), (F.col("_i").isNotNull() & (F.col("id") == F.col("label"))).alias("back_edge"), "carry",
    )
    return whole.unionByName(lost)


def hierarchy(nodes: DataFrame, full: bool = True, largest: int = 200_000) -> DataFrame:
    """nodes(scope, id, parent, mark) -> one row per node, see the module's text. full: with path and ancestors; largest: rows of a component that one task may walk."""
    parent = F.when(F.trim(F.col("parent")) != "", F.col("parent"))
    nodes = materialize(
        nodes.filter(F.col("id").isNotNull())
        .select(F.coalesce("scope", F.lit(NO_SCOPE)).alias("scope"), "id", parent.alias("parent"), F.coalesce("mark", F.lit("")).alias("mark"), (F.col("carry") if "carry" in nodes.columns else F.lit(None)).cast("string").alias("carry"))
    )
    ends = components(nodes)
    labelled = nodes.join(ends.select("scope", "id", "ptr", "kind", "label"), ["scope", "id"])
    sizes = ends.groupBy("scope", "label").count().filter(F.col("count") > largest).select(F.col("scope").alias("_s"), F.col("label").alias("_l"))
    big_ones = [] if sizes.isEmpty() else [True]
    if big_ones:
        sizes = F.broadcast(sizes)  # one row per `largest` rows of input at most
        on = (F.col("scope") == F.col("_s")) & (F.col("label") == F.col("_l"))
        big, small = materialize(labelled.join(sizes, on, "left_semi")), labelled.join(sizes, on, "left_anti")
    else:
        small = labelled
    placed = small.select("scope", "id", "parent", "mark", "kind", "label", "carry").repartition("scope", "label").sortWithinPartitions("scope", "label")
    done = placed.mapInPandas(lambda batches: _walk_all(batches, full), OUT)
    if big_ones:
        done = done.unionByName(_by_doubling(big, full))
    return done.withColumn("scope", F.when(F.col("scope") != NO_SCOPE, F.col("scope")))


def descendants(tree: DataFrame) -> DataFrame:
    """All pairs (ancestor, descendant, distance) of nodes that reach a root; a node is no descendant of itself."""
    return tree.filter("depth > 1").select(
        "scope", F.col("id").alias("descendant"), F.posexplode(F.slice("ancestors", 1, F.col("depth") - 1)).alias("_at", "ancestor"), "depth"
    ).select("scope", "ancestor", "descendant", (F.col("depth") - 1 - F.col("_at")).alias("distance"))
