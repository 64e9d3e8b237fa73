"""Nearest neighbours by inner product from vantage-point trees, one for each shard.

Largest inner product is made a question of distance: with M the largest norm, every vector v gets
one more component, the root of M^2 - |v|^2, and a query gets 0. Then |q - v|^2 = |q|^2 + M^2 - 2 q.v,
and the triangle inequality holds for candidates of any norm.

Equal vectors are one point with their smallest ids; a point brings as many as a result can hold,
so copies cost nothing and none is lost. Points go to the nearest of some pivots (a bounded sample),
cells too large for a tree are cut by a hash, and each part is one row of the index: the tree and
its points. Queries visit the index in bounded blocks: first the trees of their own cell, which
gives a radius for each query, then all others under that radius.

A subtree is left out when `factor` times its least possible distance is beyond the radius. With
factor 1 the result is exact; a larger factor prunes more and may miss neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.llm.shared import read, ship_code, stored
from terrace.llm.vectors import matrix, padded, whole

#: Points a tree, points a leaf, pivots at most, queries a block.
TREE, LEAF, PIVOTS, BLOCK = 8192, 128, 2048, 16_384
#: Of the registered query. Measured recall is in the README.
FACTOR = 3.0


@dataclass
class Tree:
    """A vantage-point tree over points. Nodes are in order of depth; node i parts its points by their
    distance to `vantage[i]`: those of the inner child lie within [low, high][i, 0], those of the
    outer one within [low, high][i, 1]. child[i] >= 0 is a node, below 0 it is leaf -1 - child.
    Leaf k holds points order[bounds[k] : bounds[k + 1]]."""

    vantage: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    order: np.ndarray
    bounds: np.ndarray

    @staticmethod
    def over(points: np.ndarray, leaf: int = LEAF) -> Tree:
        """points: doubles with the component that equals out their norms. Vantage points are the
        ones farthest from the node's middle; halves are of equal size, ties by place."""
        vantage, low, high, child, leaves = [], [], [], [], []
        todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(points)), -1, 0)]
        while todo:
            here, parent, side = todo.pop(0)
            if parent >= 0:
                child[parent][side] = len(vantage) if len(here) > leaf else -1 - len(leaves)
            if len(here) <= leaf and parent >= 0:
                leaves.append(here)
                continue
            held = points[here]
            far = held[np.argmax(((held - held.mean(axis=0)) ** 2).sum(axis=1))] if len(here) else np.zeros(points.shape[1])
            apart = np.sqrt(((held - far) ** 2).sum(axis=1))
            by = np.argsort(apart, kind="stable")
            halves = by[: (len(by) + 1) // 2], by[(len(by) + 1) // 2 :]
            vantage.append(far)
            low.append([apart[h].min(initial=np.inf) for h in halves])
            high.append([apart[h].max(initial=-np.inf) for h in halves])
            child.append([0, 0])
            todo += [(here[h], len(vantage) - 1, k) for k, h in enumerate(halves)]
        return Tree(np.array(vantage), np.array(low), np.array(high), np.array(child), np.concatenate(leaves), np.cumsum([0, *map(len, leaves)]))

    def least_distances(self, queries: np.ndarray) -> np.ndarray:
        """(queries x leaves): a bound below the distance from each query to any point of each leaf."""
        apart = np.sqrt(np.maximum((queries**2).sum(axis=1)[:, None] + (self.vantage**2).sum(axis=1) - 2 * queries @ self.vantage.T, 0))
        nodes, leaves = np.zeros((len(self.vantage), len(queries))), np.zeros((len(self.bounds) - 1, len(queries)))
        for i, children in enumerate(self.child):
            for k, c in enumerate(children):
                bound = np.maximum(nodes[i], np.maximum(self.low[i, k] - apart[:, i], apart[:, i] - self.high[i, k]))
                (leaves if c < 0 else nodes)[-1 - c if c < 0 else c] = bound
        return leaves.T


class Best:
    """The nearest found so far for each query: scores and ids, best first, ties to smaller ids."""

    def __init__(self, queries: np.ndarray, k: int, least: np.ndarray | None = None) -> None:
        self.queries, self.k = queries, k
        self.scores, self.ids = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
        self.least = np.full(len(queries), -np.inf) if least is None else least

    def worst(self) -> np.ndarray:
        """The score that a candidate must reach."""
        return np.maximum(self.scores[:, -1], self.least)

    def offer(self, which: np.ndarray, points: np.ndarray, ids: list[np.ndarray], slack: float) -> None:
        """Candidates for the queries named by `which`. A product of matrices chooses pairs, with some
        slack for its rounding; their scores are summed again pair by pair, so that equal vectors
        score alike wherever they stand."""
        rough = self.queries[which] @ points.T
        if rough.shape[1] > self.k:
            cut = np.partition(rough, rough.shape[1] - self.k, axis=1)[:, -self.k]
        else:
            cut = np.full(len(which), -np.inf)
        rows, cols = np.nonzero(rough >= (np.maximum(cut, self.worst()[which]) - slack)[:, None])
        if not len(rows):
            return
        exact = (self.queries[which[rows]] * points[cols]).sum(axis=1)
        many = np.array([len(i) for i in ids])[cols]
        found = np.concatenate([ids[c] for c in cols])
        rows, exact = np.repeat(which[rows], many), np.repeat(exact, many)
        touched = np.unique(rows)
        old = self.scores[touched] > -np.inf
        rows = np.concatenate([rows, np.repeat(touched, old.sum(axis=1))])
        exact, found = np.concatenate([exact, self.scores[touched][old]]), np.concatenate([found, self.ids[touched][old]])
        order = np.lexsort((found, -exact, rows))
        rows, exact, found = rows[order], exact[order], found[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
        kept = rank < self.k
        self.scores[rows[kept], rank[kept]], self.ids[rows[kept], rank[kept]] = exact[kept], found[kept]


def search(tree: Tree, points: np.ndarray, ids: list[np.ndarray], best: Best, largest: float, factor: float) -> None:
    """Visits the tree's leaves for all queries of `best`, each query's most promising leaf first."""
    squares = (best.queries**2).sum(axis=1) + largest**2
    slack = 1e-9 * max(1.0, float(squares.max(initial=0)))
    bounds = tree.least_distances(np.hstack([best.queries, np.zeros((len(best.queries), 1))]))

    def open_to(leaf: int, which: np.ndarray) -> np.ndarray:
        radius = np.sqrt(np.maximum(squares[which] - 2 * (best.worst()[which] - slack), 0))
        return which[factor * bounds[which, leaf] <= radius + np.sqrt(slack)]

    everyone, first = np.arange(len(best.queries)), bounds.argmin(axis=1)
    for turn in range(2):
        for leaf in range(bounds.shape[1]):
            which = open_to(leaf, everyone[(first == leaf) == (turn == 0)])
            if len(which):
                at = tree.order[tree.bounds[leaf] : tree.bounds[leaf + 1]]
                best.offer(which, points[at], [ids[i] for i in at], slack)


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is whole, finite and not zero."""
    return rows.filter(whole(F.col(vector)) & F.exists(vector, lambda c: c != 0))


def points_of(rows: DataFrame, most: int) -> DataFrame:
    """(vector, ids): different vectors, each with its `most` smallest ids. Numbering with a limit
    keeps that many a vector on the map side already, so a vector of any number of rows is small."""
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).filter(F.col("__rank") <= most)
    return ranked.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _with_cell(points: DataFrame, pivots: np.ndarray, dims: int, largest: float) -> DataFrame:
    """Adds cell, the number of the nearest pivot, and salt, a hash of the vector."""
    ship_code(points.sparkSession)
    shared = points.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = shared.value
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 4096):
                b = whole_batch.slice(at, 4096)
                x = _lifted(matrix(b.column(b.schema.get_field_index("vector")), dims), largest)
                cell = ((ends**2).sum(axis=1) - 2 * x @ ends.T).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=[*b.schema.names, "cell"])

    schema = points.withColumn("cell", F.lit(0)).schema
    return points.mapInArrow(run, schema).withColumn("salt", F.xxhash64("vector"))


def _lifted(x: np.ndarray, largest: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(largest**2 - (x**2).sum(axis=1), 0))[:, None]])


def _parts(counted: dict[int, int], most: int) -> dict[int, int]:
    return {cell: -(-n // most) for cell, n in counted.items()}


def _by_cell(numbers: dict[int, int]):
    """A column that looks a number up by cell; there are at most PIVOTS cells."""
    pairs = [F.lit(x) for cell, n in numbers.items() for x in (cell, n)]
    return F.element_at(F.create_map(*pairs), F.col("cell"))


INDEX = "cell int, part int, n int, vectors binary, ids array<array<bigint>>"
FOUND = "vector_key bigint, ids array<bigint>, scores array<double>"


@dataclass
class Index:
    """trees: one row a tree (cell, part, its points and their ids); pivots and the largest norm."""

    trees: DataFrame
    pivots: np.ndarray
    largest: float
    dims: int


def build(rows: DataFrame, dims: int, most: int, tree_rows: int = TREE, pivots: int = PIVOTS) -> Index:
    """Indexes every row of (vec_id, vector). Pivots are at most `pivots` vectors, those of the
    smallest hashes: one for each tree_rows points. Results can hold `most` ids."""
    spark = rows.sparkSession
    ship_code(spark)
    points = stored(points_of(rows, most), "points")
    n, largest = points.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, c: a + c.cast("double") * c)))).first()
    if not n:
        return Index(points.limit(0).select(F.lit(0).alias("cell")), np.zeros((0, dims + 1)), 0.0, dims)
    chosen = points.select("vector").orderBy(F.xxhash64(F.lit(7), "vector"), "vector").limit(min(pivots, -(-n // tree_rows))).collect()
    ends = _lifted(np.array([r["vector"] for r in chosen], np.float64), largest)
    dealt = stored(_with_cell(points, ends, dims, largest), "cells")
    parts = _parts({r["cell"]: r["n"] for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect()}, tree_rows)
    dealt = dealt.withColumn("part", F.pmod("salt", _by_cell(parts)).cast("int"))

    def grow(table: pa.Table) -> pa.Table:
        x = matrix(table.column("vector").combine_chunks(), dims)
        tree = Tree.over(_lifted(x, largest))
        columns = {
            "cell": table.column("cell")[:1],
            "part": table.column("part")[:1],
            "n": pa.array([len(x)], pa.int32()),
            "vectors": pa.array([x[tree.order].tobytes()], pa.binary()),
            "ids": pa.array([[table.column("ids")[int(i)].as_py() for i in tree.order]], pa.list_(pa.list_(pa.int64()))),
        }
        nodes = {"vantage": tree.vantage, "low": tree.low, "high": tree.high, "child": tree.child.astype(np.int64), "bounds": tree.bounds.astype(np.int64)}
        columns |= {k: pa.array([v.tobytes()], pa.binary()) for k, v in nodes.items()}
        return pa.table(columns)

    schema = INDEX + ", vantage binary, low binary, high binary, child binary, bounds binary"
    trees = dealt.select("cell", "part", "vector", "ids").groupBy("cell", "part").applyInArrow(grow, schema)
    return Index(stored(trees, "trees"), ends, float(largest), dims)


def _tree_of(r: dict, dims: int) -> tuple[Tree, np.ndarray, list[np.ndarray]]:
    def of(name: str, kind: str, *shape: int) -> np.ndarray:
        return np.frombuffer(r[name], kind).reshape(shape)

    tree = Tree(of("vantage", "<f8", -1, dims + 1), of("low", "<f8", -1, 2), of("high", "<f8", -1, 2), of("child", "<i8", -1, 2), np.arange(r["n"]), of("bounds", "<i8", -1))
    return tree, of("vectors", "<f8", -1, dims), [np.array(i, np.int64) for i in r["ids"]]


def _visit(trees: DataFrame, index: Index, keys: np.ndarray, queries: np.ndarray, cells: np.ndarray, least: np.ndarray | None, k: int, factor: float) -> DataFrame:
    """(vector_key, ids, scores) of a block of queries: where `least` is none the trees of each
    query's own cell, else all other trees. A task carries its queries' best from tree to tree, and gives at most k a query."""
    dims, largest = index.dims, index.largest
    shared = trees.sparkSession.sparkContext.broadcast((keys, queries, cells, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, queries, cells, least = shared.value
        best = Best(queries, k, least)
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                which = np.flatnonzero((cells == r["cell"]) == (least is None))
                if not len(which):
                    continue
                tree, points, ids = _tree_of(r, dims)
                some = Best(queries[which], k, None if least is None else least[which])
                some.scores, some.ids = best.scores[which], best.ids[which]
                search(tree, points, ids, some, largest, factor)
                best.scores[which], best.ids[which] = some.scores, some.ids
        got = np.flatnonzero(best.scores[:, 0] > -np.inf)
        for at in range(0, len(got), 4096):
            part = got[at : at + 4096]
            true = [best.scores[i] > -np.inf for i in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[part], pa.int64()), pa.array([best.ids[i][t] for i, t in zip(part, true, strict=True)], pa.list_(pa.int64())), pa.array([best.scores[i][t] for i, t in zip(part, true, strict=True)], pa.list_(pa.float64()))],
                names=["vector_key", "ids", "scores"],
            )

    return trees.mapInArrow(run, FOUND)


def _best_of(found: DataFrame, k: int) -> DataFrame:
    """(vector_key, near): the k nearest of all that the tasks gave, best first."""
    each = found.select("vector_key", F.inline(F.arrays_zip("scores", "ids"))).withColumnsRenamed({"scores": "score", "ids": "vec_id"})
    ranked = each.withColumn("__rank", F.row_number().over(Window.partitionBy("vector_key").orderBy(F.desc("score"), "vec_id"))).filter(F.col("__rank") <= k)
    return ranked.groupBy("vector_key").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id", "score"))).alias("near"))


def nearest(index: Index, points: DataFrame, k: int, factor: float = FACTOR, block: int = BLOCK) -> DataFrame:
    """(vector_key, near array<struct<down, vec_id, score>>, own_score) for different vectors (vector_key,
    vector): the k nearest indexed rows of each, and its product with itself. Blocks of at most some `block` queries, near one another,
    go to the driver and from there to all tasks."""
    spark = points.sparkSession
    dealt = stored(_with_cell(points, index.pivots, index.dims, index.largest), "queries")
    counted = {r["cell"]: r["n"] for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    first, parts, held, blocks = {}, _parts(counted, block), 0, 0
    for cell in sorted(counted):  # small cells share a block, large ones are cut by their hash
        if held and (held + counted[cell] > block or parts[cell] > 1):
            blocks, held = blocks + 1, 0
        first[cell], held = blocks, held + counted[cell]
        if parts[cell] > 1:
            blocks, held = blocks + parts[cell], 0
    results = []
    numbered = dealt.withColumn("block", _by_cell(first) + F.pmod("salt", _by_cell(parts))) if counted else dealt
    for b in range(blocks + (held > 0)):
        table = numbered.filter(F.col("block") == b).select("vector_key", "vector", "cell").toArrow()
        if not table.num_rows:
            continue
        keys, cells = table.column(0).to_numpy(), table.column(2).to_numpy()
        queries = matrix(table.column(1).combine_chunks(), index.dims)
        own = index.trees.filter(F.col("cell").isin(np.unique(cells).tolist()))
        home = stored(_best_of(_visit(own, index, keys, queries, cells, None, k, factor), k), "home")
        radius = dict(home.filter(F.size("near") >= k).select("vector_key", F.element_at("near", k)["score"]).toLocalIterator())
        least = np.array([radius.get(key, -np.inf) for key in keys.tolist()])
        others = _visit(index.trees, index, keys, queries, cells, least, k, factor)
        told = home.select("vector_key", F.col("near.vec_id").alias("ids"), F.col("near.score").alias("scores"))
        own = spark.createDataFrame(pa.table({"vector_key": keys, "own_score": (queries * queries).sum(axis=1)}))
        results.append(stored(_best_of(told.unionByName(others), k).join(own, "vector_key"), "near"))
    if not results:
        return spark.createDataFrame([], "vector_key bigint, near array<struct<down double, vec_id bigint, score double>>, own_score double")
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def neighbours(rows: DataFrame, k: int = 20, every: int = 20, factor: float = FACTOR, vec_id: str = "vec_id", vector: str = "embedding", **sizes: int) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every` its k nearest other
    rows by inner product in double precision, nearest first, ties to the smaller id.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
    without an id. A shorter vector counts as filled up with zeros. Where fewer than k others are
    there, all of them come. Repeated rows (of one id and one vector) are one row; rows of one id with
    different vectors are different rows, queries and candidates of their own. Ids are read as
    long; other columns are not looked at. An empty table gives no rows.
    """
    kept = usable(rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("vector")).filter("vec_id is not null"), "vector").distinct()
    kept, dims = padded(kept)
    asking = kept.filter(F.col("vec_id") % every == 0)
    index = build(kept, dims, k + 1, **{n: v for n, v in sizes.items() if n in ("tree_rows", "pivots")})
    different = stored(asking.groupBy("vector").agg(F.count("*").alias("asked")).withColumn("vector_key", F.monotonically_increasing_id()), "asking")
    near = nearest(index, different.select("vector_key", "vector"), k + 1, factor, **{n: v for n, v in sizes.items() if n == "block"})
    answered = different.select("vector_key", "vector").join(near, "vector_key").select("vector", "near", "own_score")
    own = asking.select(F.col("vec_id").alias("query_id"), "vector").join(answered, "vector")
    # The query's own row is the entry of its id and of its score with itself, if it is among the k + 1.
    place = F.array_position(F.transform("near", lambda x: (x["vec_id"] == F.col("query_id")) & (x["score"] == F.col("own_score"))), True)
    others = F.when(place > 0, F.filter("near", lambda x, i: i + 1 != place)).otherwise(F.slice("near", 1, k))
    each = own.select("query_id", F.posexplode(others).alias("at", "other"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("other.vec_id").alias("vec_id"), F.col("other.score").alias("score"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row of embeddings whose id is divisible by 20."""
    return neighbours(read(spark, sf_dir, "embeddings"))
