"""Comparing large frames by trees of multiset digests.

Rows fall into leaves by the leading bits of their key's hash; a leaf's state is its number of rows and
eight exact sums of bits drawn from the rows' SHA-256, so states add up: to the nodes above, over partitions,
and over repeated rows. One aggregation over a frame gives the whole tree, whatever the frame's order
and partitioning. Two frames are equal where their roots are; else the differing nodes lead down to the
leaves that differ, and only rows of these leaves are ever compared, without a collect.

Keys that differ in many rows share leaves like any others, so no leaf is hot unless one key is; and a
hot key's rows are summed up on the map side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.operators.compare import close

#: Bits of a leaf's number, and of each step from a node to its children.
BITS, STEP = 12, 4
_SLICES = [f"s{i}" for i in range(8)]


def _text(columns: Sequence[tuple[str, Column]]) -> Column:
    """One text of named columns: no two rows of different values have the same. A value stands behind its
    length, null has none."""
    texts = [(c, value.cast("string")) for c, value in columns]
    told = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for _, t in texts]
    return F.concat(F.lit("".join(f"{len(c)}:{c}" for c, _ in texts) + "="), *told)


def leaf_of(df: DataFrame, key: Sequence[str], bits: int = BITS) -> Column:
    """The leaf of a row: the leading bits of its key's hash; without a key, of the row's exact columns."""
    kinds = dict(df.dtypes)
    exact = list(key) or sorted(c for c, t in kinds.items() if t not in ("double", "float"))
    return F.shiftrightunsigned(F.xxhash64(_text([(c, F.col(c)) for c in exact])), 64 - bits).cast("int")


def canonical(df: DataFrame, places: Mapping[str, int] | None = None) -> Column:
    """A row's text: columns by name; doubles rounded where told, -0.0 as 0.0, null unlike any text."""
    out = []
    for c, kind in sorted(df.dtypes):
        value = F.col(c)
        if kind in ("double", "float"):
            value = (F.round(value, places[c]) if places and c in places else value) + F.lit(0.0)
        out.append((c, value))
    return _text(out)


def digest_sums(digest: str) -> list[Column]:
    """Aggregates s0 to s7: the state of a multiset of rows, given the rows' SHA-256. Each is a sum of 28 bits
    that follow from it, so a long holds 2**35 rows exactly; sums of sums are made as decimals."""
    out = []
    for i in range(len(_SLICES) // 2):
        spread = F.xxhash64(F.lit(i), F.col(digest))
        out += [F.shiftrightunsigned(spread, 36), spread.bitwiseAND(F.lit((1 << 28) - 1))]
    return [F.sum(part).alias(s) for part, s in zip(out, _SLICES, strict=True)]


def partition_digests(source: DataFrame, partition: Sequence[str] = (), recipe: str = "") -> DataFrame:
    """(partition, rows, digest): the multiset digest of each partition's rows, whatever their order; without a
    partition, that of the whole frame in one row."""
    marked = source.select(*partition, F.sha2(canonical(source), 256).alias("__digest"))
    summed = marked.groupBy(*partition).agg(F.count(F.lit(1)).alias("rows"), *digest_sums("__digest"))
    parts = [F.col(c).cast("string") for c in ("rows", *_SLICES)]
    return summed.select(*partition, "rows", F.sha2(F.concat_ws(",", F.lit(recipe), *parts), 256).alias("digest"))


def leaves(df: DataFrame, key: Sequence[str], places: Mapping[str, int] | None = None, bits: int = BITS) -> DataFrame:
    """(node, rows, s0 to s7): the states of a frame's leaves, at most 2**bits rows."""
    digest = F.sha2(canonical(df, places), 256)
    marked = df.select(leaf_of(df, key, bits).alias("node"), digest.alias("__digest"))
    return marked.groupBy("node").agg(F.count(F.lit(1)).alias("rows"), *digest_sums("__digest"))


def tree(df: DataFrame, key: Sequence[str], places: Mapping[str, int] | None = None, bits: int = BITS) -> DataFrame:
    """(level, node, rows, digest) of a frame from the root, level 0, to the leaves. An empty frame has no nodes."""
    depth = -(-bits // STEP)
    level = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    nodes = leaves(df, key, places, bits).select(level, "*").withColumn("node", F.expr(f"shiftright(node, greatest(0, {bits} - level * {STEP}))"))
    summed = nodes.groupBy("level", "node").agg(F.sum("rows").alias("rows"), *[F.sum(F.col(s).cast("decimal(38,0)")).alias(s) for s in _SLICES])
    return summed.select("level", "node", "rows", F.sha2(F.concat_ws(",", F.col("rows").cast("string"), *[F.col(s).cast("string") for s in _SLICES]), 256).alias("digest"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(level, node, rows_a, rows_b): the nodes of two trees that differ, 0 rows where one has none."""
    left = a.select("level", "node", F.col("rows").alias("rows_a"), F.col("digest").alias("digest_a"))
    right = b.select("level", "node", F.col("rows").alias("rows_b"), F.col("digest").alias("digest_b"))
    both = left.join(right, ["level", "node"], "full_outer").filter(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
    return both.select("level", "node", F.coalesce("rows_a", F.lit(0)).alias("rows_a"), F.coalesce("rows_b", F.lit(0)).alias("rows_b"))


def narrowed(a: DataFrame, b: DataFrame, key: Sequence[str], places: Mapping[str, int] | None = None, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Of two frames the rows that lie in leaves which differ."""
    depth = -(-bits // STEP)
    apart = differing(tree(a, key, places, bits), tree(b, key, places, bits)).filter(F.col("level") == depth).select(F.col("node").alias("__leaf"))
    # At most 2**bits numbers.
    return tuple(df.withColumn("__leaf", leaf_of(df, key, bits)).join(F.broadcast(apart), "__leaf", "left_semi").select(*df.columns) for df in (a, b))


def differences(a: DataFrame, b: DataFrame, key: Sequence[str], places: Mapping[str, int] | None = None, rtol: float = 0.0, atol: float = 0.0, bits: int = BITS) -> DataFrame:
    """(key, column, a, b) as text: the cells that differ between two frames of one key a row; a row that only
    one of them has shows with column `*`, the other side null. Doubles may differ within
    atol + rtol * |b|; leaves are chosen by rounded values, so leaves apart by rounding alone are
    read and give no row."""
    kinds = dict(a.dtypes)
    left, right = narrowed(a, b, key, places, bits)
    values = [c for c in a.columns if c not in key]
    x = left.select(F.lit(True).alias("__a"), *[F.col(c).alias(f"a_{c}") for c in a.columns])
    y = right.select(F.lit(True).alias("__b"), *[F.col(c).alias(f"b_{c}") for c in a.columns])
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
    both = x.join(y, same, "full_outer")
    alone = F.col("__a").isNull() | F.col("__b").isNull()
    cells = [F.when(alone, F.struct(F.lit("*").alias("column"), F.when(F.col("__a"), "there").alias("a"), F.when(F.col("__b"), "there").alias("b")))]
    for c in values:
        apart = ~close(F.col(f"a_{c}"), F.col(f"b_{c}"), kinds[c], rtol, atol)
        cells.append(F.when(~alone & apart, F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").cast("string").alias("a"), F.col(f"b_{c}").cast("string").alias("b"))))
    named = [F.when(F.col("__a"), F.col(f"a_{k}")).otherwise(F.col(f"b_{k}")).alias(k) for k in key]
    return both.select(*named, F.explode(F.array_compact(F.array(*cells))).alias("cell")).select(*key, "cell.*")


@dataclass(frozen=True)
class Route:
    """One way to a task's result: bronze, silver, gold or monolithic."""

    task: str
    name: str
    result: DataFrame


def equivalence(routes: Sequence[Route], key: Sequence[str], places: Mapping[str, int] | None = None, bits: int = BITS) -> DataFrame:
    """(route, rows, equal, ranges): for each route its rows, whether its tree's root is that of the first
    route, and how many leaves are not. Each result is read once. Routes of different tasks, of
    one name, or of different columns cannot be compared."""
    if len({r.task for r in routes}) > 1:
        raise ValueError(f"routes of different tasks: {', '.join(sorted({r.task for r in routes}))}")
    if len({r.name for r in routes}) < len(routes):
        raise ValueError("two routes of one name")
    for r in routes:
        if dict(r.result.dtypes) != dict(routes[0].result.dtypes):
            raise ValueError(f"route {r.name} has other columns than {routes[0].name}")
    depth = -(-bits // STEP)
    trees = None
    for at, r in enumerate(routes):
        one = tree(r.result, key, places, bits).withColumns({"at": F.lit(at), "route": F.lit(r.name)})
        trees = one if trees is None else trees.unionByName(one)
    # By node: what the first route has there, and which routes have the same.
    by_node = trees.groupBy("level", "node").agg(F.max(F.when(F.col("at") == 0, F.col("digest"))).alias("first"), F.collect_list(F.struct("at", "rows", "digest")).alias("all"))

    def own(at: int) -> Column:
        return F.get(F.filter("all", lambda x: x["at"] == at), F.lit(0))

    each = [F.struct(F.lit(r.name).alias("route"), own(at).alias("own")) for at, r in enumerate(routes)]
    seen = by_node.select("level", "first", F.inline(F.array(*each)))
    apart = ~F.col("own.digest").eqNullSafe(F.col("first"))
    found = seen.groupBy("route").agg(
        F.coalesce(F.sum(F.when(F.col("level") == 0, F.col("own.rows"))), F.lit(0)).alias("rows"),
        (F.count_if(apart & (F.col("level") == 0)) == 0).alias("equal"),
        F.count_if(apart & (F.col("level") == depth)).alias("ranges"),
    )
    names = found.sparkSession.createDataFrame([(r.name,) for r in routes], "route string")
    return names.join(found, "route", "left").select("route", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("equal", F.lit(True)).alias("equal"), F.coalesce("ranges", F.lit(0)).alias("ranges"))
