"""Near duplicates by an n-gram Jaccard join with vertical partitioning.

A document is the set of its distinct word n-grams. They have one global order, from rare to common
(by the power of two that their document frequency reaches) and then by hash: a gram's key is its
place in it. The global order is cut into FRAGMENTS vertical fragments of equal weight.

Candidates: documents that could link share an n-gram among the rarest of either (the prefix that
the similarity leaves). Each document belongs to one cell, that of the commonest prefix gram it has
and of its size; cells have at most about CELL documents, so a family of copies fills a few cells
whole. Two cells are a candidate pair where a prefix gram is in both, and where the sizes and the
grams left behind it allow a link (length and position filters).

Join: a cell's grams are dealt out by fragment. For a pair of cells (or a cell alone) each fragment
counts the partial overlaps of all their documents on its own, as a packed matrix; the matrices of
a pair's fragments are then summed up and compared with the sizes. So pairs of documents exist only
inside matrices, of which there are as many as pairs of cells; what leaves a sum is one row a
document with its link count and a spanning edge.

Document frequencies come from the exchange of packed keys between segments and buckets; keys are
64-bit hashes of n-grams, for the frequencies shortened to 32 bits within a bucket (a clash there
can only change the order, not a result), as keys to 58 bits beside the power of two. Equal texts
are one class from the start.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.exchange import batches, buckets_for, gathered, hashes_of, packed, spread, squeezed, unsqueezed
from terrace.llm.lm_score import _schema
from terrace.llm.shared import give_back, input_bytes, joined, read, ship_code, stored

SEGMENT_BYTES = 6 << 20
#: Documents of a cell, grams of a cell (beyond one document), fragments, columns of a matrix at a
#: time, and bytes of stored rows for each task that packs cells or sums up matrices.
CELL, CELL_GRAMS, FRAGMENTS, WIDTH, TASK_BYTES = 1024, 1 << 19, 4, 2048, 4 << 20
WORDS, PERCENT = 5, 75
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

SEGMENTS = "segment bigint, doc_ids array<bigint>, row_keys array<bigint>, digests array<binary>, sizes array<int>, active array<int>, lens array<int>, tokens binary, hashes binary"
SENT = "bucket int, segment bigint, keys binary, counts binary"
ANSWERS = "segment bigint, bucket int, counts binary"
SETS = "digest binary, size int, alone int, prefix int, grams array<bigint>"
#: What a cell sends for a fragment: its documents, and their grams by document; or, with counts, a
#: matrix of partial overlaps of the documents of left and right (only left: of its lower triangle).
PACKED = "cell bigint, fragment int, digests binary, sizes binary, owners binary, grams binary, counts binary"
PARTIAL = "i bigint, j bigint, left binary, left_sizes binary, right binary, right_sizes binary, counts binary"
LINKS = "digest binary, root binary, links bigint"
#: Bits of a gram's key that are its hash; the power of two of its frequency stands above them.
HASH_BITS = 58


def needed(size: int, percent: int = PERCENT) -> int:
    """The least overlap that a set of this size can have with a set it links to."""
    return -(-percent * size // 100)


def gram_sets(tokens: np.ndarray, lens: np.ndarray, hashes: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document's number, gram) of all documents' distinct n-grams, by document, then hash.

    A document of fewer words, but not none, has its whole sequence as its one gram.
    """
    words = hashes[tokens]
    first = np.cumsum(lens) - lens
    owner = np.repeat(np.arange(len(lens)), lens)
    place = np.arange(len(tokens)) - first[owner]
    odd = _ODD[np.arange(n) % len(_ODD)] + np.uint64(2) * np.arange(n, dtype=np.uint64)
    h = np.zeros(len(tokens), np.uint64)
    for j in range(n):
        h[: max(0, len(h) - j)] += words[j:] * odd[j]
    short = np.flatnonzero((lens > 0) & (lens < n))
    whole = place + n <= lens[owner]
    grams, owners = h[whole], owner[whole]
    if len(short):
        own = [np.uint64(int(sum(int(words[first[d] + j]) * int(odd[j]) for j in range(lens[d])) + 0x1D8E4E27C47D124F * int(lens[d])) & 0xFFFFFFFFFFFFFFFF) for d in short.tolist()]
        grams, owners = np.concatenate([grams, np.array(own, np.uint64)]), np.concatenate([owners, short])
    grams = grams ^ grams >> np.uint64(31)
    grams = grams * np.uint64(0xFF51AFD7ED558CCD)
    grams = grams ^ grams >> np.uint64(32)
    order = np.lexsort((grams, owners))
    grams, owners = grams[order], owners[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
    return owners[new], grams[new]


def _segments(docs: DataFrame, n: int) -> DataFrame:
    """docs (doc_id, row key, text as bytes) in segments. Of equal texts in a segment the first is
    active, and only active texts have tokens; every row has its digest and the size of its set."""
    schema = _schema(SEGMENTS)

    def cut(segment: int, ids: list, keys: list, texts: list) -> tuple:
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        digests, known, active, parts = [], {}, [], []
        for k, text in enumerate(texts):
            words = (text or b"").lower().split()
            digests.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else b"")
            if words and digests[-1] not in known:
                known[digests[-1]] = len(active)
                active.append(k)
                parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        tokens = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        lens = np.array([len(p) for p in parts], np.int64)
        hashes = hashes_of(number, len(number))
        sizes = np.bincount(gram_sets(tokens, lens, hashes, n)[0], minlength=len(lens))
        return segment, ids, keys, digests, [int(sizes[known[d]]) if d else 0 for d in digests], active, lens, squeezed(tokens), hashes.tobytes()

    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        segment, held, size = TaskContext.get().partitionId() << 32, ([], [], []), 0
        for b in source:
            for i, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                for column, value in zip(held, (i, key, text.as_py()), strict=True):
                    column.append(value)
                size += len(held[2][-1] or b"") + 64
                if size >= SEGMENT_BYTES:
                    yield cut(segment, *held)
                    segment, held, size = segment + 1, ([], [], []), 0
        if held[0]:
            yield cut(segment, *held)

    return stored(docs.mapInArrow(lambda source: batches(schema, rows(source), 1), SEGMENTS), "segments")


def _own_grams(r: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
    return gram_sets(unsqueezed(r["tokens"]), np.array(r["lens"], np.int64), np.frombuffer(r["hashes"], np.uint64), n)


def _frequencies(segments: DataFrame, buckets: int, n: int) -> DataFrame:
    """For every segment, in how many active texts of the corpus each of its grams is."""
    sent_schema, answer_schema = _schema(SENT), _schema(ANSWERS)

    def send(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in source:
                for r in b.to_pylist():
                    keys, counts = np.unique(_own_grams(r, n)[1], return_counts=True)
                    order, bounds = spread(keys, buckets)
                    short = (keys >> np.uint64(32)).astype(np.uint32)
                    for k in np.flatnonzero(np.diff(bounds)).tolist():
                        part = order[bounds[k] : bounds[k + 1]]
                        yield k, r["segment"], short[part].tobytes(), packed(counts[part])

        yield from batches(sent_schema, rows(), 64)

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [np.frombuffer(r["keys"], np.uint32) for r in rows]
        counts = np.concatenate([np.frombuffer(r["counts"], "<i4" if len(r["counts"]) == 4 * len(k) else "<i8") for r, k in zip(rows, keys, strict=True)])
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, counts).astype(np.int64)[which]
        parts = np.split(total, np.cumsum([len(k) for k in keys])[:-1])
        out = ((r["segment"], r["bucket"], packed(p)) for r, p in zip(rows, parts, strict=True))
        return pa.Table.from_batches(batches(answer_schema, out), schema=answer_schema)

    return segments.select("segment", "lens", "tokens", "hashes").mapInArrow(send, SENT).groupBy("bucket").applyInArrow(count, ANSWERS)


def _candidate_sets(segments: DataFrame, answers: DataFrame, buckets: int, n: int, percent: int) -> DataFrame:
    """The grams that other texts share, in global order, of each text whose prefix has one."""
    schema = _schema(SETS)

    def order_sets(own: pa.Table, counts: pa.Table) -> pa.Table:
        if not own.num_rows or not counts.num_rows:
            return pa.Table.from_batches([], schema=schema)
        r = own.to_pylist()[0]
        owners, grams = _own_grams(r, n)
        keys, which = np.unique(grams, return_inverse=True)
        frequency = gathered(list(zip(counts["bucket"].to_pylist(), counts["counts"].to_pylist(), strict=True)), *spread(keys, buckets))[which]
        shared = frequency > 1
        key = gram_keys(grams, frequency)
        order = np.lexsort((key, shared, owners))
        key = key[order]
        sizes = np.bincount(owners, minlength=len(r["lens"]))
        alone = np.bincount(owners[~shared], minlength=len(sizes)) if len(owners) else sizes
        first = np.cumsum(sizes) - sizes
        out = []
        for d in np.flatnonzero(sizes).tolist():
            size, single = int(sizes[d]), int(alone[d])
            prefix = size - needed(size, percent) + 1 - single
            if prefix > 0 and single < size:
                out.append((r["digests"][r["active"][d]], size, single, min(prefix, size - single), key[first[d] + single : first[d] + size]))
        made = pa.Table.from_batches(batches(schema, iter(out)), schema=schema)
        give_back()
        return made

    return segments.drop("doc_ids", "row_keys", "sizes").groupBy("segment").cogroup(answers.groupBy("segment")).applyInArrow(order_sets, SETS)


def gram_keys(grams: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """Places in the global order: the power of two of the frequency, then the hash."""
    power = np.minimum(np.floor(np.log2(np.maximum(frequency, 1))), 31).astype(np.uint64)
    return (power << np.uint64(HASH_BITS) | grams >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges (a, b): the smallest node that edges lead to.

    Smallest labels travel along edges and each label takes over its own label, until a round
    changes nothing; every round is a few joins and ends in a stored table.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        onward = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = stored(moved.join(onward, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.filter("label != old").limit(1).count():
            return labels


def _cells(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(digest, cell) of the documents that share a prefix gram, and the candidate pairs (i, j) of
    different cells, i below j."""
    prefixes = sets.select("digest", "size", "alone", F.posexplode(F.slice("grams", F.lit(1), F.col("prefix"))).alias("at", "gram"))
    common = prefixes.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1")
    postings = stored(prefixes.join(common, "gram").select("digest", "size", (F.col("size") - F.col("alone") - F.col("at")).alias("left"), "gram", "n"), "postings")

    homes = postings.groupBy("digest").agg(F.max(F.struct("n", "gram")).alias("top"), F.max("size").alias("size"))
    homes = homes.select("digest", "size", F.col("top.gram").alias("gram"), F.floor(F.log("size") / F.log(F.lit(100 / percent))).alias("kind")) if percent < 100 else homes.select("digest", "size", F.col("top.gram").alias("gram"), F.col("size").alias("kind"))
    homes = stored(homes, "homes")
    chunks = homes.groupBy("gram", "kind").agg(F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("size") / CELL_GRAMS)).alias("chunks"))
    cell = F.xxhash64("gram", "kind", F.pmod(F.xxhash64("digest"), F.col("chunks")))
    cells = stored(homes.join(chunks, ["gram", "kind"]).select("digest", cell.alias("cell")), "cells")

    held = joined(postings, cells, "digest").groupBy("gram", "cell").agg(F.max("left").alias("most"), F.min("size").alias("low"), F.max("size").alias("high"))
    held = stored(held, "held")
    a, b = (held.select("gram", *[F.col(c).alias(f"{side}_{c}") for c in ("cell", "most", "low", "high")]) for side in "ab")
    # Of documents that link, the first gram in common has enough grams behind it in both.
    reach = F.least("a_most", "b_most") * (100 + percent) >= (F.col("a_low") + F.col("b_low")) * percent
    sizes = (F.col("a_high") * 100 >= F.col("b_low") * percent) & (F.col("b_high") * 100 >= F.col("a_low") * percent)
    pairs = a.join(b, "gram").filter((F.col("a_cell") < F.col("b_cell")) & reach & sizes).select(F.col("a_cell").alias("i"), F.col("b_cell").alias("j")).distinct()
    return cells, stored(pairs, "pairs")


def _cuts(sets: DataFrame) -> list[int]:
    """Keys at which the global order is cut into FRAGMENTS fragments of about equal weight."""
    low = HASH_BITS - 6
    found = sorted((r["bin"], r["count"]) for r in sets.select(F.explode("grams").alias("g")).groupBy(F.shiftright("g", low).alias("bin")).count().collect())
    weight, seen, cuts = sum(n for _, n in found), 0, []
    for at, n in found:
        if seen >= weight * (len(cuts) + 1) / FRAGMENTS and len(cuts) < FRAGMENTS - 1:
            cuts.append(at << low)
        seen += n
    return cuts


def overlaps(left: tuple[np.ndarray, np.ndarray, int], right: tuple[np.ndarray, np.ndarray, int] | None) -> np.ndarray:
    """How many keys each document of left has in common with each of right (None: of left). A side
    is its documents' numbers by key, the keys, and the number of documents."""
    sides = [left] if right is None else [left, right]
    if right is None:
        keys, counts = np.unique(left[1], return_counts=True)
        keys = keys[counts > 1]
    else:
        keys = np.intersect1d(left[1], right[1])
    out = np.zeros((left[2], sides[-1][2]), np.float32)
    columns = []
    for owners, own, _ in sides:
        at = np.searchsorted(keys, own)
        there = at < len(keys)
        there[there] = keys[at[there]] == own[there]
        order = np.argsort(at[there], kind="stable")
        columns.append((owners[there][order], at[there][order]))
    for a in range(0, len(keys), WIDTH):
        parts = []
        for (owners, at), (_, _, n) in zip(columns, sides, strict=True):
            low, high = np.searchsorted(at, [a, a + WIDTH])
            x = np.zeros((n, min(WIDTH, len(keys) - a)), np.float32)
            x[owners[low:high], at[low:high] - a] = 1
            parts.append(x)
        out += parts[0] @ parts[-1].T
    return out


def _squeezed_counts(counts: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs, compressed; empty if all are 0."""
    top = counts.max(initial=0)
    if not top:
        return b""
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + zstandard.ZstdCompressor(level=1).compress(counts.astype(kind).tobytes())


def _counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[0]}").astype(np.int32)


def _packed(sets: DataFrame, cells: DataFrame, pairs: DataFrame, cuts: list[int]) -> DataFrame:
    """PACKED rows by cell and fragment: the matrix of a cell alone, and the grams of cells in a pair."""
    schema, edges = _schema(PACKED), np.array(cuts, np.int64)
    partnered = pairs.select(F.col("i").alias("cell")).unionByName(pairs.select(F.col("j").alias("cell"))).distinct().withColumn("partnered", F.lit(True))
    marked = stored(cells.join(partnered, "cell", "left").select("digest", "cell", F.coalesce("partnered", F.lit(False)).alias("partnered")), "marked")
    tasks = max(8, input_bytes(sets) // TASK_BYTES)
    placed = joined(sets, marked, "digest").select(F.pmod(F.xxhash64("cell"), F.lit(tasks)).alias("task"), "cell", "partnered", "digest", "size", "grams")

    def pack(table: pa.Table) -> pa.Table:
        members: dict[int, list[int]] = defaultdict(list)
        for k, c in enumerate(table["cell"].to_pylist()):
            members[c].append(k)
        digests, sizes, partnered = (table[c].to_pylist() for c in ("digest", "size", "partnered"))
        grams = [np.asarray(g.values) for g in table["grams"]]

        def rows() -> Iterator[tuple]:
            for cell, own in members.items():
                if len(own) == 1 and not partnered[own[0]]:
                    continue
                own.sort(key=digests.__getitem__)
                names, held = b"".join(digests[k] for k in own), np.array([sizes[k] for k in own], "<i4").tobytes()
                owners = np.repeat(np.arange(len(own), dtype=np.int32), [len(grams[k]) for k in own])
                keys = np.concatenate([grams[k] for k in own])
                fragment = np.searchsorted(edges, keys, "right")
                for f in range(len(cuts) + 1):
                    inside = fragment == f
                    o, g = owners[inside], keys[inside]
                    if len(g) and len(own) > 1:
                        counts = _squeezed_counts(overlaps((o, g, len(own)), None)[np.tril_indices(len(own), -1)])
                        if counts:
                            yield cell, f, names, held, None, None, counts
                    if len(g) and partnered[own[0]]:
                        yield cell, f, names, held, o.tobytes(), g.tobytes(), None

        made = pa.Table.from_batches(batches(schema, rows(), 16), schema=schema)
        give_back()
        return made

    return stored(placed.groupBy("task").applyInArrow(pack, PACKED), "packed")


def _partial(packed: DataFrame, pairs: DataFrame) -> DataFrame:
    """PARTIAL rows: the matrices of each fragment, of cells alone and of pairs of cells."""
    schema = _schema(PARTIAL)
    nothing = F.lit(None).cast("binary")
    alone = packed.filter("counts is not null").select(F.col("cell").alias("i"), F.col("cell").alias("j"), F.col("digests").alias("left"), F.col("sizes").alias("left_sizes"), nothing.alias("right"), nothing.alias("right_sizes"), "counts")
    sides = packed.filter("grams is not null").drop("counts")
    left, right = (sides.select(F.col("cell").alias(n), "fragment", *[F.col(c).alias(f"{n}_{c}") for c in ("digests", "sizes", "owners", "grams")]) for n in "ij")
    both = left.join(pairs, "i").join(right, ["j", "fragment"]).select("i", "j", *[f"{n}_{c}" for n in "ij" for c in ("digests", "sizes", "owners", "grams")])

    def multiply(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in source:
                for k in range(b.num_rows):
                    i, j, *side = (column[k].as_py() for column in b.columns)
                    ends = [(np.frombuffer(side[at + 2], np.int32), np.frombuffer(side[at + 3], np.int64), len(side[at + 1]) // 4) for at in (0, 4)]
                    counts = _squeezed_counts(overlaps(*ends).ravel())
                    if counts:
                        yield i, j, side[0], side[1], side[4], side[5], counts

        yield from batches(schema, rows(), 16)
        give_back()

    return stored(alone.unionByName(both.mapInArrow(multiply, PARTIAL)), "partial")


def reached(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of the links between rows and columns: a number for each row and each column, -1
    where there is no link."""
    rows, columns = np.full(found.shape[0], -1), np.full(found.shape[1], -1)
    for start in np.flatnonzero(found.any(axis=1)).tolist():
        if rows[start] >= 0:
            continue
        new = np.array([start])
        while len(new):
            rows[new] = start
            more = np.flatnonzero(found[new].any(axis=0) & (columns < 0))
            columns[more] = start
            new = np.flatnonzero(found[:, more].any(axis=1) & (rows < 0)) if len(more) else more
    return rows, columns


def _links(partial: DataFrame, percent: int) -> DataFrame:
    """(digest, root, links): the matrices of a pair's fragments summed up and compared."""
    schema = _schema(LINKS)

    def add(table: pa.Table) -> pa.Table:
        pairs: dict[tuple, list[int]] = defaultdict(list)
        for k, key in enumerate(zip(table["i"].to_pylist(), table["j"].to_pylist(), strict=True)):
            pairs[key].append(k)

        def rows() -> Iterator[tuple]:
            for (i, j), own in pairs.items():
                one = {c: table[c][own[0]].as_py() for c in ("left", "left_sizes", "right", "right_sizes")}
                total = sum((_counts(table["counts"][k].as_py()) for k in own[1:]), _counts(table["counts"][own[0]].as_py()))
                sides = [one["left"], one["right"]] if one["right"] is not None else [one["left"]]
                names = [[side[k : k + 16] for k in range(0, len(side), 16)] for side in sides]
                sizes = [np.frombuffer(one[c], "<i4").astype(np.int64) for c in ("left_sizes", "right_sizes") if one[c] is not None]
                n, m = len(sizes[0]), len(sizes[-1])
                both = np.zeros((n, m), np.int64)
                if i == j:
                    both[np.tril_indices(n, -1)] = total
                    both += both.T
                else:
                    both[:] = total.reshape(n, m)
                found = (both > 0) & (100 * both >= percent * (sizes[0][:, None] + sizes[-1][None, :] - both))
                linked = found
                if i == j:  # a document's row and column are one node
                    linked = found | np.diag(found.any(axis=1))
                across, down = reached(linked)
                for side, marks, degree in ((0, across, found.sum(axis=1)), (-1, down, found.sum(axis=0)))[: 1 if i == j else 2]:
                    for k in np.flatnonzero(marks >= 0).tolist():
                        yield names[side][k], names[0][marks[k]], int(degree[k])

        made = pa.Table.from_batches(batches(schema, rows()), schema=schema)
        give_back()
        return made

    tasks = max(8, input_bytes(partial) // TASK_BYTES)
    dealt = partial.withColumn("task", F.pmod(F.xxhash64("i", "j"), F.lit(tasks)))
    return stored(dealt.groupBy("task").applyInArrow(add, LINKS), "links")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row_key: str | None = None, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: doc_id, row_key, n_shingles, n_links, component_id.

    Texts link when 100 * common n-grams >= percent * all n-grams of both. component_id is the
    smallest doc_id that links lead to, n_links the number of other texts linked directly. Rows
    with equal words are one text; null and empty texts have no n-gram, link with nothing and stand
    alone. Repeated ids are fine; a null id never is the smallest. row_key (default the id) is a
    bigint column that comes back with each row.
    """
    spark = docs.sparkSession
    ship_code(spark)
    segments = _segments(docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(row_key or doc_id).cast("bigint").alias("key"), F.col(text).cast("binary").alias("text")), n)
    buckets = buckets_for(input_bytes(segments))
    found = _candidate_sets(segments, _frequencies(segments, buckets, n), buckets, n, percent)
    sets = stored(found.groupBy("digest").agg(F.first(F.struct("size", "alone", "prefix", "grams")).alias("s")).select("digest", "s.*"), "sets")

    cells, pairs = _cells(sets, percent)
    links = _links(_partial(_packed(sets, cells, pairs, _cuts(sets)), pairs), percent)
    labels = components(links.filter("digest != root").select(F.col("digest").alias("a"), F.col("root").alias("b")).distinct())
    degree = links.groupBy("digest").agg(F.sum("links").alias("links"))

    members = segments.select(F.explode(F.arrays_zip("doc_ids", "row_keys", "digests", "sizes")).alias("m")).select(
        F.col("m.doc_ids").alias("doc_id"), F.col("m.row_keys").alias("row_key"), F.col("m.digests").alias("digest"), F.col("m.sizes").cast("bigint").alias("n_shingles")
    )
    texts = members.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    named = texts.join(labels.withColumnRenamed("node", "digest"), "digest", "left").join(degree, "digest", "left")
    named = stored(named.filter("n > 1 or label is not null"), "texts")
    smallest = named.filter("label is not null").groupBy("label").agg(F.min("least").alias("of_all"))
    ends = stored(named.join(smallest, "label", "left").select("digest", F.coalesce("of_all", "least").alias("end"), "links", F.coalesce("label", "digest").alias("component")), "ends")
    return members.join(ends, "digest", "left").select("doc_id", "row_key", "n_shingles", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("end", "doc_id").alias("component_id"), "component")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near duplicates, that with the smallest id, nulls last;
    same columns. Rows are told apart by a hash of id and text: rows equal in both share their fate."""
    key = F.xxhash64("doc_id", "text")
    found = near_duplicates(docs.select("doc_id", "text", key.alias("__key")), row_key="__key")
    grouped = stored(found.filter("component is not null").select("doc_id", "row_key", "component"), "grouped")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))["row_key"]
    keep = grouped.groupBy("component").agg(first.alias("row_key")).select("row_key")
    gone = grouped.join(keep, "row_key", "left_anti").select(F.col("row_key").alias("__gone")).distinct()
    return docs.join(gone, key == F.col("__gone"), "left_anti")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: doc_id, n_shingles, component_id and n_links, the other texts it links to."""
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "n_links")
