"""Benchmark decontamination over a distributed positional inverted index.

The corpus is cut into segments of whole documents, about `SEGMENT_BYTES` of text each; a segment
holds, for every term, the sorted list of its positions. The segments are stored as a table (the
index), so a lost executor rereads one instead of building it again. A query set (benchmark items)
visits all segments: each window of an item takes the list of its rarest term, shifted by the
term's offset, and intersects the other terms' shifted lists from rare to common. What is left are
the window's starts: exact phrases at slop 0, proximity matches where each term may lie up to
`slop` words from its place.

The query set is broadcast in blocks of at most BLOCK_WORDS words, however many items there are.
No document leaves its segment, so nothing is shuffled and no key can become hot.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.shared import read, ship_code, stored

SEGMENT_BYTES, BLOCK_WORDS, WINDOW = 4 << 20, 400_000, 10
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Positions between two documents of a segment that no word takes: more than any slop.
GAP = 64

INDEX_SCHEMA = "segment bigint, doc_ids array<bigint>, n_words array<int>, terms binary, counts binary, deltas binary"
MATCH = "array<struct<item_id:bigint,start:int,end:int>>"
FOUND_SCHEMA = f"segment bigint, row int, doc_id bigint, n_words bigint, matches {MATCH}"


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8: runs of digits, letters a-z after lower-casing A-Z, and bytes of
    characters beyond ASCII."""
    return WORD.findall(text.lower()) if text else []


def segments(batches: Iterator[pa.RecordBatch], most: int = SEGMENT_BYTES) -> Iterator[tuple[list, list[bytes | None]]]:
    """Runs of whole documents with up to `most` bytes of text (a longer document stands alone)."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            if held and held + len(text or b"") > most:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(text)
            held += len(text or b"") + 64
    if ids:
        yield ids, texts


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional index of docs, one row a segment (INDEX_SCHEMA), stored in the shared folder.

    Null texts have no words; every row of docs has its place in doc_ids and n_words, repeated
    ids too. An empty table gives an empty index.
    """

    schema = _arrow(INDEX_SCHEMA)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for k, (ids, texts) in enumerate(segments(batches)):
            number: dict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            lens, parts = np.zeros(len(ids), np.int32), []
            for j, text in enumerate(texts):
                words = words_of(text)
                lens[j] = len(words)
                parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            terms = np.concatenate(parts)
            places = np.arange(len(terms), dtype=np.int32) + np.repeat(np.arange(len(ids), dtype=np.int32) * GAP, lens)
            places = places[np.argsort(terms, kind="stable")]
            counts = np.bincount(terms, minlength=len(number)).astype(np.int32)
            row = [[base + k], [ids], [lens], [b"\n".join(number)], [counts.tobytes()], [np.diff(places, prepend=np.int32(0)).tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema, strict=True)], schema=schema)

    ship_code(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("binary"))
    return stored(rows.mapInArrow(build, INDEX_SCHEMA), "index")


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of `size` words; of fewer words, but not none, the whole as one."""
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def query_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW, most: int = BLOCK_WORDS) -> Iterator[dict]:
    """Blocks {window: item ids} of at most about `most` words, streamed partition by partition."""
    block, held = {}, 0
    for row in items.select(F.col(item_id).cast("bigint"), F.col(text).cast("binary")).toLocalIterator():
        words = words_of(row[1])
        if held and held + len(words) > most:
            yield block
            block, held = {}, 0
        held += len(words)
        for window in windows_of(words, size):
            block.setdefault(window, set()).add(row[0])
    yield block


class QueryBlock:
    """Windows as rows of term numbers, ready to be looked up in a segment."""

    def __init__(self, block: dict) -> None:
        self.windows = sorted(block)
        self.items = [sorted(block[w], key=lambda x: (x is not None, x)) for w in self.windows]
        self.terms = {t: i for i, t in enumerate(sorted({t for w in self.windows for t in w}))}
        width = max(map(len, self.windows), default=1)
        self.size = np.array([len(w) for w in self.windows], np.int32)
        self.grid = np.full((len(self.windows), width), -1, np.int32)
        for i, w in enumerate(self.windows):
            self.grid[i, : len(w)] = [self.terms[t] for t in w]

    def starts(self, lists: dict[int, np.ndarray], lengths: np.ndarray, slop: int = 0) -> Iterator[tuple[int, np.ndarray]]:
        """(window, its starts) in a segment. lists: positions by the number of a term there is;
        lengths: the lists' lengths by term, 0 for a term that the segment lacks."""
        if not len(self.windows):
            return
        padded = np.append(lengths, np.iinfo(np.int64).max)  # -1 is the last: no term
        for w in np.flatnonzero(padded[self.grid].min(axis=1) > 0):
            row = self.grid[w, : self.size[w]]
            at = None
            for j in np.argsort(lengths[row], kind="stable"):
                shifted = lists[row[j]] - np.int32(j)
                if at is None:
                    at = shifted
                elif slop:
                    k = np.minimum(np.searchsorted(shifted, at - slop), len(shifted) - 1)
                    at = at[np.abs(shifted[k] - at) <= slop]
                else:
                    k = np.searchsorted(shifted, at)
                    at = at[shifted[np.minimum(k, len(shifted) - 1)] == at]
                if not len(at):
                    break
            if len(at):
                yield int(w), at


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Visits every document of the index with every window of items.

    One row a document row: segment, row, doc_id, n_words and matches, the merged word spans (end
    exclusive) that windows of an item cover. Null or empty items match nothing; items that share
    an id count as one; slop (at most GAP - 1) admits proximity matches.
    """
    spark = index.sparkSession
    ship_code(spark)
    if not 0 <= slop < GAP:
        raise ValueError(f"slop must lie in 0..{GAP - 1}")

    schema = _arrow(FOUND_SCHEMA)

    def visit(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = QueryBlock(block.value)
            for batch in batches:
                for row in batch.to_pylist():
                    lens = np.array(row["n_words"], np.int64)
                    first = np.cumsum(lens) - lens + np.arange(len(lens)) * GAP
                    found: dict[int, dict] = defaultdict(lambda: defaultdict(list))
                    for w, at in wanted.starts(*_lists(row, wanted), slop):
                        owner = np.searchsorted(first, at, "right") - 1
                        owner = np.maximum(owner, 0)
                        low = np.maximum(at - first[owner], 0)
                        high = np.minimum(at - first[owner] + wanted.size[w], lens[owner])
                        for d, a, b in zip(owner.tolist(), low.tolist(), high.tolist(), strict=True):
                            for item in wanted.items[w]:
                                found[d][item].append((a, b))
                    matches = [[{"item_id": i, "start": a, "end": b} for i, spans in found[d].items() for a, b in _merged(spans)] if d in found else [] for d in range(len(lens))]
                    cols = [[row["segment"]] * len(lens), range(len(lens)), row["doc_ids"], lens, matches]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        return index.mapInArrow(run, FOUND_SCHEMA)

    blocks = query_blocks(items, item_id, text, size, block_words)
    shared = spark.sparkContext.broadcast(next(blocks))
    found = visit(shared)
    parts = []
    for block in blocks:
        parts = parts or [stored(found, "found")]
        shared.destroy()
        shared = spark.sparkContext.broadcast(block)
        parts.append(stored(visit(shared), "found"))
    if not parts:
        return found
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("segment", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches"))


def _lists(row: dict, wanted: QueryBlock) -> tuple[dict[int, np.ndarray], np.ndarray]:
    counts = np.frombuffer(row["counts"], np.int32)
    places = np.cumsum(np.frombuffer(row["deltas"], np.int32), dtype=np.int32)
    ends = np.cumsum(counts)
    lists, lengths = {}, np.zeros(len(wanted.terms), np.int64)
    for i, t in enumerate(row["terms"].split(b"\n") if len(counts) else ()):
        k = wanted.terms.get(t)
        if k is not None:
            lists[k] = places[ends[i] - counts[i] : ends[i]]
            lengths[k] = counts[i]
    return lists, lengths


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """search() of items over docs; the result has a row for each row of docs."""
    return search(build_index(docs), items, **options)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows in which a window of an item occurs; same columns.

    Rows are told apart by a hash of id and text, so a clean row stays beside a contaminated one
    of the same id, and null ids are judged as others are.
    """
    key = F.xxhash64("doc_id", "text")
    found = search(build_index(docs.select(key.alias("key"), "text"), doc_id="key"), items)
    hit = found.filter(F.size("matches") > 0).select(F.col("doc_id").alias("__hit")).distinct()
    return docs.join(hit, key == F.col("__hit"), "left_anti")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item: words, words hit, and the items found."""
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: F.coalesce(m["item_id"].cast("string"), F.lit("")))))
    covered = F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["end"] - 1))))
    return found.select(
        "doc_id",
        "n_words",
        F.when(F.size("matches") > 0, F.size(covered)).otherwise(0).cast("bigint").alias("n_hit"),
        F.size(names).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("matches") > 0).alias("contaminated"),
    )


#: Words are numbered, windows joined to document words by hash of ten words; the texts are those of the tables.
OP2_SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, len(v) AS n, array_to_string(v, ' ') AS phrase FROM (
  SELECT item_id, w[i : i + least(len(w), 10) - 1] AS v FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM iw WHERE len(w) > 0))),
dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
cand AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT c.r, c.i, c.n, win.item_id FROM cand c JOIN win ON win.n = c.n AND win.phrase = c.phrase),
nh AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
ni AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), '') AS item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN nh USING (r) LEFT JOIN ni USING (r)
"""
