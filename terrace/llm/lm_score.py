"""Language-model scoring by deleted interpolation.

Word bigram, unigram and uniform estimates by maximum likelihood are mixed with weights that depend
on how often the context was seen (buckets by its power of two). The weights are learned by
expectation-maximisation on a deleted part of the training documents, under counts from the rest;
the final counts are those of all training documents.

Counts are exact and of the whole corpus: segments of documents send their distinct unigrams and
bigrams to buckets and get the counts back (see exchange), so neither a model nor a vocabulary is
held in one place. Keys are 64-bit hashes of words and word pairs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.exchange import batches, buckets_for, gathered, hashes_of, mixed, packed, spread
from terrace.llm.shared import fold_of, input_bytes, read, ship_code, stored

SEGMENT_BYTES = 8 << 20
RETAINED, DELETED, HELD_OUT = 0, 1, 2
START, END = b" ", b"\n"
SEGMENTS = "segment bigint, role int, doc_ids array<bigint>, lens array<int>, tokens binary, hashes binary"
SENT = "bucket int, segment bigint, role int, kind int, keys binary, counts binary"
ANSWERS = "segment bigint, role int, kind int, bucket int, seen binary, retained binary, total bigint, different bigint"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
TRIPLES = "joint bigint, context bigint, word bigint, n bigint"


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space after lower-casing A-Z, and one end."""
    return [*(text or b"").lower().split(), END]


def _segments(docs: DataFrame) -> DataFrame:
    """docs (doc_id, role, text as bytes) cut into segments of one role each."""
    schema = _schema(SEGMENTS)

    def cut(role: int, ids: list, texts: list) -> tuple:
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        for fixed in (START, END):
            number[fixed]
        lens, parts = [], []
        for text in texts:
            words = tokens_of(text)
            lens.append(len(words))
            parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        return role, ids, lens, np.concatenate(parts).tobytes(), hashes_of(number, len(number)).tobytes()

    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        segment, held = TaskContext.get().partitionId() << 32, {r: ([], [], 0) for r in (RETAINED, DELETED, HELD_OUT)}
        for b in source:
            for i, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids, texts, size = held[role]
                ids.append(i)
                texts.append(text.as_py())
                size += len(texts[-1] or b"") + 64
                held[role] = (ids, texts, size)
                if size >= SEGMENT_BYTES:
                    yield (segment, *cut(role, ids, texts))
                    segment, held[role] = segment + 1, ([], [], 0)
        for role, (ids, texts, _) in held.items():
            if ids:
                yield (segment, *cut(role, ids, texts))
                segment += 1

    return stored(docs.mapInArrow(lambda source: batches(schema, rows(source), 1), SEGMENTS), "segments")


class _Segment:
    """A segment's distinct words and bigrams and their keys. Word 0 is the start, 1 the end."""

    def __init__(self, tokens: bytes, lens: list[int], hashes: bytes) -> None:
        self.tokens, self.lens = np.frombuffer(tokens, np.int32), np.array(lens, np.int64)
        self.words = np.frombuffer(hashes, np.uint64)
        before = np.roll(self.tokens, 1)
        before[np.cumsum(self.lens) - self.lens] = 0
        self.before = before
        pairs, self.pair_of, self.pair_counts = np.unique(before.astype(np.int64) * len(self.words) + self.tokens, return_inverse=True, return_counts=True)
        self.pairs = mixed(self.words[pairs // len(self.words)], self.words[pairs % len(self.words)])
        self.word_counts = np.bincount(self.tokens, minlength=len(self.words))

    def keys(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        return (self.words, self.word_counts) if kind == 1 else (self.pairs, self.pair_counts)


def _exchange(segments: DataFrame, buckets: int) -> DataFrame:
    """Counts of every segment's words (kind 1) and bigrams (kind 2): seen in training, and in its retained part."""
    sent_schema, answer_schema = _schema(SENT), _schema(ANSWERS)

    def send(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in source:
                for r in b.to_pylist():
                    own = _Segment(r["tokens"], r["lens"], r["hashes"])
                    for kind in (1, 2):
                        keys, counts = own.keys(kind)
                        order, bounds = spread(keys, buckets)
                        for k in np.flatnonzero(np.diff(bounds)).tolist():
                            part = order[bounds[k] : bounds[k + 1]]
                            yield (kind - 1) * buckets + k, r["segment"], r["role"], kind, keys[part].tobytes(), packed(counts[part])

        yield from batches(sent_schema, rows(), 64)

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
        counts = np.concatenate([np.frombuffer(r["counts"], "<i4" if len(r["counts"]) == 4 * len(k) else "<i8") for r, k in zip(rows, keys, strict=True)])
        sizes = [len(k) for k in keys]
        roles = np.repeat([r["role"] for r in rows], sizes)
        different, which = np.unique(np.concatenate(keys), return_inverse=True)
        seen = np.bincount(which, counts * (roles != HELD_OUT), minlength=len(different)).astype(np.int64)
        retained = np.bincount(which, counts * (roles == RETAINED), minlength=len(different)).astype(np.int64)
        parts = np.split(which, np.cumsum(sizes)[:-1])
        bucket = rows[0]["bucket"] % buckets
        out = [(r["segment"], r["role"], r["kind"], bucket, packed(seen[p]), packed(retained[p]), int(seen.sum()) if i == 0 else 0, int((seen > 0).sum()) if i == 0 else 0) for i, (r, p) in enumerate(zip(rows, parts, strict=True))]
        return pa.Table.from_batches(batches(answer_schema, iter(out)), schema=answer_schema)

    return stored(segments.mapInArrow(send, SENT).groupBy("bucket").applyInArrow(count, ANSWERS), "counts")


def _answered(own: pa.Table, answers: pa.Table, buckets: int, column: str) -> tuple[dict, _Segment, dict[int, np.ndarray]]:
    r = own.to_pylist()[0]
    segment = _Segment(r["tokens"], r["lens"], r["hashes"])
    got = defaultdict(list)
    for kind, bucket, data in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers[column].to_pylist(), strict=True):
        got[kind].append((bucket, data))
    return r, segment, {kind: gathered(got[kind], *spread(segment.keys(kind)[0], buckets)) for kind in (1, 2)}


def context_bucket(n: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + the power of two that n reaches."""
    return np.where(n > 0, 1 + np.floor(np.log2(np.maximum(n, 1))), 0).astype(np.int64)


def _context_counts(segment: _Segment, words: np.ndarray) -> np.ndarray:
    """Each token's context count: that of the word before it, at a start the number of texts."""
    return np.where(segment.before == 0, words[1], words[segment.before])


def learn_weights(triples: DataFrame, total: int, different: int, rounds: int = 10) -> dict[int, tuple[float, float, float]]:
    """Weights of (bigram, unigram, uniform) by context bucket from deleted tokens: (joint, context,
    word) counts of the retained part, n times. Expectation-maximisation; each round is an aggregation."""
    bucket = F.when(F.col("context") > 0, 1 + F.floor(F.log2("context"))).otherwise(0).cast("bigint")
    known = stored(triples.groupBy("joint", "context", "word").agg(F.sum("n").alias("n")).select(
        bucket.alias("bucket"),
        F.when(F.col("context") > 0, F.col("joint") / F.col("context")).otherwise(0.0).alias("p2"),
        (F.col("word") / F.lit(float(max(total, 1)))).alias("p1"),
        "n",
    ), "triples")
    p0, start = 1.0 / (different + 1), (0.5, 0.4, 0.1)
    weights: dict[int, tuple[float, float, float]] = {}
    for _ in range(rounds):
        parts = [F.lit(start[i]) for i in range(3)]
        for b, w in weights.items():
            parts = [F.when(F.col("bucket") == b, w[i]).otherwise(parts[i]) for i in range(3)]
        terms = [parts[0] * F.col("p2"), parts[1] * F.col("p1"), parts[2] * F.lit(p0)]
        whole = terms[0] + terms[1] + terms[2]
        shares = [F.sum(F.col("n") * t / whole).alias(f"s{i}") for i, t in enumerate(terms)]
        for r in known.filter("n > 0").groupBy("bucket").agg(*shares, F.sum("n").alias("n")).collect():
            # One pseudo-token keeps every weight above zero.
            weights[r["bucket"]] = tuple((r[f"s{i}"] + start[i]) / (r["n"] + 1) for i in range(3))
    return weights


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fold: str = "__fold") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `fold` (0 to 9) says what a document is for: 0 is only scored, 1 is the deleted part of the
    training documents, the others are its retained part. Null texts count as empty: one token, the
    end. base_score is the add-0.1 unigram model's, score the interpolated model's log10 probability.
    """
    spark = docs.sparkSession
    ship_code(spark)
    role = F.when(F.col(fold) == 0, HELD_OUT).when(F.col(fold) == 1, DELETED).otherwise(RETAINED)
    segments = _segments(docs.select(F.col(doc_id).cast("bigint"), role.cast("int").alias("role"), F.col(text).cast("binary")))
    buckets = buckets_for(input_bytes(segments))
    answers = _exchange(segments, buckets)
    sums = answers.filter("kind = 1").agg(F.sum("total").alias("n"), F.sum("different").alias("v")).first()
    total, different = sums["n"] or 0, sums["v"] or 0

    triple_schema, score_schema = _schema(TRIPLES), _schema(SCORES)

    def deleted(own: pa.Table, counts: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.Table.from_batches([], schema=triple_schema)
        _, segment, got = _answered(own, counts, buckets, "retained")
        rows = np.stack([got[2][segment.pair_of], _context_counts(segment, got[1]), got[1][segment.tokens]], axis=1)
        rows, n = np.unique(rows, axis=0, return_counts=True)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (*rows.T, n)], schema=triple_schema)

    training = segments.filter(F.col("role") == DELETED).groupBy("segment").cogroup(answers.filter(F.col("role") == DELETED).select("segment", "kind", "bucket", "retained").groupBy("segment"))
    retained_total = segments.filter(F.col("role") == RETAINED).agg(F.sum(F.octet_length("tokens") / 4)).first()[0]
    weights = learn_weights(training.applyInArrow(deleted, TRIPLES), int(retained_total or 0), different)
    table = np.array([weights.get(b, weights.get(b - 1, (0.5, 0.4, 0.1))) for b in range(66)])
    table[0, 0] = 0.0
    table[0] /= table[0].sum()

    def scored(own: pa.Table, counts: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.Table.from_batches([], schema=score_schema)
        r, segment, got = _answered(own, counts, buckets, "seen")
        word = got[1][segment.tokens]
        base = np.log10((got[1] + 0.1) / (total + 0.1 * (different + 1)))[segment.tokens]
        context = _context_counts(segment, got[1])
        mix = table[context_bucket(context)]
        p = mix[:, 0] * got[2][segment.pair_of] / np.maximum(context, 1) + mix[:, 1] * word / max(total, 1) + mix[:, 2] / (different + 1)
        first = np.cumsum(segment.lens) - segment.lens
        n = len(segment.lens)
        columns = [r["doc_ids"], [r["role"] == HELD_OUT] * n, segment.lens, np.add.reduceat((word > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, score_schema, strict=True)], schema=score_schema)

    every = segments.groupBy("segment").cogroup(answers.select("segment", "kind", "bucket", "seen").groupBy("segment"))
    return every.applyInArrow(scored, SCORES).withColumn("train_tokens", F.lit(total).cast("bigint"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under the model learned from the training folds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs.withColumn("__fold", fold_of(F.col("doc_id"), 10)))
