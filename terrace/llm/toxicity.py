"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of code points (LENGTHS) that occur in a text, hashed to 2**BITS places.
Each is scaled by its log-count ratio between toxic and other training texts, and a logistic
regression learns one weight for each scaled feature; cross-validation chooses how many there are and
calibrates the score. Training runs in numpy on the driver over the features of a bounded sample of
labelled texts, found on the executors; the finished table of weight times ratio scores whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.shared import fold_of, read, ship_code

LENGTHS, BITS = (3, 4, 5), 20
#: Numbers of n-grams that cross-validation chooses from.
FEATURES = (500, 1000, 2000, 4000)
_BASE, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)


@dataclass
class Scorer:
    """weights of the hashed features (2**BITS, float32; 0 for those unused) and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities of label 1; each feature counts once a text."""
        out = np.full(len(texts), self.bias)
        for part in _parts(texts):
            owner, places = _grams([texts[i] for i in part])
            used = np.flatnonzero(self.weights.take(places))
            once = np.unique(owner[used].astype(np.int64) << BITS | places[used])
            out[part] += np.bincount(once >> BITS, self.weights[once & ((1 << BITS) - 1)], minlength=len(part))
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def _parts(texts: list[str | None], most: int = 1 << 18) -> Iterator[list[int]]:
    """Numbers of the texts, in runs of about `most` characters."""
    run, held = [], 0
    for i, t in enumerate(texts):
        run.append(i)
        held += len(t or "") + 2
        if held >= most:
            yield run
            run, held = [], 0
    if run:
        yield run


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, hashed place) of each n-gram of the lower-cased texts, a space at both ends."""
    padded = [f" {(t or '').lower()} " for t in texts]
    x = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.array([len(p) for p in padded])
    owner, ends = np.repeat(np.arange(len(texts), dtype=np.int32), lens), np.repeat(np.cumsum(lens), lens)
    left = ends - np.arange(len(x))
    owners, places, h = [], [], x.copy()
    for n in range(2, max(LENGTHS) + 1):
        h = h[:-1] * _BASE ^ x[n - 1 :]
        if n in LENGTHS:
            fits = left[: len(h)] >= n
            mixed = (h ^ h >> np.uint32(15)) * (_MIX + np.uint32(2 * n))
            owners.append(owner[: len(h)][fits])
            places.append((mixed >> np.uint32(32 - BITS))[fits])
    return np.concatenate(owners), np.concatenate(places).astype(np.int64)


def sample(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> list[tuple[int, np.ndarray]]:
    """(toxic, places of the whole text's n-grams, each once, in order) of at most per_class labelled
    texts of either class.

    Labels are those of ids in `labels`, a text of several rows and labels counts once a label; null
    ids have no label. Of each class the texts with the smallest hashes of id and text are taken, in
    that order, so the choice depends neither on partitions nor on how often a row or an id repeats.
    A text of any length brings at most 2**BITS places to the driver.
    """
    known = labels.filter("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__toxic")).distinct()
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("__hash", F.xxhash64(F.lit(11), "doc_id", "t"))
    # Chosen by id and hash alone, so that no text is shuffled; the limit is kept on the map side.
    marked = hashed.select("doc_id", "__hash").join(known, F.col("doc_id") == F.col("__id")).select("__toxic", "__hash").distinct()
    chosen = [marked.filter(F.col("__toxic") == c).orderBy("__hash").limit(per_class) for c in (0, 1)]
    # At most 2 * per_class rows are broadcast.
    taken = hashed.join(F.broadcast(chosen[0].unionByName(chosen[1])), "__hash").select("__toxic", "__hash", "t")
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                places = [_distinct(t).astype("<i4").tobytes() for t in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), batch.column(1), pa.array(places, pa.binary())], names=["toxic", "hash", "places"])

    # Repeated rows are equal in all three columns: one of them comes to the driver.
    once = taken.mapInArrow(run, "toxic int, hash bigint, places binary").groupBy("toxic", "hash").agg(F.any_value("places").alias("places"))
    rows = sorted((r[0], r[1], bytes(r[2])) for r in once.toLocalIterator())
    return [(toxic, np.frombuffer(places, "<i4")) for toxic, _, places in rows]


def _distinct(text: str) -> np.ndarray:
    return np.unique(_grams([text])[1])


def train(labelled: list[tuple[int, np.ndarray]], choices: tuple[int, ...] = FEATURES, folds: int = 4, alpha: float = 1.0) -> Scorer:
    """Fits the classifier; classes weigh alike. With one class, or none, the score is the smoothed share
    of label 1, 1 - 1 / (n + 2) or the like.

    How many of the n-grams with the strongest evidence are used is chosen by cross-validation inside
    the training texts: long texts hold so many n-grams that rare ones drown the few that matter.
    The same held-out margins calibrate the score: a slope and an offset make it a probability under
    classes of equal weight.
    """
    y = np.array([t for t, _ in labelled], bool)
    if not len(y) or y.all() or not y.any():
        share = (y.sum() + 1) / (len(y) + 2)
        return Scorer(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    fold = np.zeros(len(y), np.int64)
    for c in (False, True):  # every fold has its share of either class
        fold[y == c] = np.arange((y == c).sum()) % folds
    best = (np.inf, choices[0], 1.0, 0.0)
    if min(y.sum(), (~y).sum()) >= folds:
        margins = np.zeros((len(choices), len(y)))
        for f in range(folds):
            for n, (weights, bias) in enumerate(_fits([x for x, held in zip(labelled, fold == f, strict=True) if not held], choices, alpha)):
                for i in np.flatnonzero(fold == f):
                    margins[n, i] = bias + weights[labelled[i][1]].sum()
        for features, margin in zip(choices, margins, strict=True):
            slope, offset, loss = _calibrated(margin, y)
            if loss < best[0]:
                best = loss, features, slope, offset
    _, features, slope, offset = best
    ((weights, bias),) = _fits(labelled, (features,), alpha)
    return Scorer((slope * weights).astype(np.float32), float(slope * bias + offset))


def _calibrated(margins: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float, float]:
    """(slope, offset, loss) of the logistic curve through margins, by Newton's method; classes weigh alike."""
    importance = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    x, at = np.stack([margins, np.ones(len(y))], axis=1), np.zeros(2)
    curve = lambda at: 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
    for _ in range(rounds):
        p = curve(at)
        gradient = x.T @ ((p - y) * importance) + 1e-4 * at
        step = np.linalg.solve((x.T * (p * (1 - p) * importance)) @ x + 1e-4 * np.eye(2), gradient)
        at = at - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(curve(at), 1e-12, 1 - 1e-12)
    if at[0] <= 0:  # margins that say nothing
        return 1.0, 0.0, np.inf
    return float(at[0]), float(at[1]), float(-(importance * np.where(y, np.log(p), np.log(1 - p))).sum())


def _fits(labelled: list[tuple[int, np.ndarray]], choices: tuple[int, ...], alpha: float) -> Iterator[tuple[np.ndarray, float]]:
    """(weights, bias) for each number of n-grams to use, from texts of both classes. Of the hashed n-grams
    that at least three texts have, those with the strongest evidence are used."""
    y = np.array([t for t, _ in labelled], bool)
    positive, total = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for toxic, places in labelled:  # places of a text differ, so each counts once
        total[places] += 1
        if toxic:
            positive[places] += 1
    p, q = positive / y.sum(), (total - positive) / (~y).sum()
    ratio = np.log((positive + alpha) / (y.sum() + alpha)) - np.log((total - positive + alpha) / ((~y).sum() + alpha))
    evidence = np.where(total >= 3, np.abs(ratio) * np.sqrt(np.maximum(p, q)), 0)
    ranked = np.argsort(-evidence, kind="stable")[: max(choices)]
    ranked = ranked[evidence[ranked] > 0]
    number = np.full(1 << BITS, -1, np.int64)
    number[ranked] = np.arange(len(ranked))
    kept = [(number[places])[number[places] >= 0] for _, places in labelled]
    rows, cols = np.repeat(np.arange(len(labelled)), [len(k) for k in kept]), np.concatenate(kept)
    for features in choices:
        few = cols < features
        weights = np.zeros(1 << BITS, np.float32)
        used = ranked[:features]
        w, bias = _logistic(y, rows[few], cols[few], ratio[used])
        weights[used] = w * ratio[used]
        yield weights, bias


def _logistic(y: np.ndarray, rows: np.ndarray, cols: np.ndarray, r: np.ndarray, rounds: int = 200, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic regression on the scaled features, by accelerated gradients; classes weigh alike."""
    x = r[cols]
    importance = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    w, bias, speed, bias_speed = np.zeros(len(r)), 0.0, np.zeros(len(r)), 0.0
    # A quarter of the largest eigenvalue of the weighted design bounds the curvature.
    v, largest = np.ones(len(r) + 1), 1.0
    for _ in range(12):
        v /= np.linalg.norm(v)
        z = (np.bincount(rows, x * v[cols], minlength=len(y)) + v[-1]) * importance
        v = np.append(np.bincount(cols, x * z[rows], minlength=len(r)), z.sum())
        largest = np.linalg.norm(v)
    step = 1 / (1.1 * largest / 4 + l2)
    for k in range(rounds):
        ahead, bias_ahead = w + speed, bias + bias_speed
        z = np.bincount(rows, x * ahead[cols], minlength=len(y)) + bias_ahead
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * importance
        gradient = np.bincount(cols, x * error[rows], minlength=len(r)) + l2 * ahead / max(len(r), 1)
        momentum = (k + 1) / (k + 4)
        new, new_bias = ahead - step * gradient, bias_ahead - step * error.sum()
        speed, bias_speed = momentum * (new - w), momentum * (new_bias - bias)
        w, bias = new, new_bias
    return w, float(bias)


def predict(docs: DataFrame, scorer: Scorer, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from the threshold on).

    Null texts count as empty and are scored too. Other columns stay; columns named score or
    predicted are replaced. No row leaves its partition.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*kept, F.lit(0.0).alias("score")).schema
    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                scores = shared.value.score(batch.column(batch.schema.get_field_index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return docs.select(*kept).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def trained_on(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> Scorer:
    """The classifier learned from the labels whose fold, crc32 of the id modulo 3, is not 1."""
    return train(sample(docs.select("doc_id", "text"), labels.filter(fold_of(F.col("doc_id"), 3) != 1), per_class))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, by a classifier fitted on the labels of the training folds alone."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    judged = predict(docs, trained_on(docs, read(spark, sf_dir, "labels")))
    return judged.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
