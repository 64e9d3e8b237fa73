"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over a window of fixed length, the largest
response of each filter feeds a softmax. Training runs in numpy on the driver over a bounded
sample of labelled text. For prediction the embedding and the filters are folded into tables by
byte pairs (the same sums in another order), and every window of every text is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.llm.shared import fold_of, read, ship_code

WINDOW, BATCH = 128, 1024
WIDTHS = (2, 3, 4)
UNDETERMINED = "und"


@dataclass
class ByteNet:
    """langs, embedding (256, D), filters by width (width, D, K), their biases, softmax layer."""

    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.biases, self.out, self.out_bias]

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of each filter, and where it is; windows: (n, WINDOW) bytes."""
        x, tops, places = self.embed[windows], [], []
        for w, b in zip(self.filters, self.biases, strict=True):
            span = x.shape[1] - len(w) + 1
            z = sum(x[:, j : j + span] @ w[j] for j in range(len(w)))
            at = z.argmax(axis=1)
            places.append(at)
            tops.append(np.take_along_axis(z, at[:, None], axis=1)[:, 0] + b)
        return np.maximum(np.concatenate(tops, axis=1), 0), places

    def folded(self) -> Folded:
        t = [np.einsum("bd,jdk->jbk", self.embed, w).astype(np.float32) for w in self.filters]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        return Folded(self.langs, pair(t[0][0], t[0][1]), pair(t[1][0], t[1][1]), t[1][2], pair(t[2][0], t[2][1]), pair(t[2][2], t[2][3]), np.concatenate(self.biases), self.out, self.out_bias)


@dataclass
class Folded:
    """The network as sums of table rows: width 2 is one look-up, 3 a pair and a byte, 4 two pairs."""

    langs: list[str]
    two: np.ndarray
    three: np.ndarray
    third: np.ndarray
    four: np.ndarray
    later: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        found = []
        for a in range(0, len(windows), BATCH):
            w = windows[a : a + BATCH]
            pairs = (w[:, :-1].astype(np.int32) << 8) | w[:, 1:]
            z2 = self.two.take(pairs, axis=0).max(axis=1)
            z3 = self.three.take(pairs[:, :-1], axis=0)
            z3 += self.third.take(w[:, 2:], axis=0)
            z4 = self.four.take(pairs[:, :-2], axis=0)
            z4 += self.later.take(pairs[:, 2:], axis=0)
            top = np.maximum(np.concatenate([z2, z3.max(axis=1), z4.max(axis=1)], axis=1) + self.bias, 0)
            found.append(_softmax(top @ self.out + self.out_bias))
        return np.concatenate(found) if found else np.zeros((0, len(self.langs)))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(texts: list[bytes], length: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts in order, (n, length) with zero bytes behind a text's end; their
    text's number, and how many bytes of it they hold."""
    counts = np.array([-(-len(t) // length) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(t.ljust(c * length, b"\0") for t, c in zip(texts, counts.tolist(), strict=True)), np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    held = np.minimum(np.array([len(t) for t in texts], np.int64)[owner] - k * length, length)
    return flat.reshape(-1, length), owner, held


def sample(docs: DataFrame, per_lang: int = 1500, pieces: int = 2) -> list[tuple[str, str]]:
    """(lang, piece of text) for training: of each language the at most per_lang different documents with
    the smallest hashes of id and text, and up to `pieces` pieces of WINDOW characters of each, spread
    over its text. Rows without an id count like others; a repeated row counts once, so the choice
    depends neither on partitions nor on how often a row or an id repeats."""
    labelled = docs.filter("lang is not null and text is not null and length(text) > 0").withColumn("__hash", F.xxhash64(F.lit(7), "doc_id", "text"))
    # Hashes far beyond the smallest per_lang are left out before any shuffle; twice as many stay as are wanted.
    share = {r["lang"]: min(1.0, 2 * per_lang / max(r["n"], 1)) for r in labelled.groupBy("lang").agg(F.approx_count_distinct("__hash").alias("n")).collect()}
    if not share:
        return []
    limit = F.create_map(*[x for k, v in sorted(share.items()) for x in (F.lit(k), F.lit(int(v * (1 << 30))))])[F.col("lang")]
    near = labelled.filter(F.pmod("__hash", F.lit(1 << 30)) < limit)
    at = [F.substring(F.col("text"), F.pmod(F.xxhash64(F.lit(k), "__hash"), F.greatest(F.length("text") - WINDOW, F.lit(1))).cast("int") + 1, F.lit(WINDOW)) for k in range(pieces)]
    once = near.select("lang", "__hash", F.array(*at).alias("at")).groupBy("lang", "__hash").agg(F.any_value("at").alias("at"))
    first = Window.partitionBy("lang").orderBy(F.pmod("__hash", F.lit(1 << 30)), "__hash")
    chosen = once.withColumn("__rank", F.row_number().over(first)).filter(F.col("__rank") <= per_lang)
    return sorted((r["lang"], p) for r in chosen.select("lang", "at").collect() for p in r["at"])


def train(labelled: list[tuple[str, str]], dim: int = 8, kinds: int = 16, epochs: int = 6, rate: float = 0.01, seed: int = 1) -> ByteNet:
    """Fits the network by Adam on cross-entropy. The same sample gives the same network; one
    language is learned as such, none gives a network without languages."""
    langs = sorted({k for k, _ in labelled})
    rng = np.random.default_rng(seed)
    net = ByteNet(langs, rng.normal(0, 0.3, (256, dim)), [rng.normal(0, (w * dim) ** -0.5, (w, dim, kinds)) for w in WIDTHS], [np.zeros(kinds) for _ in WIDTHS], rng.normal(0, 0.1, (kinds * len(WIDTHS), max(1, len(langs)))), np.zeros(max(1, len(langs))))
    for name in ("embed", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float32))
    net.filters, net.biases = [w.astype(np.float32) for w in net.filters], [b.astype(np.float32) for b in net.biases]
    if len(langs) < 2:
        return net
    x = np.stack([np.frombuffer(t.encode()[:WINDOW].ljust(WINDOW, b"\0"), np.uint8) for _, t in labelled])
    number = {k: i for i, k in enumerate(langs)}
    y = np.array([number[k] for k, _ in labelled])
    weight = (len(y) / len(langs) / np.bincount(y, minlength=len(langs)))[y]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            step += 1
            for p, g, (m, v) in zip(net.parameters(), _gradients(net, x[rows], y[rows], weight[rows]), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: ByteNet, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    top, places = net.pooled(x)
    d = _softmax(top @ net.out + net.out_bias)
    d[np.arange(len(y)), y] -= 1
    d *= (weight / len(y))[:, None].astype(d.dtype)
    back = (d @ net.out.T) * (top > 0)
    d_embed, d_filters, d_biases, k = np.zeros_like(net.embed), [], [], back.shape[1] // len(WIDTHS)
    for i, (w, at) in enumerate(zip(net.filters, places, strict=True)):
        g, dw = back[:, i * k : (i + 1) * k], np.zeros_like(w)
        for j in range(len(w)):
            seen = np.take_along_axis(x, at + j, axis=1)  # the byte under each filter's best place
            dw[j] = np.einsum("nk,nkd->dk", g, net.embed[seen])
            np.add.at(d_embed, seen, g[:, :, None] * w[j].T[None])
        d_filters.append(dw)
        d_biases.append(g.sum(axis=0))
    return [d_embed, *d_filters, *d_biases, top.T @ d, d.sum(axis=0)]


def predict(docs: DataFrame, net: ByteNet, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (0 to 1): the mean of the windows' probabilities by their bytes.

    Null texts and texts without a letter are `und` with score 0, as is all where nothing was
    learned. Other columns stay; columns named lang_pred or score are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net.folded())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                judged = [bool(t) and bool(folded.langs) and any(map(str.isalpha, t)) for t in texts]
                windows, owner, held = windows_of([t.encode() if ok else b"" for t, ok in zip(texts, judged, strict=True)])
                p = folded.probabilities(windows) * held[:, None]
                total = np.stack([np.bincount(owner, p[:, c], minlength=len(texts)) for c in range(p.shape[1])], axis=1) if p.shape[1] else np.zeros((len(texts), 1))
                share = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-30)
                best = share.argmax(axis=1)
                langs = [folded.langs[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), judged, strict=True)]
                score = np.where(judged, share[np.arange(len(texts)), best], 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(run, schema)


def trained_on(docs: DataFrame, per_lang: int = 1500) -> ByteNet:
    """The network learned from the documents whose fold, crc32 of the id modulo 4, is not 2."""
    return train(sample(docs.filter(fold_of(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang"), per_lang))


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """docs without those of undetermined language; same columns, whatever their names. Where no
    language could be learned, those without a letter are the undetermined ones."""
    net = trained_on(docs)
    if not net.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    judged = predict(docs.select(F.struct(*docs.columns).alias("__row"), "text"), net)
    return judged.filter(F.col("lang_pred") != UNDETERMINED).select("__row.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a network fitted on the training folds alone."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = predict(docs.select("doc_id", "text"), trained_on(docs))
    return judged.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
