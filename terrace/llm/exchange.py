"""Counting keys across segments of a corpus.

A segment (a few MB of whole documents) knows its distinct 64-bit keys. They are dealt by hash into
buckets and sent packed, one row for each segment and bucket instead of one for each key; a bucket
sums up what all segments sent and answers each in the order it sent. A key reaches its bucket once
a segment however often it occurs there, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

#: Bytes of input for each bucket.
BUCKET_BYTES = 4 << 20


def buckets_for(input_bytes: int) -> int:
    return max(4, -(-input_bytes // BUCKET_BYTES))


def spread(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which keys are dealt, and where in it each bucket begins and ends."""
    b = (keys % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(b, kind="stable")
    return order, np.searchsorted(b[order], np.arange(buckets + 1))


def hashes_of(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)


def mixed(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit hash of several in this order."""
    h = np.uint64(0x9E3779B97F4A7C15) * np.ones(1, np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ h >> np.uint64(32)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(29)


def packed(values: np.ndarray) -> bytes:
    """Counts as little-endian integers of 4 bytes, or of 8 where they need them."""
    return values.astype("<i4" if not len(values) or values.max() < 1 << 31 else "<i8").tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<i4" if len(data) == 4 * n else "<i8").astype(np.int64)


def squeezed(numbers: np.ndarray) -> bytes:
    """Small non-negative numbers by byte planes, compressed: what a segment keeps of its tokens."""
    planes = numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(-1)


def gathered(answers: list[tuple[int, bytes]], order: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Answers by bucket, put back into the order of the segment's keys."""
    out = np.zeros(len(order), np.int64)
    for bucket, data in answers:
        part = order[bounds[bucket] : bounds[bucket + 1]]
        out[part] = unpacked(data, len(part))
    return out


def batch(schema: pa.Schema, *columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def batches(schema: pa.Schema, rows: Iterator[tuple], most: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield batch(schema, *zip(*held, strict=True))
            held = []
    if held:
        yield batch(schema, *zip(*held, strict=True))
