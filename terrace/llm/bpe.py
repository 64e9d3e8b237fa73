"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can be the last of its encoding: the
token that ends there, follows the prefix before it, and does not pair with that prefix's last
token in a merge that BPE would have preferred. One table entry per byte therefore holds the
encoding of all prefixes. Appending bytes only extends the table; an edit re-encodes the pieces
near it until the old piece boundaries are met again.

The vocabulary is a public rank file whose path is a parameter; nothing is trained here.
"""

from __future__ import annotations

import base64
import functools
import gc
import re
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.shared import give_back, read, ship_code

#: Bytes, about, of the encodings that a worker remembers, and seams it remembers; beyond either that
#: memory starts anew, results stay.
CACHE_BYTES = 128 << 20
CACHE_SEAMS = 400_000
#: Steps of the search for tokens that a worker remembers.
CACHE_STEPS = 100_000
SLICE_ROWS = 128


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Vocabulary:
    """Ranks of a byte-level BPE, with each token's last merge undone."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self._agrees: dict[int, bool] = {}
        for i in sorted(self.token):
            t = self.token[i]
            if len(t) > 1:
                # With lower ranks alone, BPE leaves exactly the two tokens that this one joins.
                two = self._last_merge(t, i)
                if two:
                    self.halves[i] = two
                    self.merged[two] = i

        #: Tokens by their bytes, as latin-1; it also tells what is the beginning of a token.
        self.finder = ahocorasick.Automaton()
        for t, i in ranks.items():
            if len(t) == 1 or i in self.halves:
                self.finder.add_word(t.decode("latin-1"), (len(t), i))
        self._start_anew()

    def _start_anew(self) -> None:
        #: Behind each byte a state: the longest end of what was read that begins a token. A step, by state
        #: and byte, gives the next state and the tokens that end there, from the longest to the shortest.
        self._ends: list[str] = [""]
        self._states: dict[str, int] = {"": 0}
        self._steps: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}

    def _step(self, state: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        end = self._ends[state] + chr(byte)
        while end and not self.finder.match(end):
            end = end[1:]
        if end not in self._states:
            self._states[end] = len(self._ends)
            self._ends.append(end)
        found = (self.finder.get(end[k:], None) for k in range(len(end)))
        got = self._steps[state << 8 | byte] = self._states[end], tuple(x for x in found if x)
        return got

    def _last_merge(self, t: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that BPE joins last to make t, by plain merging below its rank."""
        parts = [t[k : k + 1] for k in range(len(t))]
        while len(parts) > 2:
            best = min(((r, k) for k in range(len(parts) - 1) if (r := self.ranks.get(parts[k] + parts[k + 1], rank)) < rank), default=None)
            if best is None:
                return None
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def agrees(self, left: int, right: int) -> bool:
        """Whether BPE leaves `left` and `right` as they are when they stand side by side.

        Merges are undone at the seam from the latest to the earliest; at each moment no merge
        across the seam may have come before the one just undone.
        """
        key = left << 32 | right
        known = self._agrees.get(key)
        if known is None:
            if len(self._agrees) >= CACHE_SEAMS:
                self._agrees.clear()
            known = self._agrees[key] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        before = None  # the merge undone last: (rank, 0 for the left side, 1 for the right)
        while True:
            across = self.merged.get((left, right))
            if across is not None and (before is None or across < before[0] or across == before[0] and before[1] == 1):
                return False
            lh, rh = self.halves.get(left), self.halves.get(right)
            if lh is None and rh is None:
                return True
            # Of two equal merges the left one is made first, so the right one is undone first.
            if rh is None or lh is not None and left > right:
                before, left = (left, 0), lh[1]
            else:
                before, right = (right, 1), rh[0]

    def extend(self, piece: bytes, last: list[int], start: list[int]) -> None:
        """Continues the prefix table of a piece: last[k] is the last token of piece[: k + 1],
        start[k] where that token begins."""
        if len(self._steps) >= CACHE_STEPS:
            self._start_anew()
        seam, agrees, step, done, state = self._agrees.get, self.agrees, self._steps.get, len(last), 0
        for at, byte in enumerate(piece):
            state, ends = step(state << 8 | byte) or self._step(state, byte)
            if at < done:
                continue
            for length, t in ends:
                begin = at + 1 - length
                if begin:
                    left = last[begin - 1]
                    fits = seam(left << 32 | t)
                    if not (agrees(left, t) if fits is None else fits):
                        continue
                last.append(t)
                start.append(begin)
                break
            else:
                raise ValueError(f"no token ends at byte {at} of {piece!r}")

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        last: list[int] = []
        start: list[int] = []
        self.extend(piece, last, start)
        return read_back(last, start)


def read_back(last: list[int], start: list[int]) -> tuple[int, ...]:
    """The encoding of the whole from a prefix table."""
    out, end = [], len(last)
    while end:
        out.append(last[end - 1])
        end = start[end - 1]
    return tuple(reversed(out))


class Memory(dict):
    """Encodings of chunks seen lately. A new chunk is cut into the pattern's pieces, each encoded by its
    prefix table. Pieces are remembered too, so that a word is encoded once, whatever stands behind it: one
    that begins with `before` here, as the chunk that it would be alone, others in `others`."""

    def __init__(self, find: Callable[[str], list[str]], encode_piece: Callable[[bytes], tuple[int, ...]], before: str, others: Memory | None = None) -> None:
        self.find, self.encode_piece, self.before, self.held = find, encode_piece, before, 0
        self.others = self if others is None else others

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        pieces = self.find(self.before + chunk)
        got = self.encode_piece(pieces[0].encode()) if len(pieces) == 1 else tuple(chain.from_iterable(map(self.piece, pieces)))
        return self.keep(chunk, got)

    def piece(self, piece: str) -> tuple[int, ...]:
        """The encoding of one of the pattern's pieces; it is not cut again."""
        if not piece.startswith(self.before):
            return self.others.piece(piece)
        chunk = piece[len(self.before) :]
        got = self.get(chunk)
        return self.keep(chunk, self.encode_piece(piece.encode())) if got is None else got

    def keep(self, chunk: str, got: tuple[int, ...]) -> tuple[int, ...]:
        if len(chunk) <= 256:
            self.held += 200 + len(chunk) * (1 if chunk.isascii() else 4) + 8 * len(got)
            if self.held > CACHE_BYTES:
                self.clear()
                self.held = 0
            self[chunk] = got
        return got


#: A space at which a chunk may begin: none stands before it, of any kind of white space.
_SPACE, _ODD = re.compile(r"(?<!\s) "), re.compile(r"\s ")


class Encoder:
    """Encodes whole texts. With `apart`, texts are first cut into chunks before every space that no white
    space precedes; that is right for patterns whose pieces hold a space at their beginning only, or
    behind other white space, and that look at nothing before a piece. A chunk's pieces are then those
    it has in the text, and the chunk's encoding can be remembered as a whole."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, apart: bool) -> None:
        find = regex.compile(pattern).findall
        self.first, self.apart = Memory(find, vocabulary.encode_piece, ""), apart
        self.later = Memory(find, vocabulary.encode_piece, " ", self.first)
        self.find, self.pieces = find, Memory(lambda piece: [piece], vocabulary.encode_piece, "")

    def packed(self, text: str) -> bytes:
        if not self.apart:
            ids = map(self.pieces.__getitem__, self.find(text))
        else:
            chunks = _SPACE.split(text) if _ODD.search(text) else text.split(" ")
            ids = chain((self.first[chunks[0]],), map(self.later.__getitem__, chunks[1:]))
        return np.fromiter(chain.from_iterable(ids), "<u4").tobytes()


class Encoded:
    """A text with the encoding of its pieces, open to exact appends and edits."""

    #: Characters behind a boundary that the pattern may have looked at.
    LOOK = 3

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = "") -> None:
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.text, self.pieces = "", []  # (start, end, ids)
        self.edit(0, 0, text)

    @property
    def ids(self) -> list[int]:
        return [i for piece in self.pieces for i in piece[2]]

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces text[start:end] and re-encodes from just before it until old boundaries return."""
        text, shift = self.text[:start] + new + self.text[end:], len(new) - (end - start)
        keep = [p for p in self.pieces if p[1] <= start - self.LOOK]
        at = keep[-1][1] if keep else 0
        later = {p[0] + shift: k for k, p in enumerate(self.pieces) if p[0] >= end}
        for m in self.pattern.finditer(text, at):
            if m.start() in later:
                keep += [(a + shift, b + shift, ids) for a, b, ids in self.pieces[later[m.start()] :]]
                break
            keep.append((m.start(), m.end(), self.vocabulary.encode_piece(m[0].encode())))
        self.text, self.pieces = text, keep


@functools.lru_cache(maxsize=1)
def _vocabulary(data: bytes) -> Vocabulary:
    return Vocabulary(load_ranks(data))


@functools.lru_cache(maxsize=1)
def _encoder(data: bytes, pattern: str, apart: bool) -> Encoder:
    """A worker's encoder, which keeps what it remembers from task to task. The vocabulary stays as long as the
    worker, so it is taken out of the search for garbage, which is a quarter of the time otherwise."""
    encoder = Encoder(_vocabulary(data), pattern, apart)
    gc.freeze()
    return encoder


@functools.lru_cache(maxsize=1)
def _tokens(data: bytes) -> list[bytes | None]:
    """Bytes by id: all that decoding needs."""
    ranks = load_ranks(data)
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table


def _decoded(table: list[bytes | None], ids: bytes | None) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def _shipped(spark: SparkSession, path: str) -> Broadcast:
    """The rank file's bytes on every executor; their number is that of the vocabulary's tokens."""
    ship_code(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _added(docs: DataFrame, columns: tuple[str, ...], made: Callable[[], Callable[[pa.RecordBatch], list[list[bytes]]]]) -> DataFrame:
    """docs with binary columns behind the others; made gives, on the executor, what makes them of a batch."""
    schema = docs.select("*", *[F.lit(b"").alias(c) for c in columns]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = made()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.binary()) for c in make(batch)]], names=[*batch.schema.names, *columns])
        give_back()

    return docs.mapInArrow(run, schema)


def _values(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", apart: bool = False, decoded: str | None = None) -> DataFrame:
    """Adds `out`: the ids of the whole text as little-endian unsigned 32-bit integers, packed.

    Null counts as the empty text and gives no ids. All other columns stay; `out` takes the place
    of a column of that name. Special tokens are ordinary text. No row leaves its partition.
    `apart` may be set for patterns as Encoder says. With `decoded`, a column of that name gets the
    bytes that decoding the ids gives, in the same pass over the texts.
    """
    added = (out, decoded) if decoded else (out,)
    kept = [c for c in docs.columns if c not in (text, *added)]
    ranks = _shipped(docs.sparkSession, path)

    def made() -> Callable[[pa.RecordBatch], list[list[bytes]]]:
        encoder = _encoder(ranks.value, pattern, apart)
        table = _tokens(ranks.value) if decoded else []

        def make(batch: pa.RecordBatch) -> list[list[bytes]]:
            ids = [encoder.packed(t or "") for t in _values(batch, text)]
            return [ids, [_decoded(table, x) for x in ids]] if decoded else [ids]

        return make

    return _added(docs.select(*kept, F.col(text)), added, made)


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds `out`: the bytes that the packed ids stand for. Null ids give no bytes. Other columns stay;
    `out` takes the place of a column of that name."""
    ranks = _shipped(encoded.sparkSession, path)
    kept = [c for c in encoded.columns if c != out]

    def made() -> Callable[[pa.RecordBatch], list[list[bytes]]]:
        table = _tokens(ranks.value)
        return lambda batch: [[_decoded(table, x) for x in _values(batch, ids)]]

    return _added(encoded.select(*kept), (out,), made)


def op8(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Per row of documents: doc_id, n_tokens and the digests of the ids and of what they decode to."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    # The pattern's pieces hold a space at their beginning, or in a run of white space.
    both = encode(docs, path, public_tokenizers.PATTERN, apart=True, decoded="decoded")
    return both.select(
        "doc_id",
        F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
