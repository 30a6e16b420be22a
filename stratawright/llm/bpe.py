"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 6).

Method: contiguous rank array. A pre-token of ``n`` bytes is held as a list of part boundaries and a list with the
rank of every adjacent pair of parts. The smallest rank is searched by a scan, its boundary is deleted, and the ranks of
the two neighbouring pairs are looked up anew, until no pair has a rank. Long pre-tokens, for which repeated scans would
cost the square of their length, go through a heap over linked parts with the same choice (lowest rank, then leftmost).

Defined cases: a null, an empty and a missing text give an empty list; special-token strings are ordinary text; equal texts
give equal ids; further columns of the input are ignored. A text is always encoded whole.
"""

from __future__ import annotations

import base64
import heapq
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratawright.session import spread

VOCABULARY = "byte_bpe_50k.tiktoken"
NO_RANK = 1 << 40
#: Pre-tokens of more bytes take the heap.
SHORT = 192
#: Encoded pre-tokens kept per Python worker.
CACHED = 300_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a vocabulary file in the installed set of public tokenizers."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBPE:
    """Encoder over a file of ``base64(token) rank`` lines. ``pattern`` splits a text into pre-tokens."""

    def __init__(self, path: str, pattern: str | None = None):
        import regex

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, array] = {}

    def word(self, data: bytes) -> array:
        """Ids of one pre-token."""
        if (rank := self.ranks.get(data)) is not None:
            return array("i", (rank,))
        bounds = self._scan(data) if len(data) <= SHORT else self._heap(data)
        return array("i", (self.ranks[data[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)))

    def _scan(self, data: bytes) -> list[int]:
        get = self.ranks.get
        bounds = list(range(len(data) + 1))
        near = [get(data[i : i + 2], NO_RANK) for i in range(len(data) - 1)]
        while near and (low := min(near)) != NO_RANK:
            at = near.index(low)
            del bounds[at + 1], near[at]
            if at < len(near):
                near[at] = get(data[bounds[at] : bounds[at + 2]], NO_RANK)
            if at:
                near[at - 1] = get(data[bounds[at - 1] : bounds[at + 1]], NO_RANK)
        return bounds

    def _heap(self, data: bytes) -> list[int]:
        get, size = self.ranks.get, len(data)
        after, before = list(range(1, size + 2)), list(range(-1, size + 1))
        alive = bytearray(b"\1") * (size + 1)

        def rank(at: int) -> int:
            middle = after[at]
            return get(data[at : after[middle]], NO_RANK) if middle < size else NO_RANK

        heap = [(r, i) for i in range(size - 1) if (r := rank(i)) != NO_RANK]
        heapq.heapify(heap)
        while heap:
            low, at = heapq.heappop(heap)
            if not alive[at] or rank(at) != low:
                continue
            gone = after[at]
            alive[gone] = 0
            after[at] = after[gone]
            before[after[gone]] = at
            for place in (at, before[at]):
                if place >= 0 and (r := rank(place)) != NO_RANK:
                    heapq.heappush(heap, (r, place))
        bounds, at = [], 0
        while at < size:
            bounds.append(at)
            at = after[at]
        return [*bounds, size]

    def encode(self, text: str | None) -> array:
        out = array("i")
        if text:
            cache = self.cache
            for piece in self.split(text):
                if (ids := cache.get(piece)) is None:
                    ids = self.word(piece.encode("utf-8", "surrogatepass"))
                    if len(piece) <= 64:
                        if len(cache) >= CACHED:
                            cache.clear()
                        cache[piece] = ids
                out.extend(ids)
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> ByteBPE:
    """One encoder per Python worker and file."""
    return ByteBPE(path)


def encode_column(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id_col`` and ``ids`` (ARRAY<INT>) of every row of ``df``."""
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            flat, ends = array("i"), [0]
            for text in batch.column(1).to_pylist():
                flat.extend(bpe.encode(text))
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, "int32") if flat else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["key", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = spread(df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", id_col)


def token_sizes(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id_col`` and ``size``, the number of tokens; the ids stay in the Python worker."""
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            sizes = pa.array([len(bpe.encode(text)) for text in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], ["key", "size"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = spread(df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")))
    return rows.mapInArrow(run, f"key {kind}, size bigint").withColumnRenamed("key", id_col)
