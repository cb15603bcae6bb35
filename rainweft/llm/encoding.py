"""Exact token ids of whole corpora by a public byte-level BPE vocabulary.

A text is cut into content-defined chunks where a rolling hash of the last 16
bytes has enough zero bits, so equal passages in different documents give equal
chunks. A short text is one chunk. A chunk is reused from a cache of each Python worker
whose size is bounded in bytes, and encoded again only once evicted; then every join between two chunks is repaired by
encoding the stretch around it again, widened until the kept tokens of both
sides end and begin exactly at its edges. The result equals encoding the whole
text at once.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rainweft.workspace import require

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"

# The pre-tokenizer pattern of the vocabulary without its
# look-ahead branch, and the white space of that pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
SPACE = "\t-\r \x85\xa0  -     　"

#: A run of white space before a word leaves its last character to that word.
#: Cutting there first lets the pattern do without look-ahead, which halves the time.
_before_last_space = re.compile(f"(?<=[{SPACE}])(?=[{SPACE}][^{SPACE}])").split

_GEAR = np.random.RandomState(20240607).randint(0, 2**32, 256, np.uint64).astype(np.uint32)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_IS_GRAPH = np.zeros(256, bool)
_IS_GRAPH[0x21:0x7F] = True


class ChunkEncoder:
    """Encodes texts chunk by chunk; equal chunks are encoded once as long as the cache holds them.

    chunk_bytes: mean chunk length, a power of two.
    cache_bytes: text held by each of the two cache generations.
    """

    def __init__(self, directory: str = TOKENIZER_DIR, name: str = VOCABULARY, chunk_bytes: int = 1024, cache_bytes: int = 4 << 20):
        import tiktoken

        with open(f"{directory}/{name}.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self._raw = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for word, rank in ranks.items():
            self.length[rank] = len(word)
        self._len = self.length.tolist()
        self.code = "H" if len(self._len) <= 1 << 16 else "I"
        self.chunk_bytes, self.cache_bytes = chunk_bytes, cache_bytes
        self._young: dict[bytes, array] = {}
        self._old: dict[bytes, array] = {}
        self._held = 0

    def direct(self, text: str) -> list[int]:
        """Ids of a text encoded at once."""
        first, *rest = _before_last_space(text)
        out = self._raw(first)
        for part in rest:
            out += self._raw(part)
        return out

    def _chunk(self, piece: bytes) -> array:
        ids = self._young.get(piece)
        if ids is None:
            ids = self._old.get(piece)
            if ids is None:
                ids = array(self.code, self.direct(piece.decode()))
            self._young[piece] = ids
            self._held += len(piece)
            if self._held > self.cache_bytes:
                self._old, self._young, self._held = self._young, {}, 0
        return ids

    def cuts(self, raw: np.ndarray) -> np.ndarray:
        """Chunk ends inside a text, by content alone, never inside a character."""
        h, width = _GEAR[raw], 1
        while width < 16 and width < len(h):
            h[width:] += h[:-width] << np.uint32(width)
            width *= 2
        at = np.flatnonzero(h < np.uint32((1 << 32) // self.chunk_bytes)) + 1
        at = at[at < len(raw)]
        return at[(raw[at] & 0xC0) != 0x80]

    def encode(self, text: str | None) -> array:
        """Ids of a text; empty for null and for the empty text."""
        if not text:
            return array(self.code)
        data = text.encode()
        if len(data) <= 2 * self.chunk_bytes:  # a chunk of its own
            return self._chunk(data)[:]
        raw = np.frombuffer(data, np.uint8)
        cuts = self.cuts(raw).tolist()
        if not cuts:
            return self._chunk(data)[:]
        safe = np.flatnonzero(_IS_SPACE[raw[1:]] & _IS_GRAPH[raw[:-1]]) + 1
        return self._joined(data, [*cuts, len(data)], safe)

    def _joined(self, data: bytes, ends: list[int], safe: np.ndarray) -> array:
        """Chunks put together; ``safe`` are places where any encoding has a token edge."""
        out = array(self.code)
        out.extend(self._chunk(data[: ends[0]]))
        done, size = ends[0], self._len
        places = [0, *safe.tolist(), len(data)]
        left_of = np.searchsorted(safe, ends, "left").tolist()
        k = 1
        while k < len(ends):
            start, end = ends[k - 1], ends[k]
            if start < done:  # a repair reached beyond this chunk's start
                start = done
            j = left_of[k - 1] + 1  # places[j] is the first safe place at or after the join
            if places[j] == start and start == ends[k - 1]:
                out.extend(self._chunk(data[start:end]))
                done, k = end, k + 1
                continue
            right = self._chunk(data[ends[k - 1] : end])
            lo = j - 1
            while True:  # drop tokens back to a safe place
                back = done - places[lo]
                n = len(out)
                while back > 0:
                    n -= 1
                    back -= size[out[n]]
                if back == 0:
                    break
                lo -= 1
            hi = j
            while hi < len(places) and places[hi] <= done:
                hi += 1
            while True:  # drop tokens of the right chunk up to a safe place
                if places[hi] >= end:
                    skip = len(right)
                    stop = places[hi]
                    break
                ahead, skip = places[hi] - ends[k - 1], 0
                while ahead > 0:
                    ahead -= size[right[skip]]
                    skip += 1
                if ahead == 0:
                    stop = places[hi]
                    break
                hi += 1
            del out[n:]
            out.extend(array(self.code, self.direct(data[places[lo] : stop].decode())))
            if skip < len(right):
                out.extend(right[skip:])
                done, k = end, k + 1
                continue
            done = stop
            while k < len(ends) and ends[k] <= done:
                k += 1
            if k < len(ends):  # the repair ended inside a later chunk, at a safe place
                out.extend(self._chunk_from(data, done, ends[k]))
                done, k = ends[k], k + 1
        return out

    def _chunk_from(self, data: bytes, start: int, end: int) -> array:
        return array(self.code, self.direct(data[start:end].decode()))


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(directory: str = TOKENIZER_DIR, name: str = VOCABULARY) -> ChunkEncoder:
    """The worker's encoder of a vocabulary, made once per process."""
    if (directory, name) not in _ENCODERS:
        _ENCODERS[directory, name] = ChunkEncoder(directory, name)
    return _ENCODERS[directory, name]


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", directory: str = TOKENIZER_DIR, name: str = VOCABULARY) -> DataFrame:
    """``(key, ids)`` for every row of ``documents``: no shuffle, one pass.

    Null and empty texts give an empty list; special-token strings are plain
    text; a repeated row gives a repeated row; a null key stays null; an empty
    table gives an empty table; other columns are not read.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(directory, name)
        for batch in batches:
            flat, offsets = array(own.code), [0]
            keys, at = batch.column(0), 0
            for i, value in enumerate(batch.column(1)):
                flat.extend(own.encode(value.as_py()))
                offsets.append(len(flat))
                if len(flat) >= 1 << 20 or i + 1 == batch.num_rows:
                    values = pa.array(np.frombuffer(flat, flat.typecode).astype(np.int32)) if flat else pa.array([], pa.int32())
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                    yield pa.RecordBatch.from_arrays([keys.slice(at, i + 1 - at), lists], names=[key, "ids"])
                    flat, offsets, at = array(own.code), [0], i + 1

    return require(documents, key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
