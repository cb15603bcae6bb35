"""Oversized texts cut into overlapping pieces at natural boundaries.

Each token start gets a boundary strength. A sparse table over the strengths
answers, in constant time, which cut is the strongest in the window of permitted
piece lengths; ties go to the right, and the next piece steps back by the overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainweft.llm.encoding import TOKENIZER_DIR, VOCABULARY, encoder
from rainweft.workspace import require

LIMIT, OVERLAP = 2048, 128

#: Boundary kinds from weak to strong.
WORD, SENTENCE, LINE, PARAGRAPH, QUOTE, PART = 1, 2, 3, 4, 5, 6

_LINE = re.compile(rb"[^\r\n]*(?:\r\n|\r|\n|$)")
_SENTENCE = re.compile(rb"[.!?][\"')\]]*[ \t]+(?=\S)")
_UNSPACED = re.compile("(?:。|！|？|．|｡|।|؟|۔|…)+(?:」|』|）|”|»|[\"')])*".encode())  # sentence ends that need no blank
_CLAUSE = re.compile("(?:、|，|；|：)".encode())
_WORD = re.compile(rb"(?<=\S)(?=[ \t])")
_REPLY = re.compile(rb"-{2,} ?Original Message|_{20,}|-- ?$|--=20", re.I)
_DEPTH = re.compile(rb"[ \t]*((?:[>|][ \t]?)*)")


def boundaries(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and strengths of the natural boundaries of a mail."""
    at: list[int] = [m.start() for m in _WORD.finditer(data)]
    strength = [WORD] * len(at)
    for m in _SENTENCE.finditer(data):
        at.append(m.end() - 1)
        strength.append(SENTENCE)
    for pattern, kind in ((_UNSPACED, SENTENCE), (_CLAUSE, WORD)):
        for m in pattern.finditer(data):
            at.append(m.end())
            strength.append(kind)
    blank, depth = False, 0
    for m in _LINE.finditer(data):
        start, line = m.start(), m.group().strip()
        if start == m.end():
            break
        now = len(re.findall(rb"[>|]", _DEPTH.match(line).group(1)))
        if line.startswith(b"--") and len(line) > 12 and b" " not in line:
            kind = PART
        elif line and (_REPLY.match(line) or now != depth):
            kind = QUOTE
        else:
            kind = PARAGRAPH if blank and line else LINE
        at.append(start)
        strength.append(kind)
        blank = not line
        depth = now if line else depth
    return np.array(at, np.int64), np.array(strength, np.int64)


class RangeMax:
    """Sparse table: the rightmost place of the largest value in a range."""

    def __init__(self, values: np.ndarray):
        n = max(1, len(values))
        key = values.astype(np.int64) * n + np.arange(len(values))
        self.n, self.rows, width = n, [key], 1
        while 2 * width <= len(values):
            last = self.rows[-1]
            self.rows.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def best(self, lo: int, hi: int) -> int:
        """Place of the largest value in ``lo..hi``, both included."""
        k = int(hi - lo + 1).bit_length() - 1
        row = self.rows[k]
        return int(max(row[lo], row[hi - (1 << k) + 1]) % self.n)


def cut_tokens(strength: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Token ranges of the pieces. ``strength[i]``: of a cut before token i."""
    n, pieces, start = len(strength), [], 0
    table = RangeMax(strength) if n > limit else None
    least = max(overlap + 1, limit // 2)
    while n - start > limit:
        end = table.best(start + least, start + limit)
        pieces.append((start, end))
        start = end - overlap
    pieces.append((start, n))
    return pieces


def token_strength(data: bytes, lengths: np.ndarray) -> np.ndarray:
    """Boundary strength before each token; a boundary inside a token counts for the next one
    if only white space lies between. Before a token that begins inside a character it is below 0."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    raw = np.frombuffer(data, np.uint8)
    out = np.where((raw[starts] & 0xC0) == 0x80, -1, 0).astype(np.int64) if len(raw) else np.zeros(len(starts), np.int64)
    at, kind = boundaries(data)
    to = np.searchsorted(starts, at, "left")
    ok = to < len(starts)
    at, kind, to = at[ok], kind[ok], to[ok]
    gap = starts[to] - at
    for i in np.flatnonzero(gap > 0):
        if data[at[i] : starts[to[i]]].strip():
            kind[i] = 0
    np.maximum.at(out, to, kind)
    return out


def split_documents(
    documents: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, whole: bool = False, with_ids: bool = True, directory: str = TOKENIZER_DIR, name: str = VOCABULARY
) -> DataFrame:
    """``(key, piece_no, n_pieces, token_start, token_end, cut_kind, ids)``.

    Pieces of every text of more than ``limit`` tokens, numbered from 0, each of
    at most ``limit`` tokens, consecutive ones sharing ``overlap`` tokens;
    ``cut_kind`` is the strength of the boundary at the piece's end (0: none was
    in the window, null: end of the text); no cut falls inside a character. With ``whole`` shorter texts come out
    as one piece. Texts of up to ``limit`` bytes can't have more tokens and are
    dropped before Python. Null and empty texts have no pieces; a repeated row
    gives repeated pieces. No shuffle.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be below half of limit")
    kind = documents.schema[key].dataType.simpleString()
    rows = require(documents, key, text)
    rows = rows.where(F.length(text) > 0) if whole else rows.where(F.octet_length(text) > limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(directory, name)
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            lists, held = [], 0
            for i, value in enumerate(batch.column(1)):
                body = value.as_py()
                ids = own.encode(body)
                if len(ids) > limit:
                    raw = np.frombuffer(ids, ids.typecode).astype(np.int64)
                    strength = token_strength(body.encode(), own.length[raw])
                    pieces = cut_tokens(strength, limit, overlap)
                elif whole:
                    raw, pieces, strength = np.frombuffer(ids, ids.typecode), [(0, len(ids))], None
                else:
                    continue
                for no, (a, b) in enumerate(pieces):
                    end = None if no + 1 == len(pieces) else int(strength[b])
                    for col, v in zip(cols, (i, no, len(pieces), a, b, end)):
                        col.append(v)
                    lists.append(raw[a:b].astype(np.int32) if with_ids else None)
                    held += (b - a) * with_ids
                if held >= 1 << 20:
                    yield _pieces(batch, cols, lists, key)
                    cols, lists, held = [[], [], [], [], [], []], [], 0
            if cols[0]:
                yield _pieces(batch, cols, lists, key)

    return rows.mapInArrow(run, f"`{key}` {kind}, piece_no int, n_pieces int, token_start int, token_end int, cut_kind int, ids array<int>")


def _pieces(batch: pa.RecordBatch, cols: list[list], lists: list, key: str) -> pa.RecordBatch:
    keys = batch.column(0).take(pa.array(cols[0], pa.int64()))
    arrays = [keys, *[pa.array(c, pa.int32()) for c in cols[1:]], pa.array(lists, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(arrays, names=[key, "piece_no", "n_pieces", "token_start", "token_end", "cut_kind", "ids"])
