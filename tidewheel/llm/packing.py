"""Hierarchical packing of token sequences into windows of several lengths.

Whole windows of the longest tier are cut from long documents. What remains
of a document is routed to the shortest tier that holds it. Tiers are packed
from the longest to the shortest: a document opens a window of its tier, the
gap takes the longest pieces of shorter tiers that fit, and what is left of it
is filled by cutting one more document, whose rest is routed again. So every
window is full. Windows of a tier wait until they fill several step groups of
STEP_TOKENS tokens, to which they are dealt in snake order of their attention
cost: groups hold windows of one length, equal tokens and like costs.

A task packs the rows that it reads and nothing is shuffled. What is left at
its end, less than one window of the longest tier, is cut into full windows
whose lengths are powers of two. These and the windows that still wait share a
task's last groups, the longest first into the emptiest: as few groups as hold
them, of nearly equal tokens and at most STEP_TOKENS. Only these last groups
mix lengths or hold fewer tokens than the others.

Cases: null and empty texts are the end id alone; repeated rows and ids are
packed once each; very long texts are cut over as many windows as they fill;
an empty table gives an empty result; other columns are not read. Sequence ids
are unique and follow the input's partitions.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidewheel.llm import tokens
from tidewheel.llm.common import release, text_of

TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 1 << 16
#: Step groups of a tier that windows are dealt to at once.
GROUPS = 4
#: Pieces that fill a gap before a document is cut.
FILLS = 3


@dataclass(slots=True)
class Piece:
    doc_id: int | None
    ids: bytes
    start: int
    length: int

    def head(self, n: int) -> Piece:
        return Piece(self.doc_id, self.ids, self.start, n)

    def rest(self, n: int) -> Piece:
        return Piece(self.doc_id, self.ids, self.start + n, self.length - n)


Window = list[Piece]


class Packer:
    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        self.lengths: list[int] = []
        self.pool: list[Piece] = []
        self.total = 0

    def _put(self, piece: Piece) -> None:
        if piece.length:
            at = bisect_right(self.lengths, piece.length)
            self.lengths.insert(at, piece.length)
            self.pool.insert(at, piece)
            self.total += piece.length

    def _take(self, at: int) -> Piece:
        self.total -= self.lengths.pop(at)
        return self.pool.pop(at)

    def add(self, pieces: list[Piece]) -> list[Window]:
        """Take documents in; return the windows that are full."""
        top, full = self.tiers[-1], []
        for p in pieces:
            while p.length >= top:
                full.append([p.head(top)])
                p = p.rest(top)
            self.lengths.append(p.length), self.pool.append(p)
            self.total += p.length
        order = sorted(range(len(self.pool)), key=self.lengths.__getitem__)
        order = [i for i in order if self.lengths[i]]
        self.pool, self.lengths = [self.pool[i] for i in order], [self.lengths[i] for i in order]
        while self.pool:
            window = next(t for t in self.tiers if t >= self.lengths[-1])
            if self.total < window:
                break
            full.append(self._fill(window))
        return full

    def _fill(self, window: int) -> Window:
        row = [self._take(len(self.pool) - 1)]
        gap = window - row[0].length
        for _ in range(FILLS):
            at = bisect_right(self.lengths, gap) - 1
            if gap and at >= 0:
                row.append(self._take(at))
                gap -= row[-1].length
        while gap:
            at = min(bisect_left(self.lengths, gap), len(self.pool) - 1)
            piece = self._take(at)
            n = min(gap, piece.length)
            row.append(piece.head(n))
            self._put(piece.rest(n))
            gap -= n
        return row

    def finish(self) -> list[Window]:
        """Cut what is left into windows whose lengths are powers of two."""
        out = []
        while self.total:
            window = 1 << (self.total.bit_length() - 1)
            row, gap = [], window
            while gap:
                piece = self._take(len(self.pool) - 1)
                n = min(gap, piece.length)
                row.append(piece.head(n))
                self._put(piece.rest(n))
                gap -= n
            out.append(row)
        return out


def _length(window: Window) -> int:
    return sum(p.length for p in window)


def _cost(window: Window) -> int:
    return sum(p.length**2 for p in window)


class Steps:
    """Deals windows to step groups, numbered from first on."""

    def __init__(self, first: int = 0, step_tokens: int = STEP_TOKENS):
        self.next, self.step_tokens = first, step_tokens
        self.waiting: dict[int, list[Window]] = defaultdict(list)

    def add(self, windows: list[Window]) -> Iterator[list[tuple[int, Window]]]:
        """Take windows in; of those that fill whole groups, each with its group."""
        for w in windows:
            n = _length(w)
            mine = self.waiting[n]
            mine.append(w)
            if len(mine) * n >= GROUPS * self.step_tokens:
                del self.waiting[n]
                mine.sort(key=_cost, reverse=True)
                turns = (divmod(k, GROUPS) for k in range(len(mine)))
                yield [(self.next + (at if turn % 2 == 0 else GROUPS - 1 - at), w) for (turn, at), w in zip(turns, mine, strict=True)]
                self.next += GROUPS

    def finish(self, tails: list[Window]) -> list[tuple[int, Window]]:
        """What waits, and the task's last windows, in groups of nearly equal tokens."""
        left = sorted([*tails, *(w for mine in self.waiting.values() for w in mine)], key=lambda w: (_length(w), _cost(w)), reverse=True)
        groups = -(-sum(map(_length, left)) // self.step_tokens)
        loads, out = [(0, 0, g) for g in range(self.next, self.next + groups)], []
        for w in left:
            tokens_, cost, group = heapq.heappop(loads)
            heapq.heappush(loads, (tokens_ + _length(w), cost + _cost(w), group))
            out.append((group, w))
        self.waiting.clear()
        self.next += groups
        return out


def _pack(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = tokens.encoder(path).encode
    packer, base = Packer(), TaskContext.get().partitionId() << 40
    steps, sequence = Steps(base), base

    def rows(dealt: list[tuple[int, Window]]) -> pa.RecordBatch:
        nonlocal sequence
        columns: list[list] = [[] for _ in range(9)]
        for group, window in dealt:
            offset = 0
            for p in window:
                ids = p.ids[4 * p.start : 4 * (p.start + p.length)]
                row = (p.doc_id, p.start, p.length, zlib.crc32(ids), len(p.ids) // 4, sequence, offset, group)
                for column, value in zip(columns, row, strict=False):
                    column.append(value)
                if with_ids:
                    columns[8].append(np.frombuffer(ids, dtype="<i4"))
                offset += p.length
            sequence += 1
        arrays = [pa.array(c, type=pa.int64()) for c in columns[:8]]
        names = list(NAMES)
        if with_ids:
            arrays.append(pa.array(columns[8], type=pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in batches:
        for low, ids, sizes in encode(batch.column(1)):
            names, ends = batch.column(0).slice(low, len(sizes)).to_pylist(), np.cumsum(sizes).tolist()
            raw = ids.astype("<u4").tobytes()
            docs = [Piece(i, raw[4 * (b - n) : 4 * b], 0, n) for i, n, b in zip(names, sizes.tolist(), ends, strict=True)]
            yield from map(rows, steps.add(packer.add(docs)))
    yield rows(steps.finish(packer.finish()))
    release()


NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "step_group")


def pack(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, step_group, and ids."""
    path = path or tokens.default_path()
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    schema = ", ".join(f"{n} long" for n in NAMES) + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(lambda batches: _pack(batches, path, with_ids), schema)
