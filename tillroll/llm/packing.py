"""Order-preserving packing of token ids into sequences by dynamic programming.

The documents of an input partition, in their order, make one stream of ids. Windows of
the stream become sequences. A window's cost is its padding up to SEQUENCE, but none
where its length is a power of two, a little for being a sequence at all, and a truncation
penalty by where it ends: nothing at the end of a document, some at the end of a sentence,
most inside one. Cuts are chosen over ends of documents and sentences (and every GAP ids
inside longer sentences) to make the sum least.

With f the least cost up to a cut and p the position, padding is linear: f(j) is the least
f(i) + p(i) within SEQUENCE before p(j), plus SEQUENCE - p(j) and the penalty. A monotone
queue gives that minimum in constant time; windows of a power of two are looked up by their
starts. The programme runs over the whole stream, a stretch at a time: only cuts of the last
SEQUENCE ids can be the start of a further window, and a cut that all their ways back share is
final, so its sequences are given out and forgotten. Memory is that of a stretch, a document and
the ids since the last final cut. Ways that never meet (such as rows of one text whose length
divides SEQUENCE) would make that the whole stream; beyond HELD ids the cheapest way is taken,
which costs a SEQUENCE of padding at most.

Among the last TAIL ids of a stream every position is a place to cut, so that what is left over
there can become sequences of a power of two, which need no padding. Without that, each
partition would pad half a sequence on average.

Documents are not moved: nothing is shuffled, and a task that is run again reads the same
rows in the same order and makes the same sequences. Sequence ids carry the partition.

Cases: a NULL or empty text is its closing id alone; repeated rows and NULL doc_ids are
packed as any other; a partition or table without rows gives no sequence; further columns
are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tillroll.llm.common import arrow_schema, column, importable, record_batch, slices
from tillroll.llm.tokens import encoder, tokenizer_path

SEQUENCE = 4096
CLOSING_ID = 2
GAP = 256
SENTENCE_PENALTY, INNER_PENALTY, SEQUENCE_COST = 8.0, 32.0, 1.0
STRETCH = 64 * SEQUENCE
TAIL = SEQUENCE
# Ids without a final cut that a task holds at most, besides a stretch and a document.
HELD = 16 * STRETCH

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint,"
    " sequence_id bigint, offset bigint"
)


def candidates(
    ends: np.ndarray, inner: np.ndarray, total: int, done: int = 0, known: int = 0, last: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Positions to cut at, ``done`` and those after it up to ``total``, and their penalties.

    ``ends``: positions after documents; ``inner``: after sentences, both beyond ``done``;
    ``known``: the last of them before; ``last``: the stream ends at ``total``.
    """
    penalty = np.full(total + 1 - done, np.inf)
    penalty[inner - done] = SENTENCE_PENALTY
    penalty[ends - done] = 0
    if last:
        penalty[-1] = 0
    stops = np.concatenate([[known], np.flatnonzero(np.isfinite(penalty)) + done, [total + 1]])
    for k in np.flatnonzero(np.diff(stops) > GAP):
        filled = np.arange(stops[k] + GAP, stops[k + 1], GAP)
        penalty[filled[filled > done] - done] = INNER_PENALTY
    if last:
        tail = penalty[max(0, total - TAIL - done) :]
        tail[np.isinf(tail)] = INNER_PENALTY
    penalty[0] = 0
    at = np.flatnonzero(np.isfinite(penalty))
    return at + done, penalty[at]


class Cutter:
    """The dynamic programme over one stream: places go in, cuts that are final come out."""

    def __init__(self, sequence: int = SEQUENCE):
        self.sequence = sequence
        # Of each place since the last final cut: position, least cost, start of its window.
        self.at, self.cost, self.back = [0], [0.0], [0]
        self.queue: deque[tuple[float, int]] = deque([(0.0, 0)])

    def extend(self, at: np.ndarray, penalty: np.ndarray) -> None:
        if not len(at):
            return
        p, cost, back, queue, sequence = self.at, self.cost, self.back, self.queue, self.sequence
        first = bisect_left(p, int(at[0]) - sequence)
        near = np.concatenate([np.array(p[first:], np.int64), at])
        # Windows of a power of two as (end, start), by end.
        ends, starts, power = [], [], 1
        while power < sequence:
            start = np.searchsorted(near, at - power)
            some = np.flatnonzero(near[start] == at - power)
            ends.append(some)
            starts.append(start[some])
            power *= 2
        end = np.concatenate(ends)
        exact = (np.concatenate(starts)[np.argsort(end, kind="stable")] + first).tolist()
        upto = np.cumsum(np.bincount(end, minlength=len(at))).tolist()
        begin, j, horizon = 0, len(p), p[queue[0][1]] + sequence
        for here, extra, stop in zip(at.tolist(), (penalty + SEQUENCE_COST).tolist(), upto):
            while horizon < here:
                queue.popleft()
                horizon = p[queue[0][1]] + sequence
            low, i = queue[0]
            low += sequence - here
            for k in exact[begin:stop]:
                if cost[k] < low:
                    low, i = cost[k], k
            begin = stop
            low += extra
            p.append(here)
            cost.append(low)
            back.append(i)
            reach = low + here
            if queue[-1][0] >= reach:
                self._push(reach, j)
                horizon = p[queue[0][1]] + sequence
            else:
                queue.append((reach, j))
            j += 1

    def _push(self, reach: float, j: int) -> None:
        while self.queue and self.queue[-1][0] >= reach:
            self.queue.pop()
        self.queue.append((reach, j))

    def settled(self, force: bool = False) -> list[int]:
        """The final cuts, the last one of the call before first; with ``force`` at least one more."""
        p, cost, back = self.at, self.cost, self.back
        first = bisect_left(p, p[-1] + 1 - self.sequence)
        root = self._shared(first)
        if force and not root:
            late = range(bisect_left(p, p[-1] - self.sequence // 2), len(p))
            root = back[min(late, key=lambda i: cost[i] + p[i])]
            through = [i == root for i in range(len(p))]
            for i in range(root + 1, len(p)):
                through[i] = through[back[i]]
                if not through[i]:
                    cost[i] = float("inf")
        out = self._way(root)
        if root:
            self.at, self.cost = p[root:], cost[root:]
            self.back = [max(i - root, 0) for i in back[root:]]
            self.queue.clear()
            for j in range(max(first - root, 0), len(self.at)):
                if self.cost[j] < float("inf"):
                    self._push(self.cost[j] + self.at[j], j)
        return out

    def _shared(self, first: int) -> int:
        """The last place on the ways back of all from ``first`` on."""
        places = {i for i in range(first, len(self.at)) if self.cost[i] < float("inf")}
        heap = [-i for i in places]
        heapify(heap)
        while len(places) > 1:
            i = -heappop(heap)
            places.remove(i)
            if self.back[i] not in places:
                places.add(self.back[i])
                heappush(heap, -self.back[i])
        return places.pop()

    def _way(self, j: int) -> list[int]:
        out = []
        while j:
            out.append(self.at[j])
            j = self.back[j]
        return [self.at[0], *reversed(out)]

    def finish(self) -> list[int]:
        """The cuts up to the last place."""
        return self._way(len(self.at) - 1)


def cuts(at: np.ndarray, penalty: np.ndarray, sequence: int = SEQUENCE) -> list[int]:
    """The cuts of least cost, first and last position included."""
    cutter = Cutter(sequence)
    cutter.extend(at[1:], penalty[1:])
    return cutter.finish()


class Packer:
    """Packs the documents of one stream; ``add`` and ``finish`` return pieces."""

    def __init__(self, stops: np.ndarray, first_id: int, sequence: int = SEQUENCE):
        self.stops, self.next_id = stops, first_id
        self.docs: deque = deque()  # [doc_id, ids, position in the document]
        self.cutter = Cutter(sequence)
        # Positions in the stream: its end so far, of places tried, of the last stop among them, of sequences made.
        self.size = self.done = self.known = self.made = 0
        self.ends: list[int] = []
        self.inner: list[np.ndarray] = []

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        self.docs.append([doc_id, ids, 0])
        self.inner.append(np.flatnonzero(self.stops[ids]) + (self.size + 1))
        self.size += len(ids)
        self.ends.append(self.size)
        out = []
        while self.size - self.done >= STRETCH + TAIL:
            out += self._solve(self.done + STRETCH, last=False)
        return out

    def finish(self) -> list[tuple]:
        return self._solve(self.size, last=True) if self.size else []

    def _solve(self, total: int, last: bool) -> list[tuple]:
        ends, inner = np.array(self.ends, np.int64), np.concatenate(self.inner)
        e, i = (np.searchsorted(x, total, "right") for x in (ends, inner))
        at, penalty = candidates(ends[:e], inner[:i], total, self.done, self.known, last)
        self.cutter.extend(at[1:], penalty[1:])
        self.done, self.known = total, max(self.known, *ends[:e][-1:].tolist(), *inner[:i][-1:].tolist(), 0)
        self.ends, self.inner = ends[e:].tolist(), [inner[i:]]
        found = self.cutter.finish() if last else self.cutter.settled(total - self.made > HELD)
        out = []
        for length in np.diff(found).tolist():
            out += self._emit(length)
        self.made = found[-1]
        return out

    def _emit(self, length: int) -> list[tuple]:
        out, offset = [], 0
        while offset < length:
            doc_id, ids, start = self.docs[0]
            n = min(len(ids) - start, length - offset)
            crc = zlib.crc32(ids[start : start + n].astype("<u4").tobytes())
            out.append((doc_id, start, n, crc, len(ids), self.next_id, offset))
            offset += n
            if start + n == len(ids):
                self.docs.popleft()
            else:
                self.docs[0][2] = start + n
        self.next_id += 1
        return out


def pack(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece of a document in a sequence; see PIECES."""
    path = tokenizer or tokenizer_path()
    arrow = arrow_schema(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        packer = Packer(words.stops, TaskContext.get().partitionId() << 36, sequence)
        for batch in batches:
            for part in slices(batch):
                pieces = []
                texts = [t or "" for t in column(part, "text")]
                for doc_id, ids in zip(column(part, "doc_id"), words.encode_many(texts)):
                    pieces += packer.add(doc_id, np.append(ids, np.uint32(CLOSING_ID)))
                if pieces:
                    yield record_batch(list(zip(*pieces)), arrow)
        pieces = packer.finish()
        if pieces:
            yield record_batch(list(zip(*pieces)), arrow)

    return importable(docs.select("doc_id", "text")).mapInArrow(run, PIECES)
