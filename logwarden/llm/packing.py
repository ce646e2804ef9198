"""Documents packed in order into sequences of bounded length.

Each partition's documents, sorted by id, form one stream of ids. Where sequences end
is chosen by dynamic programming over the cut positions of a stretch of the stream:

    cost(j) = cut(j) + fixed + min over i, j - capacity <= i < j, of cost(i) + padding(j - i)

``cut`` is nothing after a document, little after a sentence, much elsewhere. Padding
is ``capacity - length``, or none where the length is a power of two. The first
case is a sliding-window minimum of cost(i) + i, kept in a monotone queue; the second
is one look-up for each power from a sixteenth of the capacity up. A stretch ends at its
cheapest cut within one capacity of its end, and the rest is carried to the next stretch, so
memory is bounded by a stretch and one document. What is left at the end of a partition is
cut into powers of two.

Nothing is shuffled: partitions are independent, and a lost task is simply run again.

Defined cases: null and empty texts are the end token alone. Repeated rows are packed
each for itself; rows of one id are ordered by text. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from logwarden.llm.rows import texts, type_of
from logwarden.llm.tokens import vocabulary_path, word_tokenizer

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END = 2
SENTENCE_ENDS = (".", "!", "?")
#: Costs in tokens of padding: of a cut after a sentence, of one elsewhere, and of any sequence.
AFTER_SENTENCE, ELSEWHERE, EACH = 8, 256, 32
#: Stretches without an end of sentence get cut positions this share of the capacity apart.
STEPS = 16
STRETCH = 256 * CAPACITY
#: More than the number of sequences that one partition can hold.
PART = 1 << 40

PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def cut_positions(n: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in 1..n where a sequence may end, ascending, and what each cut costs."""
    cost = np.full(n + 1, -1, np.int32)
    natural = np.concatenate([[0], np.union1d(doc_ends, sentence_ends), [n]])
    gaps = np.diff(natural)
    for k in np.flatnonzero(gaps > 4 * step):
        cost[natural[k] + step : natural[k + 1] : step] = ELSEWHERE
    cost[n] = ELSEWHERE
    cost[sentence_ends] = AFTER_SENTENCE
    cost[doc_ends] = 0
    cost[0] = -1
    positions = np.flatnonzero(cost >= 0)
    return positions, cost[positions]


def best_cuts(positions: np.ndarray, cuts: np.ndarray, capacity: int, last: bool) -> list[int]:
    """The cheapest ends of sequences; the last one is the end if ``last``, else near it.

    ``positions`` has no gap above ``capacity``.
    """
    at = [0, *positions.tolist()]
    price = [0, *cuts.tolist()]
    powers = [1 << k for k in range(capacity.bit_length()) if capacity <= 16 << k <= 16 * capacity]
    cost, back = [0], [0]
    where = {0: 0}
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    for j in range(1, len(at)):
        p = at[j]
        while at[queue[0][1]] < p - capacity:
            queue.popleft()
        value, i = queue[0]
        best = value + capacity - p
        for power in powers:
            k = where.get(p - power)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        best += price[j] + EACH
        cost.append(best)
        back.append(i)
        where[p] = j
        while queue and queue[-1][0] >= best + p:
            queue.pop()
        queue.append((best + p, j))
    j = len(at) - 1
    if not last:
        j = min((k for k in range(len(at)) if at[k] > at[-1] - capacity), key=lambda k: (cost[k], -k))
    ends = []
    while j:
        ends.append(at[j])
        j = back[j]
    return ends[::-1]


def binary_parts(length: int) -> list[int]:
    """A length as a sum of powers of two, largest first."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


def is_any(ids: np.ndarray, wanted: list[int]) -> np.ndarray:
    found = np.zeros(len(ids), bool)
    for x in wanted:
        found |= ids == x
    return found


class Stream:
    """One partition's ids, packed as they come; ``pieces`` collects the result's columns."""

    def __init__(self, capacity: int, sentence_ids: list[int], first_sequence: int) -> None:
        self.capacity, self.sentence_ids, self.sequence = capacity, sentence_ids, first_sequence
        self.ids: list[np.ndarray] = []
        self.docs: list[list] = []  # doc_id, ids of it already packed, ids of it in all
        self.length = 0
        self.pieces: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append([doc_id, 0, len(ids)])
        self.ids.append(ids)
        self.length += len(ids)
        if self.length >= STRETCH + self.capacity:
            self.pack(last=False)

    def pack(self, last: bool) -> None:
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
        done = 0
        while len(ids) - done >= STRETCH + self.capacity:
            done += self.pack_stretch(ids[done : done + STRETCH], False)
        if last and done < len(ids):
            done += self.pack_stretch(ids[done:], True)
        self.ids = [ids[done:].copy()]
        self.length = len(self.ids[0])

    def pack_stretch(self, ids: np.ndarray, last: bool) -> int:
        left = np.array([total - start for _, start, total in self.docs], np.int64)
        doc_ends = np.cumsum(left)
        doc_ends = doc_ends[doc_ends <= len(ids)]
        sentence_ends = np.flatnonzero(is_any(ids, self.sentence_ids)) + 1
        places = cut_positions(len(ids), doc_ends, sentence_ends, max(1, self.capacity // STEPS))
        ends = best_cuts(*places, self.capacity, last)
        if last and ends:
            begin = ends[-2] if len(ends) > 1 else 0
            parts = binary_parts(ends[-1] - begin)
            ends[-1:] = (begin + np.cumsum(parts)).tolist()
        begin = doc = 0
        for end in ends:
            offset = 0
            while begin + offset < end:
                doc_id, start, total = self.docs[doc]
                length = min(total - start, end - begin - offset)
                part = ids[begin + offset : begin + offset + length]
                crc = zlib.crc32(np.ascontiguousarray(part, dtype="<u4"))
                self.pieces.append((doc_id, start, length, crc, total, self.sequence, offset))
                self.docs[doc][1] += length
                offset += length
                doc += self.docs[doc][1] == total
            self.sequence += 1
            begin = end
        del self.docs[:doc]
        return ends[-1] if ends else 0

    def take(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*self.pieces)) or [[] for _ in schema]
        self.pieces = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or vocabulary_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        ends = [tokenizer.whole.token_to_id(mark + "</w>") for mark in SENTENCE_ENDS]
        stream = Stream(capacity, [x for x in ends if x is not None], TaskContext.get().partitionId() * PART)
        closing = np.array([end], np.uint32)
        schema = None
        for batch in batches:
            numbers = pa.int64()
            schema = pa.schema([("doc_id", batch.column("doc_id").type)] + [
                (field.split()[0], numbers) for field in PIECE.split(", ")])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text"))):
                stream.add(doc_id, np.concatenate([tokenizer.ids(text), closing]))
            yield stream.take(schema)
        stream.pack(last=True)
        if schema is not None:
            yield stream.take(schema)

    rows = docs.selectExpr("doc_id", "cast(text as string) as text").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, {PIECE}")
