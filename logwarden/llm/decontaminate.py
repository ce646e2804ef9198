"""Benchmark passages in documents, by suffix arrays over blocks of the documents.

Every task turns its documents into blocks of words and sorts all suffixes of a block
by their words (a suffix array). All suffixes of the benchmark's items are then looked
up at once by binary search, one word deeper per step. A suffix's range in the array
shrinks with every step, and the places that fall out of it have their longest verbatim match
there. Matches of a window or more are kept: per document and item the longest one, with where
it begins in both, and the words that windows cover.

The benchmark is the query set: it is read in parts of bounded size, one broadcast for
each. A task meets all parts with a block before it goes on to the next, so a block's suffix
array is made once. Nothing is shuffled.

Words are compared by 64-bit hashes; every benchmark word found in a block is
compared as text once more.

Defined cases: null and empty texts have no words and are clean. An item without words
has no window; one of fewer than ``window`` words is one window. A null item_id is
named ``null``. Repeated rows are judged one by one. Of equally long matches the
first in the document is named, then the first in the item. Other columns are ignored by
``overlaps`` and kept by ``decontaminate``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

from logwarden.llm.rows import flat_utf8, spare
from logwarden.llm.words import word_hashes, word_spans

WINDOW = 13
#: Bytes of a block (a longer text is a block), and words of a broadcast part of the benchmark.
BLOCK_BYTES = 5_000_000
PART_WORDS = 1_000_000
#: One hit word in so many makes a document contaminated.
SHARE = 20

#: Matches that are spread to their places at a time.
GROUP = 1_000_000

SPANS = "array<struct<begin:bigint,end:bigint>>"
MATCHES = "array<struct<item:string,length:bigint,begin:bigint,item_begin:bigint>>"
SPAN_TYPE = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
MATCH_TYPE = pa.list_(pa.struct([
    ("item", pa.string()), ("length", pa.int64()), ("begin", pa.int64()), ("item_begin", pa.int64())]))


class Queries:
    """A part of the benchmark: words of all items, numbered and end to end."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.names = sorted({name for name, _ in items})
        data, offsets = flat_utf8(pa.array([text for _, text in items], pa.large_string()))
        starts, ends = word_spans(data, offsets)
        self.vocabulary, first, self.words = np.unique(
            word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        self.spelled = [bytes(data[starts[k] : ends[k]]).lower() for k in first]
        item = np.searchsorted(offsets, starts, "right") - 1
        number = {name: k for k, name in enumerate(self.names)}
        self.name = np.array([number[name] for name, _ in items], np.int64)[item]
        self.begin = np.searchsorted(item, item)  # where each suffix's item begins and ends
        self.end = np.searchsorted(item, item, "right")
        length = self.end - self.begin
        place = self.end - np.arange(len(item))
        self.need = np.where(place >= window, window, np.where(place == length, length, 0))  # 0: begins no window
        self.longest = int(length.max(initial=0))

    def __len__(self) -> int:
        return len(self.words)


def query_parts(benchmark: DataFrame, window: int, part_words: int) -> Iterator[Queries]:
    """The benchmark in parts of at most ``part_words`` words (or one item); the driver holds one part."""
    items, size = [], 0
    for row in benchmark.selectExpr("cast(item_id as string) as name", "cast(text as string) as text").toLocalIterator():
        words = len(row["text"] or "") // 2 + 1
        if items and size + words > part_words:
            yield Queries(items, window)
            items, size = [], 0
        items.append((row["name"] or "null", row["text"] or ""))
        size += words
    if items:
        yield Queries(items, window)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Places with a word above 0, sorted by the ``depth`` words from there on (0 ends a text).

    Three words are packed into the first sort key; then places that are still tied are
    sorted by the ranks of their next 3, 6, 12, ... words.
    """
    n = len(words)
    wide = np.concatenate([words, np.zeros(2, words.dtype)]).astype(np.int64)
    radix = int(words.max(initial=0)) + 1
    if radix < 1 << 21:
        key, height = (wide[:n] * radix + wide[1 : n + 1]) * radix + wide[2 : n + 2], 3
    else:
        key, height = wide[:n] * radix + wide[1 : n + 1], 2
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.zeros(0, bool)
    rank = np.zeros(n + 1, np.int64)
    slot = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(new, slot, 0)) + 1
    tied = tied_slots(new) if n else slot
    while height < depth and len(tied):
        at = order[tied]
        key = rank[at] * (n + 1) + rank[np.minimum(at + height, n)]
        inner = np.argsort(key, kind="stable")
        order[tied] = at[inner]
        key = key[inner]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[tied]] = np.maximum.accumulate(np.where(fresh, tied, 0)) + 1
        tied = tied[tied_slots(fresh)]
        height *= 2
    return order[np.searchsorted(words[order], 1) :]


def tied_slots(new: np.ndarray) -> np.ndarray:
    """Slots of groups of more than one; ``new`` marks the first of each."""
    return np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))


def bisect(words: np.ndarray, array: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray, target: np.ndarray,
           right: bool) -> np.ndarray:
    """In each range, the first slot whose word ``depth`` words on is not below (or is above) the target."""
    low, high = low.copy(), high.copy()
    last = len(words) - 1
    while (open_ := low < high).any():
        middle = (low + high) // 2
        found = words[np.minimum(array[np.minimum(middle, len(array) - 1)] + depth, last)]
        up = open_ & ((found <= target) if right else (found < target))
        low = np.where(up, middle + 1, low)
        high = np.where(open_ & ~up, middle, high)
    return low


class Block:
    """Documents of a block: their words' numbers end to end, each document followed by a 0."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = data
        self.starts, self.ends = word_spans(data, offsets)
        self.vocabulary, self.first, number = np.unique(
            word_hashes(data, self.starts, self.ends), return_index=True, return_inverse=True)
        doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.counts = np.bincount(doc, minlength=len(offsets) - 1)
        self.words = np.zeros(len(number) + len(self.counts), np.int32)
        self.words[np.arange(len(number)) + doc] = number + 1
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts + 1)
        self.array: np.ndarray | None = None

    def numbers(self, queries: Queries) -> np.ndarray:
        """The queries' words as this block numbers them; -1 where it has none of them."""
        at = np.searchsorted(self.vocabulary, queries.vocabulary)
        known = np.flatnonzero((at < len(self.vocabulary)))
        known = known[self.vocabulary[at[known]] == queries.vocabulary[known]]
        number = np.full(len(queries.vocabulary), -1, np.int64)
        for k in known:
            place = self.first[at[k]]
            if bytes(self.data[self.starts[place] : self.ends[place]]).lower() == queries.spelled[k]:
                number[k] = at[k] + 1
        return number[queries.words]

    def sort(self, depth: int) -> None:
        if self.array is None:
            self.array = suffix_array(self.words, depth)

    def search(self, queries: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Longest matches of at least a window: suffix, first and last slot (exclusive), words that match."""
        n = len(queries)
        self.sort(queries.longest)
        number = self.numbers(queries)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.array), np.int64)
        alive = np.arange(n) if len(self.array) else np.zeros(0, np.int64)
        found = [(alive[:0],) * 4]
        depth = 0

        def done(suffix: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
            use = (queries.need[suffix] > 0) & (queries.need[suffix] <= depth) & (first < last)
            if use.any():
                found.append((suffix[use], first[use], last[use], np.full(use.sum(), depth)))

        while len(alive):
            goes_on = alive + depth < queries.end[alive]
            goes_on[goes_on] = number[alive[goes_on] + depth] > 0
            done(alive[~goes_on], low[alive[~goes_on]], high[alive[~goes_on]])
            alive = alive[goes_on]
            target = number[alive + depth]
            a = bisect(self.words, self.array, depth, low[alive], high[alive], target, False)
            b = bisect(self.words, self.array, depth, a, high[alive], target, True)
            # what falls out of the range matches no further
            done(alive, low[alive], a)
            done(alive, b, high[alive])
            low[alive], high[alive] = a, b
            alive = alive[a < b]
            depth += 1
        return tuple(np.concatenate(c) for c in zip(*found))


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range that each is of."""
    sizes = last - first
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[owner], owner


def longest_matches(block: Block, queries: Queries) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Which words windows cover, and per (document, item) the longest match: document, name, length, place, suffix."""
    suffix, first, last, length = block.search(queries)
    covered = np.zeros(len(block.words) + 1, np.int64)
    best = [(suffix[:0],) * 5]
    sizes = np.cumsum(last - first)
    at = 0
    while at < len(suffix):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP, "right")))
        slots, owner = spread(first[at:stop], last[at:stop])
        place, owner = block.array[slots], owner + at
        covered += np.bincount(place, minlength=len(covered))
        covered -= np.bincount(place + queries.need[suffix[owner]], minlength=len(covered))
        best.append(first_of_each(block.doc[place], queries.name[suffix[owner]], length[owner], place, suffix[owner]))
        at = stop
    return np.cumsum(covered[:-1]) > 0, first_of_each(*(np.concatenate(c) for c in zip(*best)))


def first_of_each(doc: np.ndarray, name: np.ndarray, length: np.ndarray, place: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per (document, name) the longest match, then the first in the document, then the first in the benchmark."""
    order = np.lexsort((suffix, place, -length, name, doc))
    rows = [c[order] for c in (doc, name, length, place, suffix)]
    new = np.ones(len(order), bool)
    new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
    return tuple(c[new] for c in rows)


def cuts(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``size`` bytes, or one longer text."""
    begin = 0
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1)
        yield begin, end
        begin = end


def spans_of(marked: np.ndarray, doc: np.ndarray, base: np.ndarray) -> list[list[dict]]:
    """Per document the stretches of words that windows cover."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8)))
    spans: list[list[dict]] = [[] for _ in base]
    for a, b in edges.reshape(-1, 2).tolist():
        d = doc[a]
        spans[d].append({"begin": a - int(base[d]), "end": b - int(base[d])})
    return spans


def against_all(block: Block, parts: list[Queries]) -> tuple[np.ndarray, list[list[dict]], list[list[dict]]]:
    """Per document of a block: words hit, the stretches they are in, and the longest match of every item."""
    block.sort(max(p.longest for p in parts))
    base = np.cumsum(block.counts + 1) - block.counts - 1
    marked = np.zeros(len(block.words), bool)
    items: list[dict[str, dict]] = [{} for _ in base]
    for queries in parts:
        covered, rows = longest_matches(block, queries)
        marked |= covered
        for d, name, length, place, suffix in zip(*(c.tolist() for c in rows)):
            item, own = queries.names[name], items[d]
            match = {"item": item, "length": length, "begin": place - int(base[d]),
                     "item_begin": suffix - int(queries.begin[suffix])}
            # an item_id may be there twice, also in two parts
            if item not in own or (-length, match["begin"]) < (-own[item]["length"], own[item]["begin"]):
                own[item] = match
    n_hit = np.bincount(block.doc[marked], minlength=len(base))
    return n_hit, spans_of(marked, block.doc, base), [[own[k] for k in sorted(own)] for own in items]


class Names(NamedTuple):
    """Columns that ``annotated`` adds."""

    text: str
    n_words: str
    n_hit: str
    spans: str
    matches: str


def annotated(docs: DataFrame, benchmark: DataFrame, window: int, part_words: int, block_bytes: int) -> tuple[DataFrame, Names]:
    """``docs`` with words, words hit, stretches and longest matches, under names that no column of theirs has."""
    names = Names(*(spare(docs, n) for n in Names._fields))
    context = docs.sparkSession.sparkContext
    # the driver holds one part at a time
    parts = [context.broadcast(p) for p in query_parts(benchmark, window, part_words)] or [
        context.broadcast(Queries([], window))]
    rows = docs.withColumn(names.text, F.col("text").cast("string"))
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [p.value for p in parts]
        for batch in batches:
            data, offsets = flat_utf8(batch.column(columns.index(names.text)))
            for a, b in cuts(offsets, block_bytes):
                block = Block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n_hit, spans, matches = against_all(block, known)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, pa.array(block.counts.astype(np.int64)),
                     pa.array(n_hit.astype(np.int64)), pa.array(spans, SPAN_TYPE), pa.array(matches, MATCH_TYPE)],
                    [*columns, *names[1:]])

    added = [StructField(names.n_words, LongType()), StructField(names.n_hit, LongType()),
             *(StructField(n, DataType.fromDDL(t)) for n, t in ((names.spans, SPANS), (names.matches, MATCHES)))]
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *added])), names


def is_contaminated(names: Names) -> Column:
    return (F.col(names.n_hit) > 0) & (SHARE * F.col(names.n_hit) >= F.col(names.n_words))


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS,
             block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, contaminated, spans and matches.

    ``spans`` are the stretches of words that benchmark windows cover, ``matches`` the longest verbatim match of every
    item that has a window there, by item (as strings): its words, and where it begins in the document and the item.
    """
    found, names = annotated(docs.select("doc_id", "text"), benchmark, window, part_words, block_bytes)
    return found.select(
        "doc_id", F.col(names.n_words).alias("n_words"), F.col(names.n_hit).alias("n_hit"),
        F.col(names.spans).alias("spans"), F.col(names.matches).alias("matches"),
        is_contaminated(names).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, all columns kept."""
    found, names = annotated(docs, benchmark, window, part_words, block_bytes)
    return found.where(~is_contaminated(names)).select(docs.columns)
