"""Periodic runs of words, found in a grammar of the texts.

A run is a stretch of consecutive words with smallest period q, of at least ``max(SHORTEST, 2 q)``
words, that no neighbouring word extends. The words of some thousand documents at a time become
numbers and one sequence, which Re-Pair compresses: the most frequent pair of neighbours becomes a
new symbol, until no pair occurs twice. A round replaces all places whose pair is more frequent than
those of both neighbours (equal pairs side by side: every second one), which is Re-Pair done at many
places at once. What is left of each document is paired up in levels to a balanced tree. A symbol
occurs wherever its phrase does, in any document of the block, and pairs never cross documents.

Any run crosses the middle of the smallest symbol that contains it. For each symbol of at least
``SHORTEST`` words the runs across its middle, within its words, are computed once: a run of 12 words
repeats at least 6 in a row, so the 3 words before or after the middle occur again at a distance of its
period. These distances are the candidates, and how far the period reaches is searched with prefix hashes. The runs found are
translated to all places the symbol has in the documents. Stretches of one period that overlap by the
period or more are one; of stretches with the same ends the smallest period stays. At last every
run is compared word by word.

A block is bounded by its number of words; only a document that is longer is a block by itself.

Defined cases: null and empty texts have no words, no runs and an empty text. Repeated rows are judged each. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logwarden.llm.rows import raw_texts, type_of

SHORTEST = 12
BLOCK_WORDS = 400_000
#: Candidates that are searched at a time.
GROUP = 500_000
#: Prime moduli below 2^31 for the prefix hashes.
PRIMES = (2_147_483_647, 2_147_483_629)


@dataclass
class Grammar:
    """Symbols below ``words`` are words; symbol ``words + k`` is the pair ``left[k], right[k]``.

    ``size`` is each pair's number of words, ``first`` a place where it occurs; ``rounds`` tells where the pairs
    of each round begin, whose parts are older. ``rest`` is what is left of the sequence, ``start`` the
    place of each of its symbols, ``end`` which of them close a document.
    """

    words: int
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    first: np.ndarray
    rounds: list[int]
    rest: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def width(self, symbols: np.ndarray) -> np.ndarray:
        """Words of each symbol."""
        out = np.ones(len(symbols), np.int64)
        pair = symbols >= self.words
        out[pair] = self.size[symbols[pair] - self.words]
        return out


def chosen(rank: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Which pairs to replace: those of higher rank than both neighbours, every second of equal ones side by side.

    ``joined`` tells which pairs' left neighbour is the one before; ranks below 0 are never chosen.
    """
    new = np.ones(len(rank), bool)
    new[1:] = ~joined[1:] | (rank[1:] != rank[:-1])
    begin = np.flatnonzero(new)
    stretch = np.cumsum(new) - 1
    value = rank[begin]
    before = np.full(len(value), -1, np.int64)
    before[1:] = np.where(joined[begin[1:]], value[:-1], -1)
    after = np.full(len(value), -1, np.int64)
    after[:-1] = np.where(joined[begin[1:]], value[1:], -1)
    top = (value > before) & (value > after)
    return top[stretch] & ((np.arange(len(rank)) - begin[stretch]) % 2 == 0)


def compress(words: np.ndarray, end: np.ndarray) -> Grammar:
    """Re-Pair in rounds. ``end`` marks the last word of each document.

    The sequence is a linked list, and a round looks only at pairs that may occur twice: pairs of old symbols
    that occurred once can't.
    """
    n = len(words)
    symbols = known = int(words.max()) + 1 if n else 0
    symbol = words.astype(np.int64)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[:n][end] = n
    before[0] = n
    before[1:n][end[:-1]] = n
    size, gone = np.ones(n + 1, np.int64), np.zeros(n + 1, bool)
    rng = np.random.Generator(np.random.PCG64(5))
    at = np.flatnonzero(~end)
    made: list[tuple[np.ndarray, ...]] = []
    rounds = [0]
    while len(at) > 1:
        keys = symbol[at] * symbols + symbol[after[at]]
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.ones(len(at), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        number = np.cumsum(new) - 1
        counts = np.bincount(number)
        if counts.max() < 2:
            break
        # equally frequent pairs are ranked by chance, or a repeated text would lose one pair a round
        rank_of = np.where(counts > 1, counts * len(counts) + rng.permutation(len(counts)), -1)
        pair = np.empty(len(at), np.int64)
        pair[order] = number
        joined = np.zeros(len(at), bool)
        joined[1:] = after[at[:-1]] == at[1:]
        pick = chosen(rank_of[pair], joined) & (counts[pair] > 1)
        take = at[pick]
        kinds, first, kind = np.unique(pair[pick], return_index=True, return_inverse=True)
        gone[after[take]] = True
        lost = after[take]
        made.append((symbol[take[first]], symbol[lost[first]], size[take[first]] + size[lost[first]], take[first]))
        size[take] += size[lost]
        symbol[take] = symbols + kind.reshape(-1)
        after[take] = after[lost]
        inner = after[take] < n
        before[after[take][inner]] = take[inner]
        at = np.unique(np.concatenate([at[counts[pair] > 1], take, before[take]]))
        at = at[at < n]
        at = at[~gone[at] & (after[at] < n)]
        symbols += len(kinds)
        rounds.append(symbols - known)
    left, right, sizes, firsts = (np.concatenate(c) for c in zip(*made)) if made else (np.zeros(0, np.int64),) * 4
    start = np.flatnonzero(~gone[:n])
    return Grammar(known, left, right, sizes, firsts, rounds, symbol[start], start, after[start] == n)


def tree_nodes(grammar: Grammar, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, middle, end) of all pairs of a balanced tree over what is left of each document."""
    begin = grammar.start
    stop = np.concatenate([begin[1:], [total]]) if len(begin) else begin
    doc = np.cumsum(grammar.end) - grammar.end
    found = [(begin[:0],) * 3]
    while True:
        place = np.arange(len(doc)) - np.searchsorted(doc, doc)
        left = np.flatnonzero((place[:-1] % 2 == 0) & (doc[1:] == doc[:-1])) if len(doc) > 1 else np.zeros(0, np.int64)
        if not len(left):
            break
        found.append((begin[left], begin[left + 1], stop[left + 1]))
        stop = stop.copy()
        stop[left] = stop[left + 1]
        stays = np.ones(len(doc), bool)
        stays[left + 1] = False
        begin, stop, doc = begin[stays], stop[stays], doc[stays]
    return tuple(np.concatenate(c) for c in zip(*found))


class Reach:
    """How far two places of a sequence read the same, by prefix hashes modulo two primes."""

    def __init__(self, words: np.ndarray) -> None:
        rng = np.random.Generator(np.random.PCG64(11))
        n = len(words)
        self.powers, self.sums = [], []
        for prime in PRIMES:
            value = rng.integers(1, prime, int(words.max()) + 1 if n else 1, dtype=np.uint64)[words]
            power = np.ones(n + 1, np.uint64)
            filled, factor = 1, int(rng.integers(1 << 20, prime))
            while filled <= n:
                more = min(filled, n + 1 - filled)
                power[filled:filled + more] = power[:more] * np.uint64(factor) % np.uint64(prime)
                filled, factor = filled + more, factor * factor % prime
            # terms are below 2^31, so sums of up to 2^32 of them fit
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(value * power[:n] % np.uint64(prime), out=sums[1:])
            self.powers.append(power)
            self.sums.append(sums)

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` words from ``a`` equal those from ``b``, a < b."""
        out = np.ones(len(a), bool)
        for prime, power, sums in zip(PRIMES, self.powers, self.sums):
            m = np.uint64(prime)
            out &= (sums[a + length] - sums[a]) % m * power[b - a] % m == (sums[b + length] - sums[b]) % m
        return out

    def search(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, backward: bool) -> np.ndarray:
        """The largest length up to ``most`` that reads the same from (backward: before) both places."""
        low, high = np.zeros_like(most), most.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_] + 1) // 2
            back = middle if backward else 0
            fits = self.same(a[open_] - back, b[open_] - back, middle)
            low[open_[fits]] = middle[fits]
            high[open_[~fits]] = middle[~fits] - 1


def seed_distances(words: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray,
                   seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of (symbol, distance) at which ``seed`` words beside the symbol's middle occur again within the symbol."""
    n, kinds = len(words), int(words.max()) + 1
    gram = words.astype(np.int64)
    for step in range(1, seed):
        gram = np.unique(gram[:-1] * kinds + words[step:], return_inverse=True)[1].reshape(-1)
    order = np.argsort(gram, kind="stable")
    keys = gram[order] * n + order
    nodes, distances = [], []
    for place in (middle - seed, middle):
        inside = np.flatnonzero((place >= begin) & (place + seed <= end))
        at, base = place[inside], gram[place[inside]] * n
        low = np.searchsorted(keys, base + begin[inside])
        high = np.searchsorted(keys, base + end[inside] - seed, side="right")
        some = np.flatnonzero(high - low > 1)
        number = (high - low)[some]
        node = np.repeat(inside[some], number)
        index = np.arange(len(node)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(low[some], number)
        distance = np.abs(order[index] - np.repeat(at[some], number))
        fits = (distance > 0) & (2 * distance <= end[node] - begin[node])
        nodes.append(node[fits])
        distances.append(distance[fits])
    both = np.unique(np.concatenate(nodes) * (n + 1) + np.concatenate(distances))
    return both // (n + 1), both % (n + 1)


def crossing_runs(words: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray,
                  shortest: int) -> tuple[np.ndarray, ...]:
    """(symbol, start, end, period) of the runs across the symbols' middles, within their words."""
    # a run repeats half of the shortest length in a row, and half of that is on one side of the middle
    repeated = -(-shortest // 2)
    node, period = seed_distances(words, begin, middle, end, -(-repeated // 2))
    reach, parts = Reach(words), [(node[:0],) * 4]
    for k in range(0, len(node), GROUP):
        of, q = node[k:k + GROUP], period[k:k + GROUP]
        for anchor in (middle[of] - 1, middle[of] - q):
            low, high = begin[of], end[of] - q
            use = np.flatnonzero((anchor >= low) & (anchor < high))
            use = use[words[anchor[use]] == words[anchor[use] + q[use]]]
            a, p, low, high = anchor[use], q[use], low[use], high[use]
            first = a - reach.search(a, a + p, a - low, True)
            last = a + reach.search(a, a + p, high - a, False) + p
            cut = middle[of[use]]
            good = (last - first >= np.maximum(shortest, 2 * p)) & (first < cut) & (cut < last)
            parts.append((of[use][good], first[good], last[good], p[good]))
    found = np.unique(np.stack([np.concatenate(c) for c in zip(*parts)]), axis=1)
    return smallest_periods(*found)


def smallest_periods(owner: np.ndarray, first: np.ndarray, last: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row for each (owner, first, last): that of the smallest period."""
    order = np.lexsort((period, last, first, owner))
    rows = [c[order] for c in (owner, first, last, period)]
    new = np.ones(len(order), bool)
    new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])
    return tuple(c[new] for c in rows)


def places_of(grammar: Grammar, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (pair, place) of the pairs marked ``wanted``, by going down the derivation where it leads to one."""
    old, leads = grammar.words, wanted.copy()
    for low, high in zip(grammar.rounds, grammar.rounds[1:]):
        for part in (grammar.left[low:high], grammar.right[low:high]):
            pair = part >= old
            leads[low:high][pair] |= leads[part[pair] - old]
    symbol, place = grammar.rest, grammar.start
    found = [(symbol[:0], place[:0])]
    while len(symbol):
        use = symbol >= old
        symbol, place = symbol[use] - old, place[use]
        use = leads[symbol]
        symbol, place = symbol[use], place[use]
        hit = wanted[symbol]
        found.append((symbol[hit], place[hit]))
        left, right = grammar.left[symbol], grammar.right[symbol]
        symbol, place = np.concatenate([left, right]), np.concatenate([place, place + grammar.width(left)])
    return tuple(np.concatenate(c) for c in zip(*found))


def merged(first: np.ndarray, last: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of one period that overlap by it or more become one; then the smallest period of equal stretches."""
    if not len(first):
        return first, last, period
    order = np.lexsort((last, first, period))
    first, last, period = first[order], last[order], period[order]
    # largest end so far among stretches of the same period
    offset = np.cumsum(np.concatenate([[0], period[1:] != period[:-1]])) * (int(last.max()) + 1)
    so_far = np.maximum.accumulate(last + offset) - offset
    new = np.ones(len(first), bool)
    new[1:] = (period[1:] != period[:-1]) | (first[1:] + period[1:] > so_far[:-1])
    begin = np.flatnonzero(new)
    first, period, last = first[begin], period[begin], np.maximum.reduceat(last, begin)
    return smallest_periods(np.zeros_like(first), first, last, period)[1:]


def runs_of(words: np.ndarray, end: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, period) of all runs of a sequence of documents, ordered by first and period; last is exclusive."""
    if shortest < 2:
        raise ValueError("a run has two words at least")
    if len(words) < shortest:
        return (np.zeros(0, np.int64),) * 3
    grammar = compress(words, end)
    long_ = np.flatnonzero(grammar.size >= shortest)
    begin, width = grammar.first[long_], grammar.width(grammar.left[long_])
    nodes = tree_nodes(grammar, len(words))
    far = nodes[2] - nodes[0] >= shortest
    spans = zip((begin, begin + width, begin + grammar.size[long_]), [n[far] for n in nodes])
    node, first, last, period = crossing_runs(words, *(np.concatenate(c) for c in spans), shortest)
    # runs of the tree's pairs are where they were found; those of the grammar's pairs are wherever these occur
    single = node >= len(long_)
    parts = [(first[single], last[single], period[single])]
    if not single.all():
        pair, shift = long_[node[~single]], first[~single] - begin[node[~single]]
        length, q = (last - first)[~single], period[~single]
        wanted = np.zeros(len(grammar.left), bool)
        wanted[pair] = True
        symbol, place = places_of(grammar, wanted)
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        low, high = np.searchsorted(ordered, symbol), np.searchsorted(ordered, symbol, side="right")
        number = high - low
        index = order[np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(low, number)]
        at = np.repeat(place, number) + shift[index]
        parts.append((at, at + length[index], q[index]))
    first, last, period = merged(*(np.concatenate(c) for c in zip(*parts)))
    for s, e, q in zip(first.tolist(), last.tolist(), period.tolist()):
        if not np.array_equal(words[s:e - q], words[s + q:e]):
            raise RuntimeError("two hashes of words are equal by chance")
    return first, last, period


def scan(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), and text without what runs repeat.

    ``text`` has the words that are in no run, and each run's first period, joined by one space.
    """
    kind = type_of(docs, "doc_id")

    def judged(names: list, texts: list[list[bytes]], id_type: pa.DataType) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        words = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, offsets[-1])
        end = np.zeros(len(words), bool)
        end[offsets[1:][sizes > 0] - 1] = True
        first, last, period = runs_of(words, end, shortest)
        ends = np.searchsorted(first, offsets)
        covered = np.zeros(len(words) + 1, np.int64)
        np.add.at(covered, first + period, 1)
        np.add.at(covered, last, -1)
        dropped = np.cumsum(covered)[:-1] > 0
        kept = [
            t if low == high else [t[k] for k in np.flatnonzero(~dropped[a:a + len(t)])]
            for t, a, low, high in zip(texts, offsets.tolist(), ends.tolist(), ends[1:].tolist())]
        begin = first - offsets[np.searchsorted(offsets, first, side="right") - 1]
        found = pa.StructArray.from_arrays(
            [pa.array(c, pa.int64()) for c in (begin, last - first, period)], ["start", "length", "period"])
        return pa.RecordBatch.from_arrays(
            [pa.array(names, id_type), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found),
             pa.array([b" ".join(t) for t in kept], pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "runs", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list = []
        texts: list[list[bytes]] = []
        held, id_type = 0, None
        for batch in batches:
            id_type = batch.column("doc_id").type
            for name, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text"))):
                # bytes part at exactly the white space that parts words: space, tab, and line feed to carriage return
                words = text.split()
                names.append(name)
                texts.append(words)
                held += len(words)
                if held >= BLOCK_WORDS or len(names) >= BLOCK_WORDS:
                    yield judged(names, texts, id_type)
                    names, texts, held = [], [], 0
        if names:
            yield judged(names, texts, id_type)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        run, f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, text string")
