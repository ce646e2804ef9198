"""How sources of one language differ in their words.

Terms are counted within a task as text, and leave it as 64-bit digests: a row per (language, term) has
the digest, the text, and counts per source. These rows are landed. Only digests and counts are
shuffled to sum them up and to keep the terms that enough documents hold. For kept digests the smallest and
the largest text are compared: where they differ, terms collide, and those digests' landed rows are summed
again by text (``part`` numbers the terms of a digest, from 1; 0 stands for a digest of one term).
Text is joined back to the rows that are reported.

A group (language, source) gives a kept term p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N its sum of
counts over the V kept terms; two groups differ by the sum of floor((p - q)^2 / (p + q)). Sums over pairs
of sources are worked out in blocks: some terms, and two tiles of up to ``TILE`` sources, as two
matrices. A term that a source lacks has the p of count 0, and terms that both tiles lack are
counted, so rows grow with the terms that occur, and no pairs are made per term.

Defined cases: null text, lang and source are ''. Every row is a document, repeated rows too. Ties are
ordered by the item's UTF-8 bytes. A language without kept terms gives its pairs with value 0. Empty
tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from logwarden.llm.rows import raw_texts
from logwarden.sources.landing import land

MIN_DOCS = 10
TOP = 10
TILE = 64
#: Cells of a block's matrix, about.
CELLS = 1 << 20
#: Terms and sources that a task counts before it passes its counts on.
HELD = 1_000_000
SLICE = 50_000
STRETCH = 1 << 22
BITS = 64
#: Letters, and all beyond ASCII, are of a term; A-Z are lowered, anything else parts terms.
LETTERS = bytes(
    b | 32 if chr(b).isascii() and chr(b).isalpha() else b if b >= 128 else 32 for b in range(256))


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, for a stretch of it at a time."""
    begin = 0
    while begin < len(text):
        end = begin + STRETCH
        if end < len(text):
            while end < len(text) and LETTERS[text[end]] != 32:
                end += 1
        yield text[begin:end].translate(LETTERS).split()
        begin = end


def counted(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(lang, digest, term, sources, counts, docs): each task's counts per language, term and source."""
    mask = (1 << bits) - 1

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for lang in sorted({lang for lang, _ in held}):
            sources = [s for l, s in held if l == lang]
            number: dict[bytes, int] = {}
            term, source, counts, docs_of = [], [], [], []
            for k, name in enumerate(sources):
                n, d = held[lang, name]
                term.append(np.fromiter((number.setdefault(t, len(number)) for t in n), np.int64, len(n)))
                source.append(np.full(len(n), k))
                counts.append(np.fromiter(n.values(), np.int64, len(n)))
                docs_of.append(np.fromiter(map(d.__getitem__, n), np.int64, len(n)))
            term = np.concatenate(term)
            order = np.argsort(term, kind="stable")
            columns = [np.concatenate(c)[order] for c in (source, counts, docs_of)]
            ends = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(number)))])
            texts = list(number)
            digests = np.fromiter((xxhash.xxh3_64_intdigest(t) & mask for t in texts), np.uint64, len(texts)).view(np.int64)
            names = pa.array(sources, pa.string())
            for at in range(0, len(texts), SLICE):
                part = slice(at, min(at + SLICE, len(texts)))
                cut = slice(ends[part.start], ends[part.stop])
                lists = pa.array(ends[part.start:part.stop + 1] - cut.start, pa.int32())
                values = [names.take(pa.array(columns[0][cut])), pa.array(columns[1][cut]), pa.array(columns[2][cut])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (part.stop - at), pa.string()), pa.array(digests[part]),
                     pa.array(texts[part], pa.binary()).cast(pa.string())]
                    + [pa.ListArray.from_arrays(lists, v) for v in values],
                    ["lang", "digest", "term", "sources", "counts", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0
        for batch in batches:
            keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            for key, text in zip(keys, raw_texts(batch.column("text"))):
                n, d = held.setdefault(key, (Counter(), Counter()))
                size -= len(n)
                seen: set[bytes] = set()
                for terms in term_lists(text):
                    n.update(terms)
                    seen.update(terms)
                d.update(seen)
                size += len(n)
                if size >= HELD:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    text = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return text.mapInArrow(
        run, "lang string, digest bigint, term string, sources array<string>, counts array<bigint>, docs array<bigint>")


def cells(rows: DataFrame, key: list[str], min_docs: int) -> DataFrame:
    """Per key and source: n. Keys of enough documents only; ``lang_n`` is n over all sources.

    Rows are dealt by key while they still hold all sources of a task; the sums then stay where they are.
    """
    each = rows.select(*key, "sources", "counts", "docs").repartition(*key).select(
        *key, F.explode(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n"), F.col("docs").alias("d"))))
    sums = each.groupBy(*key, "col.source").agg(F.sum("col.n").alias("n"), F.sum("col.d").alias("d"))
    whole = Window.partitionBy(*key)
    sums = sums.withColumns({"lang_n": F.sum("n").over(whole), "lang_d": F.sum("d").over(whole)})
    return sums.where(F.col("lang_d") >= min_docs).drop("d", "lang_d")


def kept_terms(partial: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Cells (lang, digest, part, source, n, lang_n) of all kept terms, and their texts (lang, digest, part, term)."""
    key = ["lang", "digest"]
    found = land(cells(partial, key, min_docs).withColumn("part", F.lit(0)), "cells")
    texts = partial.select(*key, "term").join(found.select(*key).distinct(), key, "left_semi")
    texts = land(texts.groupBy(*key).agg(F.min("term").alias("term"), F.max("term").alias("last")), "texts")
    names = texts.select(*key, F.lit(0).alias("part"), "term")
    clashes = texts.where(F.col("term") != F.col("last")).select(*key)
    if clashes.isEmpty():
        return found, names
    apart = cells(partial.join(clashes, key, "left_semi"), [*key, "term"], min_docs)
    apart = apart.withColumn("part", F.dense_rank().over(Window.partitionBy(*key).orderBy("term")))
    apart = land(apart, "apart")
    found = found.join(clashes, key, "left_anti").unionByName(apart.drop("term"))
    names = names.join(clashes, key, "left_anti").unionByName(apart.select(*key, "part", "term").distinct())
    return land(found, "cells"), land(names, "texts")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exact for all counts."""
    whole = F.lit(1_000_000_000).cast("decimal(18,0)") * (count + 2).cast("decimal(19,0)")
    return (F.call_function("div", whole, (total + 2 * terms).cast("decimal(20,0)")) + 1).cast("bigint")


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def groups_of(docs: DataFrame, found: DataFrame, names: DataFrame) -> DataFrame:
    """Per (lang, source): total, lang_total, terms, place (number within the language, from 0), and tiles."""
    key = ["lang", "source"]
    every = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in key)).distinct()
    sums = found.groupBy(*key).agg(F.sum("n").alias("total"))
    terms = names.groupBy("lang").agg(F.count("*").alias("terms"))
    whole = Window.partitionBy("lang")
    return every.join(sums, key, "left").join(terms, "lang", "left").fillna(0, ["total", "terms"]).select(
        *key, "total", "terms", F.sum("total").over(whole).alias("lang_total"),
        (F.row_number().over(whole.orderBy("source")) - 1).alias("place"),
        F.ceil(F.count("*").over(whole) / TILE).cast("int").alias("tiles"))


def telling_terms(found: DataFrame, names: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """Each group's terms that it gives more than its language does, up to rank ``top``."""
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    each = found.join(groups, ["lang", "source"]).select("lang", "source", "digest", "part", p.alias("p"), q.alias("q"))
    each = each.where("p > q").withColumn("value", distance(F.col("p"), F.col("q"))).drop("p", "q")
    within = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # all that tie with the last rank stay until their texts are known
    first = each.withColumn("rank", F.rank().over(within)).where(F.col("rank") <= top).drop("rank")
    texts = first.join(names, ["lang", "digest", "part"]).withColumnRenamed("term", "item")
    ranked = texts.withColumn("rank", F.row_number().over(within.orderBy(F.desc("value"), "item")))
    return ranked.where(F.col("rank") <= top).select(
        "lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def block_sums(tile: int) -> Callable[[pa.Table], pa.Table]:
    """Turns a block into, for all pairs of sources of its two tiles: the sum over its terms, how many terms, and what a
    term counts that both lack."""

    def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x - y) * (x - y) // (x + y)

    def run(block: pa.Table) -> pa.Table:
        place, p, part, digest = (block.column(c).to_numpy() for c in ("place", "p", "part", "digest"))
        lang, left, right = (block.column(c)[0].as_py() for c in ("lang", "left", "right"))
        present = part >= 0
        terms, row = np.unique(np.stack([digest[present], part[present].astype(np.int64)]), axis=1, return_inverse=True)
        row, n = row.reshape(-1), terms.shape[1]
        sides = []
        for number in (left, right):
            sources = np.flatnonzero(~present & (place // tile == number))
            sources = sources[np.argsort(place[sources])]
            matrix = np.tile(p[sources], (n, 1))
            of = place[present] // tile == number
            matrix[row[of], np.searchsorted(place[sources], place[present][of])] = p[present][of]
            sides.append((place[sources], matrix, p[sources]))
        (a, matrix_a, none_a), (b, matrix_b, none_b) = sides
        sums = np.array([apart(matrix_a[:, [k]], matrix_b).sum(axis=0) for k in range(len(a))]).reshape(len(a), len(b))
        lacking = apart(none_a[:, None], none_b[None, :])
        x, y = np.nonzero(a[:, None] != b[None, :])
        ways = [(a[x], b[y])] if left == right else [(a[x], b[y]), (b[y], a[x])]
        rows = len(x) * len(ways)
        return pa.table({
            "lang": pa.array([lang] * rows, pa.string()),
            "place": np.concatenate([w[0] for w in ways]).astype(np.int32),
            "other": np.concatenate([w[1] for w in ways]).astype(np.int32),
            "value": np.tile(sums[x, y], len(ways)).astype(np.int64), "seen": np.full(rows, n, np.int64),
            "lacking": np.tile(lacking[x, y], len(ways)).astype(np.int64)})

    return run


def source_pairs(found: DataFrame, groups: DataFrame) -> DataFrame:
    """How far every other source of the language is from a source."""
    blocks = F.floor(F.col("terms") * TILE / CELLS + 1).cast("bigint")
    tile = F.floor(F.col("place") / TILE).cast("int")
    present = found.join(groups, ["lang", "source"]).select(
        "lang", "digest", "part", "place", "tiles", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        F.pmod("digest", blocks).alias("block"))
    # one row per source and block says what a lacking term counts, and that the source is there
    lacking = groups.select(
        "lang", F.lit(0).cast("bigint").alias("digest"), F.lit(-1).alias("part"), "place", "tiles",
        F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(1).alias("p"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("block"))
    each = present.unionByName(lacking).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "lang", "block", F.least(tile, "with").alias("left"), F.greatest(tile, "with").alias("right"),
        "digest", "part", "place", "p")
    sums = each.groupBy("lang", "block", "left", "right").applyInArrow(
        block_sums(TILE), "lang string, place int, other int, value bigint, seen bigint, lacking bigint")
    sums = sums.groupBy("lang", "place", "other").agg(
        F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("lacking").alias("lacking"))
    named = sums.join(groups.select("lang", "place", "source", "terms"), ["lang", "place"]).join(
        groups.select("lang", F.col("place").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    value = F.col("value") + (F.col("terms") - F.col("seen")) * F.col("lacking")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn(
        "rank", F.row_number().over(order))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, bits: int = BITS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank.

    ``bits`` narrows the digests; results do not depend on it.
    """
    found, names = kept_terms(land(counted(docs, bits), "counts"), min_docs)
    groups = land(groups_of(docs, found, names), "groups")
    return source_pairs(found, groups).unionByName(telling_terms(found, names, groups, top))
