"""Token counts of documents in flat token files that have no index.

A token file is ids end to end; an end-of-document id closes each document. Files are
kept as a table of blocks (file, block, data): runs of little-endian ids of a fixed size, cut
without regard to documents. Each block is searched for the end id as one array. Its summary
(ids, ends, ids after its last end) goes through a prefix scan over the file's blocks: what a
block's first document already had, and how many documents ended before. Blocks are then
turned into document lengths with that carry.

The scan has two levels, groups of ``GROUP`` blocks and blocks within a group, so that no
task sees all blocks of a large file, only one summary per group of it. The ids are read once
and never shuffled; only the summaries and the places of the ends are.

Defined cases: null and empty texts are documents of the end id alone. Ids after a file's last end
are an unfinished document (``complete`` false). Empty blocks are allowed, missing ones are
an error of the writer. Empty tables have no files. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from logwarden.llm.rows import texts
from logwarden.llm.tokens import vocabulary_path, word_tokenizer
from logwarden.sources.landing import land

VOCABULARY = "word_bpe_49k.json"
END = "<|endoftext|>"
BLOCK = 1 << 18
GROUP = 1024
WIDTHS = {2: "<u2", 4: "<u4"}


def flat_files(docs: DataFrame, path: str | None = None, block: int = BLOCK, width: int = 2) -> DataFrame:
    """Token files, one for each partition of the documents in order of id, as (file, block, data)."""
    path = path or vocabulary_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        end = np.array([tokenizer.whole.token_to_id(END)], np.uint32)
        if tokenizer.whole.get_vocab_size() > 1 << 8 * width:
            raise ValueError("ids do not fit the width")
        file, number, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, parts, size
            ids = np.concatenate(parts) if parts else end[:0]
            stop = len(ids) if last else len(ids) // block * block
            for at in range(0, stop, block):
                data = ids[at:min(at + block, stop)].astype(WIDTHS[width]).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([data], pa.binary())],
                    ["file", "block", "data"])
                number += 1
            parts, size = [ids[stop:]], len(ids) - stop

        for batch in batches:
            for text in texts(batch.column("text")):
                parts += [tokenizer.ids(text), end]
                size += len(parts[-2]) + 1
                if size >= 4 * block:
                    yield from blocks(False)
        yield from blocks(True)

    rows = docs.selectExpr("doc_id", "cast(text as string) as text").sortWithinPartitions("doc_id", "text")
    return rows.select("text").mapInArrow(run, "file bigint, block bigint, data binary")


def read_files(spark: SparkSession, paths: list[str], block: int = BLOCK, width: int = 2) -> DataFrame:
    """Flat files of ids as blocks. Spark reads a file whole, up to its limit of 2 GiB for one file."""
    size = block * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = content.as_py()
                if len(data) % width:
                    raise ValueError(f"{path} ends within an id")
                for number, at in enumerate(range(0, len(data), size)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]), pa.array([number], pa.int64()), pa.array([data[at:at + size]], pa.binary())],
                        ["file", "block", "data"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, "file string, block bigint, data binary")


def scanned(files: DataFrame, end: int, width: int) -> DataFrame:
    """(file, block, ids, ends, tail, places): how many ids and ends a block has, ids after its last end, all ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, places = [], []
            for data in batch.column("data"):
                ids = np.frombuffer(data.as_py() or b"", dtype=WIDTHS[width])
                sizes.append(len(ids))
                places.append(np.flatnonzero(ids == end))
            tails = [n - int(at[-1]) - 1 if len(at) else n for n, at in zip(sizes, places)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(sizes, pa.int64()),
                 pa.array([len(at) for at in places], pa.int64()), pa.array(tails, pa.int64()),
                 pa.array(places, pa.list_(pa.int64()))], ["file", "block", "ids", "ends", "tail", "places"])

    kind = files.schema["file"].dataType.simpleString()
    return files.select("file", "block", "data").mapInArrow(
        run, f"file {kind}, block bigint, ids bigint, ends bigint, tail bigint, places array<bigint>")


def carries(blocks: DataFrame) -> DataFrame:
    """(file, block, position, documents, carry): ids and ends before the block, and ids since the last of these ends.

    The carry is the ids before the block less those up to the last end, which is the running
    maximum of (ids before a block + ids of it - its tail) over blocks with an end.
    """
    group = F.floor(F.col("block") / GROUP).cast("bigint")
    grouped = blocks.withColumn("group", group)
    inside = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda name, window: F.coalesce(F.sum(name).over(window), F.lit(0))
    local = grouped.select("*", before("ids", inside).alias("ids0"), before("ends", inside).alias("ends0"))
    local = local.withColumn("cut", F.when(F.col("ends") > 0, F.col("ids0") + F.col("ids") - F.col("tail")))
    local = local.withColumn("cut0", F.max("cut").over(inside))
    sums = local.groupBy("file", "group").agg(
        F.sum("ids").alias("g_ids"), F.sum("ends").alias("g_ends"), F.max("cut").alias("g_cut"))
    across = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("*", before("g_ids", across).alias("base"), before("g_ends", across).alias("base_ends"))
    sums = sums.withColumn("last_cut", F.max(F.col("base") + F.col("g_cut")).over(across)).select(
        "file", "group", "base", "base_ends", "last_cut")
    position = F.col("base") + F.col("ids0")
    cut = F.coalesce(F.col("base") + F.col("cut0"), F.col("last_cut"), F.lit(0))
    return local.join(sums, ["file", "group"]).select(
        "file", "block", position.alias("position"), (F.col("base_ends") + F.col("ends0")).alias("documents"),
        (position - cut).alias("carry"))


def count_tokens(files: DataFrame, end: int, width: int = 2) -> DataFrame:
    """Per document: file, document (from 0), start (ids before it in the file), n_tokens (without the end id), complete."""
    blocks = land(scanned(files, end, width), "blocks")
    known = carries(blocks.drop("places"))
    found = blocks.select("file", "block", "places", "tail").join(known, ["file", "block"])
    begins = F.concat(F.array(-F.col("carry")), F.transform("places", lambda p: p + 1))
    each = found.where(F.size("places") > 0).select(
        "file", "position", "documents",
        F.posexplode(F.arrays_zip(F.slice(begins, 1, F.size("places")).alias("begin"), F.col("places").alias("end"))))
    whole = each.select(
        "file", (F.col("documents") + F.col("pos")).alias("document"), (F.col("position") + F.col("col.begin")).alias("start"),
        (F.col("col.end") - F.col("col.begin")).alias("n_tokens"), F.lit(True).alias("complete"))
    totals = blocks.groupBy("file").agg(F.max("block").alias("block"), F.sum("ids").alias("ids"), F.sum("ends").alias("all_ends"))
    after_last = F.when(F.size("places") > 0, F.col("tail")).otherwise(F.col("tail") + F.col("carry"))
    rest = found.join(totals, ["file", "block"]).select(
        "file", F.col("all_ends").alias("document"), (F.col("ids") - after_last).alias("start"),
        after_last.alias("n_tokens"), F.lit(False).alias("complete")).where("n_tokens > 0")
    return whole.unionByName(rest)


def corpus_token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write documents as flat files to the shared folder, and count what is in them."""
    path = path or vocabulary_path(VOCABULARY)
    files = land(flat_files(docs, path), "tokens")
    return count_tokens(files, word_tokenizer(path).whole.token_to_id(END))
