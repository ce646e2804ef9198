"""Token ids on disk as patched frame-of-reference blocks.

A file is a run of ids in order of its documents, cut into chunks without regard to documents; a
chunk is a row of a table and holds up to ``CHUNK`` ids in blocks of ``BLOCK``. A block stores

    minimum (uint32) | width (uint8) | 0 | exceptions (uint16)
    the low ``width`` bits of every id less the minimum
    places of the exceptions (uint8 each) | what they have above ``width`` bits (uint32 each)

The width is that of the block's ``PERCENTILE`` value; larger ones are the exceptions. All numbers
are little-endian. ``starts`` gives the first byte of each block, so any block can be read by
itself (``ids_between``). A chunk also names the documents that begin in it and their lengths, how
many ids at its front belong to an earlier document (``head``), and how many of its last document
come in later chunks (``rest``).

Documents are dealt to files by ranges of the id; rows with the same id may be parted, so that no id
is too common for one task. Text is shuffled once, ids never: a document's checksum is put together
from those of its pieces, as the CRC of a whole is the exclusive or of its pieces' CRCs, each shifted
by the bytes after it.

Defined cases: null and empty texts are the end id alone. Null ids come first, repeated rows are
documents each. Strings of special tokens are ordinary text. Empty tables make no files. Extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from logwarden.llm.rows import texts, type_of
from logwarden.llm.tokens import byte_tokenizer, vocabulary_path
from logwarden.sources.landing import land

VOCABULARY = "byte_bpe_50k.json"
#: The id that closes each document.
END = 0
BLOCK = 256
CHUNK = 512 * BLOCK
PERCENTILE = 90
HEADER = np.dtype([("low", "<u4"), ("width", "u1"), ("zero", "u1"), ("exceptions", "<u2")])
#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def encode(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """The blocks of some ids, and where each begins."""
    count = -(-len(ids) // BLOCK)
    if not count:
        return b"", np.zeros(0, np.uint32)
    table = np.full(count * BLOCK, ids[-1], np.uint32)
    table[:len(ids)] = ids
    table = table.reshape(count, BLOCK)
    head = np.zeros(count, HEADER)
    head["low"] = table.min(axis=1)
    above = table - head["low"][:, None]
    rank = min(BLOCK - 1, BLOCK * percentile // 100)
    width = bit_lengths(np.partition(above, rank, axis=1)[:, rank])
    high = (above.astype(np.uint64) >> width.astype(np.uint64)[:, None]).astype(np.uint32)
    row, place = np.nonzero(high)
    number = np.bincount(row, minlength=count)
    head["width"], head["exceptions"] = width, number
    packed_end = HEADER.itemsize + BLOCK // 8 * width
    sizes = packed_end + 5 * number
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(sizes.sum(), np.uint8)
    out[starts[:, None] + np.arange(HEADER.itemsize)] = head.view(np.uint8).reshape(count, -1)
    for w in np.unique(width[width > 0]):
        of = np.flatnonzero(width == w)
        bits = (above[of][:, :, None] >> np.arange(w, dtype=np.uint32)).astype(np.uint8) & 1
        packed = np.packbits(bits.reshape(len(of), -1), axis=1, bitorder="little")
        out[starts[of][:, None] + HEADER.itemsize + np.arange(packed.shape[1])] = packed
    if len(row):
        lists = starts[row] + packed_end[row]
        order = np.arange(len(row)) - (np.cumsum(number) - number)[row]
        out[lists + order] = place
        at = lists + number[row] + 4 * order
        out[at[:, None] + np.arange(4)] = high[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), starts.astype(np.uint32)


def decode(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts``, one row for each block."""
    raw, starts = np.frombuffer(data, np.uint8), starts.astype(np.int64)
    if not len(starts):
        return np.zeros((0, BLOCK), np.uint32)
    head = np.ascontiguousarray(raw[starts[:, None] + np.arange(HEADER.itemsize)]).view(HEADER)[:, 0]
    width, number = head["width"].astype(np.int64), head["exceptions"].astype(np.int64)
    above = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        of = np.flatnonzero(width == w)
        packed = raw[starts[of][:, None] + HEADER.itemsize + np.arange(BLOCK // 8 * w)]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(of), BLOCK, w)
        value = np.zeros((len(of), BLOCK), np.uint32)
        for k in range(w):
            value |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
        above[of] = value
    if number.sum():
        row = np.repeat(np.arange(len(starts)), number)
        lists = starts[row] + HEADER.itemsize + BLOCK // 8 * width[row]
        order = np.arange(len(row)) - (np.cumsum(number) - number)[row]
        at = lists + number[row] + 4 * order
        high = np.ascontiguousarray(raw[at[:, None] + np.arange(4)]).view("<u4")[:, 0]
        above[row, raw[lists + order]] |= (high.astype(np.uint64) << width[row].astype(np.uint64)).astype(np.uint32)
    return above + head["low"][:, None]


def times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of the CRC, both with the highest bit for x^0."""
    product = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            product ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return product


def shifted(crc: int, size: int) -> int:
    """What a piece's CRC adds to that of a whole in which ``size`` bytes follow it."""
    factor, power, bits = 1 << 31, 1 << 30, 8 * size
    while bits:
        if bits & 1:
            factor = times(factor, power)
        power, bits = times(power, power), bits >> 1
    return times(factor, crc)


def write(docs: DataFrame, path: str | None = None, end: int = END, chunk: int = CHUNK) -> DataFrame:
    """Chunks of files in ascending order of doc_id: (file, chunk) is the order of all ids."""
    if chunk % BLOCK:
        raise ValueError("a chunk is whole blocks")
    path = path or vocabulary_path(VOCABULARY)
    kind = type_of(docs, "doc_id")
    layout = (f"file int, chunk int, first bigint, n int, ordinal bigint, head bigint, rest bigint, "
              f"doc_ids array<{kind}>, lengths array<bigint>, starts binary, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, closing = byte_tokenizer(path), np.array([end], np.uint32)
        file, number, first, ordinal = TaskContext.get().partitionId(), 0, 0, 0
        waiting: list[np.ndarray] = []
        size = head = 0
        names: list = []
        lengths: list[int] = []
        id_type = None

        def chunks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, first, ordinal, waiting, size, head, names, lengths
            ids = np.concatenate(waiting) if waiting else closing[:0]
            at = 0
            while size - at >= chunk or last and size > at:
                part = ids[at:at + chunk]
                ends = head + np.cumsum([0, *lengths])
                begun = int(np.searchsorted(ends[:-1], len(part)))
                rest = int(ends[begun]) - len(part)
                data, starts = encode(part)
                yield pa.RecordBatch.from_arrays([
                    pa.array([file], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()),
                    pa.array([len(part)], pa.int32()), pa.array([ordinal], pa.int64()),
                    pa.array([min(head, len(part))], pa.int64()), pa.array([max(rest, 0)], pa.int64()),
                    pa.array([names[:begun]], pa.list_(id_type)), pa.array([lengths[:begun]], pa.list_(pa.int64())),
                    pa.array([starts.astype("<u4").tobytes()], pa.binary()), pa.array([data], pa.binary()),
                ], ["file", "chunk", "first", "n", "ordinal", "head", "rest", "doc_ids", "lengths", "starts", "data"])
                names, lengths, head = names[begun:], lengths[begun:], max(rest, 0)
                number, first, ordinal, at = number + 1, first + len(part), ordinal + begun, at + len(part)
            waiting, size = [ids[at:]], size - at

        for batch in batches:
            id_type = batch.column("doc_id").type
            for name, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text"))):
                waiting += [tokenizer.ids(text), closing]
                names.append(name)
                lengths.append(len(waiting[-2]) + 1)
                size += lengths[-1]
                if size >= 4 * chunk:
                    yield from chunks(False)
        if size:
            yield from chunks(True)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    order = ["doc_id", "__text", "__row"]
    rows = rows.withColumns({"__text": F.xxhash64("text"), "__row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return rows.mapInArrow(run, layout)


def documents(written: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    kind = written.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.drop_columns(["data", "starts"]).to_pylist()):
                ids = decode(batch.column("data")[k].as_py(), np.frombuffer(batch.column("starts")[k].as_py(), "<u4"))
                ids, head, n = ids.reshape(-1)[:row["n"]].astype("<u4"), row["head"], len(row["lengths"])
                begins = head + np.cumsum([0, *row["lengths"]])
                after = [0] * n
                if n:
                    after[-1] = row["rest"]
                pieces = [(row["ordinal"] + j, name, row["first"] + int(begins[j]), row["lengths"][j],
                           shifted(zlib.crc32(ids[begins[j]:begins[j + 1]]), 4 * after[j]), after[j] == 0)
                          for j, name in enumerate(row["doc_ids"])]
                if head:
                    later = row["rest"] if not n else 0
                    pieces.append((row["ordinal"] - 1, None, None, None, shifted(zlib.crc32(ids[:head]), 4 * later), False))
                columns = list(zip(*pieces))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]] * len(pieces), pa.int32()), pa.array(columns[0], pa.int64()),
                     pa.array(columns[1], batch.schema.field("doc_ids").type.value_type)]
                    + [pa.array(c, pa.int64()) for c in columns[2:5]] + [pa.array(columns[5], pa.bool_())],
                    ["file", "ordinal", "doc_id", "start", "n_tokens", "ids_crc32", "whole"])

    # landed, as whole documents and parted ones read it: the files are decoded once
    pieces = land(written.mapInArrow(
        run, f"file int, ordinal bigint, doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint, whole boolean"), "pieces")
    joined = pieces.where(~F.col("whole")).groupBy("file", "ordinal").agg(
        F.max("doc_id").alias("doc_id"), F.max("start").alias("start"), F.max("n_tokens").alias("n_tokens"),
        F.bit_xor("ids_crc32").alias("ids_crc32"))
    found = pieces.where("whole").drop("whole").unionByName(joined)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = written.groupBy("file").agg(F.sum("n").alias("ids")).select(
        "file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return found.join(files, "file").select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def ids_between(written: DataFrame, file: int, begin: int, end: int) -> DataFrame:
    """The ids at places ``begin`` to ``end`` (exclusive) of a file, as (place, id); only their blocks are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, starts, data in zip(*(batch.column(c).to_pylist() for c in ("first", "n", "starts", "data"))):
                low, high = max(begin - first, 0), min(end - first, n)
                skip = low // BLOCK
                blocks = np.frombuffer(starts, "<u4")[skip:-(-high // BLOCK)]
                ids = decode(data, blocks).reshape(-1)[low - skip * BLOCK:high - skip * BLOCK]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(first + low, first + high)), pa.array(ids.astype(np.int64))], ["place", "id"])

    inside = (F.col("file") == file) & (F.col("first") < end) & (F.col("first") + F.col("n") > begin)
    return written.where(inside).select("first", "n", "starts", "data").mapInArrow(run, "place bigint, id bigint")


def stored(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write all documents to files in the shared folder, and read them back."""
    return documents(land(write(docs, path), "ids"))
