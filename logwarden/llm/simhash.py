"""Near-duplicate documents by SimHash fingerprints and deletion-variant signatures.

Fingerprints of 64 bits are linked when they differ in at most two bits. Cut into two
halves, either one half differs in at most one bit, or the other does. Each
fingerprint is indexed under the first half as it is and under the 32 variants of it
with one bit wiped out, and under the second half as it is: a pair whose first halves
differ in at most one bit meets in the first index, and any other pair within two bits
has equal second halves. In a wildcard variant only fingerprints with the wiped bit
unset meet those with it set, so that pairs with equal halves meet once, not 32 times.

Rows never meet rows: equal fingerprints are one class, and only distinct
fingerprints are joined. Large key groups are split by adaptive skew joins (both
sides of the sort-merge join come straight from their exchanges). No cap on groups.

Defined cases: null, empty and blank texts have fingerprint zero, linked like any
other. Repeated rows are one class. A null ``doc_id`` never names a component unless
all its rows have null ids. Extra columns are ignored by ``near_duplicates`` and kept
by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from logwarden.llm.components import components
from logwarden.llm.rows import raw_texts, spare, type_of
from logwarden.sources.landing import land, shared_folder

SEED = 42
SHINGLE = 3
STRIDE = 1 << 16


def shingles(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The runs of ``size`` words joined by spaces, in lists of bounded length.

    ``bytes.lower`` lowers A-Z only and ``bytes.split`` cuts at 0x20 and 0x09-0x0D.
    """
    words = text.lower().split()
    if 0 < len(words) < size:
        yield [b" ".join(words)]
    for k in range(0, len(words) - size + 1, STRIDE):
        part = words[k : k + STRIDE + size - 1]
        joined = b" ".join(part)
        lengths = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
        ends = np.cumsum(lengths + 1) - 1
        begins = (ends - lengths)[: len(part) - size + 1].tolist()
        yield [joined[a:b] for a, b in zip(begins, ends[size - 1 :].tolist())]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The unsigned fingerprint: a bit is set if it is in over half of the shingles' hashes."""
    count, total = np.zeros(64, np.int64), 0
    digest = xxhash.xxh64_intdigest
    for part in shingles(text, size):
        hashes = np.array([digest(x, SEED) for x in part], dtype=">u8")
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(part)
    return int(np.packbits(2 * count > total).view(">u8")[0]) if total else 0


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp) per row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x, size) for x in raw_texts(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(prints.view(np.int64))],
                ["doc_id", "text_hash", "fp"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, text_hash bigint, fp bigint")


def signatures(prints: DataFrame) -> DataFrame:
    """(key, at, bit, fp): 34 index keys for each fingerprint.

    ``at`` is the wiped bit of the first half, 32 for the whole first half, 33 for
    the whole second half; ``bit`` tells whether the wiped bit was set.
    """
    high = "(shiftrightunsigned(fp, 32))"
    wiped = "shiftleft(1L, cast(at as int))"
    return (
        prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(33))).alias("at"))
        .select(
            "fp", "at",
            F.expr(f"case when at < 32 then {high} & ~{wiped} when at = 32 then {high} else fp & 4294967295 end"
                   " + shiftleft(cast(at as bigint), 32)").alias("key"),
            F.expr(f"at < 32 and ({high} & {wiped}) <> 0").alias("bit"),
        )
    )


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that differ in at most two bits, each pair once."""
    if not 0 <= distance <= 2:
        raise ValueError("two halves find up to two differing bits")
    signed = signatures(prints)
    left = signed.where("at >= 32 or not bit").select("key", "at", F.col("fp").alias("a"))
    right = signed.where("at >= 32 or bit").select("key", F.col("fp").alias("b"))
    apart = F.bit_count(F.expr("a ^ b"))
    near_high = F.bit_count(F.expr("shiftrightunsigned(a ^ b, 32)")) <= 1
    once = F.when(F.col("at") < 32, F.lit(True)).when(F.col("at") == 32, F.expr("a < b")).otherwise(
        F.expr("a < b") & ~near_high)
    return left.hint("merge").join(right, "key").where((apart <= distance) & once).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = 2) -> DataFrame:
    """Per row: doc_id, text_hash, fp, component_id (smallest doc_id of its group), root.

    ``root`` is a fingerprint that stands for the group, also where ids are null.
    """
    shared_folder(docs.sparkSession)
    rows = land(fingerprints(docs, size), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(classes.select("fp"), distance))
    if found is None:
        named = classes.select("fp", F.col("least").alias("component_id"), F.col("fp").alias("root"))
    else:
        rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")).checkpoint()
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        named = rooted.select("fp", "root").join(least, "root")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def deduplicate(docs: DataFrame, size: int = SHINGLE, distance: int = 2) -> DataFrame:
    """One row of each group, all columns kept: the one with the smallest doc_id.

    Null ids come last; among rows of one id the text's hash decides, and of rows
    equal in both, one stays, chosen by a hash of all columns. Rows are found again by id and text hash, so repeated
    reads of ``docs`` need not give rows in one order.
    """
    groups = near_duplicates(docs, size, distance)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash"))
    copies = groups.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    best = copies.groupBy("root").agg(F.min(F.struct(rank.alias("at"), F.col("n"))).alias("best")).select(
        F.col("best.at.doc_id").alias("keep_id"), F.col("best.at.text_hash").alias("keep_hash"),
        F.col("best.n").alias("n"))
    best = land(best, "kept")
    hashed = spare(docs, "hash")
    keyed = docs.withColumn(hashed, F.xxhash64("text"))
    match = keyed["doc_id"].eqNullSafe(best["keep_id"]) & (keyed[hashed] == best["keep_hash"])
    single = keyed.join(best.where("n = 1"), match, "left_semi")
    # which of the rows of one id and text stays is decided by a hash of all their columns
    rest = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    repeated = keyed.join(best.where("n > 1"), match, "left_semi").groupBy("doc_id", hashed).agg(
        F.min_by(F.struct(*docs.columns), F.xxhash64(*rest)).alias("row")).select("row.*")
    return single.drop(hashed).unionByName(repeated)
