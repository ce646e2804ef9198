"""A table of the latest row per key that micro-batches update and readers see in one version.

Layout of the folder::

    snapshot-<version>-<id>/   one row per key, as of a version
    delta-<version>-<id>/      rows of a later update
    log/<version>.json         which of them make up a version

Data folders are written once, under a name of their own, and never changed. A version comes into being
by the rename of its log file, so a reader sees all of a batch or nothing of it, and a batch that
is replayed after it was committed changes nothing. After ``every`` updates the deltas are folded into a new
snapshot; folders that none of the last ``keep`` versions name are deleted. A table thus has at most
``every`` deltas, however long the stream runs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: The version in which a row was last written.
SEEN = "_version"


class KeyedTable:
    """``fold`` may drop rows when a snapshot is made (old windows, settled entries)."""

    def __init__(
        self, spark: SparkSession, folder: str, keys: Sequence[str], schema: T.StructType, *,
        every: int = 8, keep: int = 3, fold: Callable[[DataFrame], DataFrame] | None = None,
    ) -> None:
        self.spark, self.folder, self.keys, self.schema = spark, folder, list(keys), schema
        self.every, self.keep, self.fold = every, keep, fold
        java = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self._fs = java.getFileSystem(spark._jsc.hadoopConfiguration())

    # --- files ------------------------------------------------------------------

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        if not self._fs.exists(path):
            return []
        return [status.getPath().getName() for status in self._fs.listStatus(path)]

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("log") if n.endswith(".json") and n[:-5].isdigit())

    def _entry(self, version: int) -> dict:
        stream = self._fs.open(self._path("log", f"{version:012}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def version(self) -> dict:
        """What the newest version is made of."""
        known = self._versions()
        return self._entry(known[-1]) if known else {
            "version": 0, "done": -1, "done_in": 0, "snapshot": None, "deltas": []}

    def _commit(self, entry: dict) -> None:
        target = self._path("log", f"{entry['version']:012}.json")
        written = self._path("log", f".{uuid.uuid4().hex}")
        self._fs.mkdirs(self._path("log"))
        out = self._fs.create(written, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if not self._fs.rename(written, target):
            raise RuntimeError(f"version {entry['version']} was made by another writer")

    def _vacuum(self) -> None:
        known = self._versions()
        old, live = known[:-self.keep], known[-self.keep:]
        named = {n for v in live for n in self._folders(self._entry(v))}
        for name in self._names():
            if name.startswith(("snapshot-", "delta-")) and name not in named:
                self._fs.delete(self._path(name), True)
        for version in old:
            self._fs.delete(self._path("log", f"{version:012}.json"), False)

    @staticmethod
    def _folders(entry: dict) -> list[str]:
        return [n for n in [entry["snapshot"], *entry["deltas"]] if n]

    # --- rows -------------------------------------------------------------------

    def has(self, batch: int) -> bool:
        """Whether a numbered batch was committed. Numbers must grow."""
        return batch <= self.version()["done"]

    def put(self, rows: DataFrame, batch: int | None = None) -> bool:
        """Add rows, at most one per key. A batch with a number is added once: False if it was there before."""
        now = self.version()
        if batch is not None and batch <= now["done"]:
            return False
        version = now["version"] + 1
        name = f"delta-{version}-{uuid.uuid4().hex}"
        columns = [F.col(f.name).cast(f.dataType) for f in self.schema]
        rows.select(*columns, F.lit(version).cast("bigint").alias(SEEN)).write.parquet(f"{self.folder}/{name}")
        entry = now | {"version": version, "deltas": [*now["deltas"], name]}
        self._commit(entry if batch is None else entry | {"done": batch, "done_in": version})
        if len(entry["deltas"]) >= self.every:
            self.compact()
        return True

    def compact(self) -> None:
        """Fold all deltas into a new snapshot, as the next version."""
        now = self.version()
        if not now["deltas"]:
            return
        version = now["version"] + 1
        name = f"snapshot-{version}-{uuid.uuid4().hex}"
        rows = self._merged(now)
        (self.fold(rows) if self.fold else rows).write.parquet(f"{self.folder}/{name}")
        self._commit(now | {"version": version, "snapshot": name, "deltas": []})
        self._vacuum()

    def _merged(self, entry: dict) -> DataFrame:
        whole = T.StructType([*self.schema.fields, T.StructField(SEEN, T.LongType())])
        folders = [f"{self.folder}/{n}" for n in self._folders(entry)]
        if not folders:
            return self.spark.createDataFrame([], whole)
        rows = self.spark.read.schema(whole).parquet(*folders)
        if not entry["deltas"]:
            return rows
        values = [f.name for f in whole if f.name not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), SEEN).alias("_v")).select(
            *self.keys, "_v.*").select(*whole.names)

    def read(self) -> DataFrame:
        """The latest row of every key, in the version that is newest now."""
        return self._merged(self.version()).drop(SEEN)

    def changed(self) -> DataFrame:
        """The rows that the last numbered batch wrote."""
        now = self.version()
        return self._merged(now).where(F.col(SEEN) == now["done_in"]).drop(SEEN)
