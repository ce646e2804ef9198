"""Stream twin of the rule cascade: lines in, windowed findings out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators import rules as R
from ..operators.ingest import parse_access
from ..operators.mask import actor_key
from ..operators.noise import with_noise
from ..options import Options
from ..sources.landing import exists, fresh_folder

INTERVAL = "30 seconds"  # default flush interval of the micro-batches


def signal_rows(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """Parsed signal rows with actor."""
    signal = with_noise(parse_access(lines), options.noise).where(~F.col("is_noise"))
    return signal.withColumn("actor", actor_key())


def path_counts(
    rows: DataFrame,
    options: Options = Options(),
    window: str = "5 minutes",
    slide: str | None = None,
    delay: str = "10 minutes",
) -> DataFrame:
    """The cascade's counts per (window, source, actor, path). State is one row per key.

    Rules take rows by priority, as in ``operators.rules``, with the window as part of the scope.
    """
    rules = R.default_rules(options.rules)
    marked = R.candidates(rows, rules).withWatermark("ts", delay)
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return R.path_profile(marked.withColumn("window", span), rules, SCOPE)


SCOPE = ("window", "source_label")
PATH_KEYS = (*SCOPE, "actor", "path", "user_agent")


def window_counts(paths: DataFrame, options: Options = Options()) -> DataFrame:
    """Per (window, source, actor) which rules are reached, and what each counts.

    Exact on tables and on append streams. An update stream keeps ``path_counts``
    with ``write_keyed`` and counts what ``latest`` reads.
    """
    return R.actor_profile(paths, R.default_rules(options.rules), SCOPE)


def window_findings(counts: DataFrame, options: Options = Options()) -> DataFrame:
    """One row per (window, source, actor, rule) whose threshold is reached."""
    rules = R.default_rules(options.rules)
    found = F.array_compact(F.array(*[
        F.when(
            F.col(f"q_{r.name}"),
            F.struct(
                F.lit(r.name).alias("rule"), F.lit(r.category).alias("category"),
                F.lit(r.severity).alias("severity"), F.col(f"n_{r.name}").alias("n"),
            ),
        )
        for r in rules
    ]))
    # found_at carries the watermark on to a later stateful step
    timed = counts.withColumn(
        "found_at",
        F.window_time("window") if counts.isStreaming else F.col("window.end"),
    )
    return timed.withColumn("f", F.explode(found)).select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "found_at", "source_label", "actor", "f.*",
    )


def session_counts(
    rows: DataFrame, keys: Sequence[str], gap: str, delay: str = "10 minutes"
) -> DataFrame:
    """Stream twin of ``operators.activity.sessions``."""
    return (
        rows.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
        .select(*keys, F.col("session_window.start").alias("start"), "last", "n")
    )


def first_per_actor(findings: DataFrame) -> DataFrame:
    """Drop repeats of a finding (rule, source, actor) within the stream's watermark delay.

    For append mode: findings of closed windows.
    """
    return findings.dropDuplicatesWithinWatermark(["rule", "source_label", "actor"])


def write_keyed(stream: DataFrame, table: str, checkpoint: str, once: bool = False):
    """Append every micro-batch's rows to ``table`` under its batch number.

    A replayed batch overwrites its own folder, so a restart adds nothing twice.
    Updates of one key are resolved by ``latest``.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_no={number}")

    writer = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(put)
    )
    return writer.trigger(availableNow=True).start() if once else writer.trigger(
        processingTime=INTERVAL).start()


def latest(
    spark: SparkSession, table: str, keys: Sequence[str], schema: StructType | None = None
) -> DataFrame:
    """Last update of every key written by ``write_keyed``; with ``schema``, no rows if no batch was written.

    For streams that end. One that goes on needs ``keyed.KeyedTable``, whose files stay few.
    """
    if schema is not None and not exists(spark, table):
        return spark.createDataFrame([], schema)
    rows = spark.read.parquet(table)
    values = [c for c in rows.columns if c not in keys and c != "batch_no"]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), "batch_no").alias("_v"))
        .select(*keys, "_v.*")
    )


def run_once(
    spark: SparkSession, stream: DataFrame, keys: Sequence[str], name: str = "stream"
) -> DataFrame:
    """Run a stream over what is there and return its final rows."""
    table, checkpoint = fresh_folder(spark, name), fresh_folder(spark, f"{name}-state")
    write_keyed(stream, table, checkpoint, once=True).awaitTermination()
    return latest(spark, table, keys, stream.schema)
