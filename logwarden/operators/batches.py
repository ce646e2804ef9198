"""Fixed-size batches, rolling context and the texts built from them.

Everything collected here is bounded by construction: a batch holds at most
``size`` rows and a context at most ``context_rows``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..options import BatchOptions
from .ordering import running_rank, slice_of, with_halo


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def assign_batches(entries: DataFrame, options: BatchOptions = BatchOptions()) -> DataFrame:
    """Cut arrival order into batches of ``size`` inside each flush interval.

    Batches mix sources. Adds ``flush`` (interval start, seconds), ``batch_no``
    and ``batch_id``.
    """
    seconds = F.unix_seconds("ts")
    flushed = entries.withColumn(
        "flush", seconds - F.pmod(seconds, F.lit(options.interval_seconds))
    )
    ranked = running_rank(flushed, "seq", ["flush"], name="_rank")
    return (
        ranked.withColumn(
            "batch_no", F.call_function("div", F.col("_rank") - 1, F.lit(options.size))
        )
        .withColumn(
            "batch_id", F.concat_ws("-", F.col("flush").cast("string"),
                                    F.col("batch_no").cast("string"))
        )
        .drop("_rank")
    )


def dominant(values: Column, name: str) -> Column:
    """Most frequent value of a small array of structs; ties go to the first seen."""
    best = F.get(_counted(values, lambda r: r[name]), F.lit(0))["v"]
    return F.coalesce(best, F.lit(""))


def batch_rows(batched: DataFrame, *columns: str) -> DataFrame:
    """One row per batch with its rows, in order, as ``rows``."""
    return batched.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", *columns))).alias("rows")
    )


def batch_texts(batched: DataFrame, line: str = "sanitized_line") -> DataFrame:
    """Signal rows of each batch as text, with the batch's main source."""
    signal = batched.where(~F.col("is_noise"))
    rows = batch_rows(signal, F.col(line).alias("line"), "source_label")
    return rows.select(
        "batch_id",
        F.size("rows").alias("n_rows"),
        F.element_at("rows", 1)["seq"].alias("first_seq"),
        F.element_at("rows", -1)["seq"].alias("last_seq"),
        dominant(F.col("rows"), "source_label").alias("source_label"),
        F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("batch_text"),
    )


def rolling_context(
    entries: DataFrame,
    by: Sequence[str] = (),
    rows: int = 30,
    columns: Sequence[str] = ("ts", "actor", "method", "path", "status", "user_agent"),
    *,
    chunk: int = 10_000,
) -> DataFrame:
    """Each signal row with the last ``rows`` signal rows up to it, as ``context``.

    Positions are ranked without a global sort; frames run per chunk of
    positions, each with a halo of ``rows - 1`` from the chunk before, so a
    source that holds most of the data is spread over many tasks.
    """
    signal = entries.where(~F.col("is_noise"))
    ranked = running_rank(signal, "seq", by, name="position")
    spread = with_halo(ranked, "position", rows - 1, chunk)
    frame = (
        Window.partitionBy(*by, "_slice").orderBy("position").rowsBetween(-(rows - 1), 0)
    )
    # the frame runs over the halo rows too, so it comes before the filter
    rolled = spread.withColumn("context", F.collect_list(F.struct("seq", *columns)).over(frame))
    return rolled.where("_home").drop("_slice", "_home")


def batch_contexts(
    batched: DataFrame,
    options: BatchOptions = BatchOptions(),
    *,
    without: DataFrame | None = None,
    chunk: int = 10,
) -> DataFrame:
    """(batch_id, context): the context after the last signal row of each batch.

    Rows meet in short slices of positions, ``chunk`` contexts long with a halo of one. The position of each
    batch's last row is known before that, so a slice cuts out one context per batch that ends in it and no
    other. Batches in ``without`` (batch_id) get none.
    """
    columns = ("seq", "ts", "actor", "method", "path", "status", "user_agent")
    n = options.context_rows
    signal = batched.where(~F.col("is_noise")).select(*columns, "batch_id")
    ranked = running_rank(signal, "seq", name="position")
    ends = ranked.groupBy("batch_id").agg(F.max("position").alias("position"))
    if without is not None:
        ends = ends.join(without.select("batch_id"), "batch_id", "left_anti")
    ends = ends.groupBy(slice_of(F.col("position"), chunk * n).alias("_slice")).agg(
        F.collect_list(F.struct("position", "batch_id")).alias("ends"))
    row = F.struct("position", F.struct(*columns).alias("row"))
    slices = with_halo(ranked.drop("batch_id"), "position", n - 1, chunk * n).groupBy("_slice").agg(
        F.sort_array(F.collect_list(row)).alias("rows"))

    def cut(end: Column) -> Column:
        # positions have no gaps, so a row's place in its slice follows from its position
        i = (end["position"] - F.get("rows", F.lit(0))["position"] + 1).cast("int")
        inside = F.slice("rows", F.greatest(i - (n - 1), F.lit(1)), F.least(i, F.lit(n)))
        return F.struct(end["batch_id"].alias("batch_id"), F.transform(inside, lambda r: r["row"]).alias("context"))

    return slices.join(ends, "_slice").select(F.explode(F.transform("ends", cut)).alias("_c")).select("_c.*")


def _counted(rows: Column, value: Callable[[Column], Column]) -> Column:
    """Distinct values of small array ``rows`` as (neg, pos, v), most frequent first."""
    return bound(
        F.transform(rows, value),
        lambda values: F.array_sort(
            F.transform(
                F.array_distinct(values),
                lambda v, i: F.struct(
                    (-F.size(F.filter(values, lambda x: x == v))).alias("neg"),
                    i.alias("pos"),
                    v.alias("v"),
                ),
            )
        ),
    )


def _count(entry: Column) -> Column:
    return (-entry["neg"]).cast("string")


def _status_text(own: Column) -> Column:
    return F.array_join(
        F.transform(
            _counted(own, lambda r: r["status"]),
            lambda s: F.concat(s["v"].cast("string"), F.lit(":"), _count(s)),
        ),
        ", ",
    )


def _path_lines(own: Column, shared: Column) -> Column:
    """The five busiest paths of an actor; method and statuses are the actor's."""
    return F.transform(
        F.slice(_counted(own, lambda r: r["path"]), 1, 5),
        lambda p: F.concat(
            F.lit("  "), shared["method"], F.lit(" "), p["v"], F.lit(" -> "), _count(p),
            F.lit("x (status "), shared["statuses"], F.lit(")"),
        ),
    )


def _agent_lines(own: Column) -> Column:
    agents = F.array_sort(
        F.array_distinct(F.filter(F.transform(own, lambda r: r["user_agent"]), lambda u: u != ""))
    )
    return bound(
        F.slice(agents, 1, 3),
        lambda a: F.when(
            F.size(a) > 0,
            F.array(F.concat(F.lit("  User-Agent: "), F.array_join(a, ", ")), F.lit("")),
        ).otherwise(F.array(F.lit(""))),
    )


def _grouped(rows: Column, value: Callable[[Column], Column]) -> Column:
    """As ``_counted``, each value with its rows as ``own``."""
    return F.array_sort(
        F.transform(
            F.array_distinct(F.transform(rows, value)),
            lambda v, i: bound(
                F.filter(rows, lambda r: value(r) == v),
                lambda own: F.struct((-F.size(own)).alias("neg"), i.alias("pos"), v.alias("v"), own.alias("own")),
            ),
        )
    )


def _single_lines(row: Column) -> Column:
    """What ``_path_lines`` and ``_agent_lines`` say of an actor with this row alone."""
    path = F.concat(
        F.lit("  "), row["method"], F.lit(" "), row["path"], F.lit(" -> 1x (status "),
        row["status"].cast("string"), F.lit(":1)"),
    )
    agent = F.concat(F.lit("  User-Agent: "), row["user_agent"])
    return F.when(row["user_agent"] != "", F.array(path, agent, F.lit(""))).otherwise(F.array(path, F.lit("")))


def _actor_block(actor: Column) -> Column:
    head = F.array(
        F.concat(F.lit("IP "), actor["v"], F.lit(": "), _count(actor), F.lit(" requests"))
    )

    def block(own: Column) -> Column:
        method = F.get(_counted(own, lambda r: r["method"]), F.lit(0))["v"]
        shared = F.struct(method.alias("method"), _status_text(own).alias("statuses"))
        return F.concat(head, bound(shared, lambda s: _path_lines(own, s)), _agent_lines(own))

    # most actors of a context have one row there, in which no value needs counting; missing values take the long way
    def brief(row: Column) -> Column:
        known = F.lit(True)
        for name in ("method", "path", "status", "user_agent"):
            known = known & row[name].isNotNull()
        return F.when(known, F.concat(head, _single_lines(row))).otherwise(block(actor["own"]))

    return F.when(actor["neg"] == -1, brief(F.get(actor["own"], F.lit(0)))).otherwise(block(actor["own"]))


def _frequent_lines(context: Column) -> Column:
    def line(p: Column) -> Column:
        hits = F.filter(context, lambda r: r["path"] == p["v"])
        several = bound(
            F.size(F.array_distinct(F.transform(hits, lambda r: r["actor"]))),
            lambda ips: F.when(
                (p["v"] != "") & ((p["neg"] <= -3) | (ips >= 2)),
                F.concat(F.lit("  "), p["v"], F.lit(": "), _count(p), F.lit(" hits from "),
                         ips.cast("string"), F.lit(" IPs")),
            ),
        )
        return F.when(p["neg"] <= -2, several)  # a single hit is of one actor

    found = F.array_compact(F.transform(_counted(context, lambda r: r["path"]), line))
    return bound(
        found,
        lambda lines: F.when(
            F.size(lines) > 0,
            F.concat(F.array(F.lit("Frequent paths:")), lines, F.array(F.lit(""))),
        ).otherwise(F.expr("cast(array() as array<string>)")),
    )


def context_text(context: Column) -> Column:
    """Summary of a context (at most a few dozen rows) as text, inside the row."""
    blocks = F.flatten(F.transform(_grouped(context, lambda r: r["actor"]), _actor_block))
    times = F.transform(context, lambda r: r["ts"])
    head = F.array(
        F.concat(F.lit("Total entries: "), F.size(context).cast("string")),
        F.concat(
            F.lit("Time window: "), F.date_format(F.array_min(times), "HH:mm:ss"),
            F.lit(" - "), F.date_format(F.array_max(times), "HH:mm:ss"),
        ),
        F.lit(""),
    )
    return F.array_join(F.concat(head, blocks, _frequent_lines(context)), "\n")


# --- text a scorer gets --------------------------------------------------------

_REPLY_FIELDS = (
    "severity (low, medium, high, critical), confidence (0.0 to 1.0), summary, "
    "recommended_action (block_ip, block_path, rate_limit, alert_only, investigate), "
    "action_details with ip, ips, path and paths"
)
_COPY_RULE = "Copy addresses, tokens such as [IP_001] and paths exactly as the lines show them."


def _framed(parts: list[Column], label: Column, context: Column, batch: Column) -> Column:
    source = F.when(label != "", F.concat(F.lit("Source: "), label))
    summary = F.when(context != "", F.concat(F.lit("Context:\n"), context))
    return F.concat_ws("\n", *parts, source, summary, F.concat(F.lit("Lines:\n"), batch))


def fast_prompt(
    batch: str = "batch_text", label: str = "source_label", context: str = "context_text"
) -> Column:
    head = F.lit(
        "Classify the web server activity below. Answer with one JSON object: category ("
        + ", ".join(fixed.CATEGORIES) + "), indicators, " + _REPLY_FIELDS + ". " + _COPY_RULE
    )
    return _framed([head], F.col(label), F.col(context), F.col(batch))


def deep_prompt(
    category: str,
    confidence: str,
    batch: str = "batch_text",
    label: str = "source_label",
    context: str = "context_text",
) -> Column:
    head = F.lit(
        "Investigate the activity below in depth: stages, links between lines, techniques. "
        "Answer with one JSON object: threat_type, attack_pattern, mitre_ttps, "
        + _REPLY_FIELDS + ", zone_name and rate for a rate limit. " + _COPY_RULE
    )
    triage = F.concat(
        F.lit("First opinion: "), F.col(category), F.lit(" at "),
        F.format_string("%.2f", F.col(confidence)),
    )
    return _framed([head, triage], F.col(label), F.col(context), F.col(batch))


def extract_from_batch(batch: Column) -> Column:
    """Addresses and paths named in a text block, in order of appearance."""
    def every(pattern: str, group: int) -> Column:
        return F.array_distinct(F.regexp_extract_all(batch, F.lit(pattern), F.lit(group)))

    tokens = every(f"({fixed.IP_TOKEN})", 1)
    ips = F.when(F.size(tokens) > 0, tokens).otherwise(every(f"({fixed.IPV4_IN_TEXT})", 1))
    paths = every(fixed.REQUEST_IN_LINE, 1)
    return F.struct(
        F.get(ips, F.lit(0)).alias("ip"), ips.alias("ips"),
        F.get(paths, F.lit(0)).alias("path"), paths.alias("paths"),
    )
