"""Second level: batches the rules left open go to a scorer, doubtful ones to a deeper one."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import replies as R
from ..functions import verdict as V
from ..options import ScoreOptions
from ..streaming.keyed import KeyedTable
from . import batches as B

Scorer = Callable[[list[str]], list[str]]

FIELDS = (
    "category", "severity", "confidence", "summary", "indicators", "recommended_action",
    "mitre_ttps", "details_kind", "details", "analyzed_by",
)


def score(
    df: DataFrame, scorer: Scorer, prompt: str, reply: str, when: str | None = None
) -> DataFrame:
    """Add column ``reply`` = scorer(prompt), called once per row on Arrow batches of prompts.

    Only prompts go to Python; a row's other columns stay where they are. Rows without a prompt, and those where
    ``when`` is not true, pass by unscored. ``scorer`` is any picklable callable from a list of prompts to a list of
    replies; it owns its own rate limit and retries, and ``repartition`` caps how many run at once.
    """

    @F.pandas_udf("string")
    def ask(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in chunks:
            wanted = prompts.notna()
            answers = pd.Series(None, index=prompts.index, dtype=object)
            if wanted.any():
                answers[wanted] = scorer(prompts[wanted].tolist())
            yield answers

    # as a model need not answer alike twice, the optimizer must not ask it again
    asked = F.col(prompt) if when is None else F.when(F.col(when), F.col(prompt))
    return df.withColumn(reply, ask.asNondeterministic()(asked))


REPLIES = T.StructType([T.StructField("prompt_key", T.StringType()), T.StructField("reply", T.StringType())])


def reply_cache(spark: SparkSession, folder: str) -> KeyedTable:
    """A table of replies by the hash of their prompts, for ``score_once``."""
    return KeyedTable(spark, folder, ["prompt_key"], REPLIES)


def score_once(
    df: DataFrame, scorer: Scorer, prompt: str, reply: str, cache: KeyedTable, at_once: int | None = None
) -> DataFrame:
    """Add column ``reply``, asking the scorer once for each distinct prompt that the cache does not know.

    New replies are landed in the cache before anything reads them: neither repeated prompts nor later runs nor a
    second reading of the result ask again. ``at_once`` is how many tasks may ask at the same time. A null
    prompt is not asked about.
    """
    key = spare(df, "prompt_key")
    keyed = df.withColumn(key, F.sha2(prompt, 256))
    asked = keyed.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("prompt_key")).agg(
        F.first(prompt).alias("prompt"))
    new = asked.join(cache.read().select("prompt_key"), "prompt_key", "left_anti")
    if at_once:
        new = new.repartition(at_once, "prompt_key")
    cache.put(score(new, scorer, "prompt", "reply").select("prompt_key", "reply"))
    known = cache.read().select(F.col("prompt_key").alias(key), F.col("reply").alias(reply))
    return keyed.join(known, key, "left").drop(key)


def spare(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def enrich(df: DataFrame, batch: str = "batch_text") -> DataFrame:
    """Fill empty details from the batch text and sharpen passive actions.

    A parse error (column ``parse_error``, if there) stays as it is.
    """
    found = B.extract_from_batch(F.col(batch))
    keep = F.col("details_kind") != "none"
    if "parse_error" in df.columns:
        keep = keep | F.col("parse_error")
    filled = df.withColumn("_found", found).withColumn(
        "details",
        F.when(keep, F.col("details")).otherwise(
            F.struct(
                F.col("_found.ip").alias("ip"), F.col("_found.ips").alias("ips"),
                F.col("_found.path").alias("path"), F.col("_found.paths").alias("paths"),
                F.lit(None).cast("string").alias("zone_name"),
                F.lit(None).cast("string").alias("rate"),
                F.lit(None).cast("string").alias("details"),
            )
        ),
    )
    has_ips = F.coalesce(F.size("details.ips") > 0, F.lit(False))
    return filled.withColumn(
        "recommended_action",
        V.enriched_action(F.col("recommended_action"), F.col("category"), has_ips),
    ).drop("_found")


def assess_fast(
    df: DataFrame, reply: str = "reply", options: ScoreOptions = ScoreOptions()
) -> DataFrame:
    """Replies -> assessment columns plus ``escalate``.

    A reply that is no JSON is a parse error and is not escalated.
    """
    read = R.read_reply(df, reply, "_r")
    doubtful = V.should_escalate(F.col("_r.category"), F.col("_r.confidence"), options)
    return (
        read.withColumns(R.fast_assessment("_r"))
        .withColumn("parse_error", ~F.col("_r.ok"))
        .withColumn("escalate", F.col("_r.ok") & doubtful)
        .drop("_r")
    )


def overlay_deep(df: DataFrame, reply: str = "deep_reply") -> DataFrame:
    """Lay the deep reply over the fast assessment's columns (same row)."""
    packed = df.withColumn("_fast", F.struct(*FIELDS)).drop(*FIELDS)
    return R.read_reply(packed, reply, "_d").withColumns(
        R.deep_overlay("_d", "_fast")
    ).drop("_d", "_fast")


def merge_deep(fast: DataFrame, deep: DataFrame, key: str = "batch_id") -> DataFrame:
    """Fast assessments with the deep replies table, where one was asked for.

    ``deep``: key, deep_reply (one row per key).
    """
    joined = fast.join(deep.select(key, "deep_reply"), key, "left")
    asked = joined.withColumn("deep_reply", F.when(F.col("escalate"), F.col("deep_reply")))
    return overlay_deep(asked)


def cascade(
    texts: DataFrame,
    fast: Scorer,
    deep: Scorer | None = None,
    options: ScoreOptions = ScoreOptions(),
) -> DataFrame:
    """Score, escalate and merge in one linear plan.

    ``texts``: batch_id, batch_text, source_label, context_text. There is no
    branch and no join, so each scorer sees a row once.
    """
    prompts = texts.withColumn("prompt", B.fast_prompt())
    judged = assess_fast(score(prompts, fast, "prompt", "reply"), options=options)
    judged = enrich(judged.drop("prompt", "reply"))
    if deep is None:
        return judged
    asked = judged.withColumn("prompt", B.deep_prompt("category", "confidence"))
    answered = score(asked, deep, "prompt", "deep_reply", when="escalate").drop("prompt")
    return enrich(overlay_deep(answered).drop("deep_reply"))


def keyword_scorer(prompts: list[str]) -> list[str]:
    """Deterministic stand-in for a model: judges by the status codes in the lines."""
    out = []
    for prompt in prompts:
        lines = prompt.rsplit("Lines:\n", 1)[-1]
        if '" 401 ' in lines:
            reply = '{"category":"bruteforce","severity":"medium","confidence":0.9}'
        elif '" 404 ' in lines or '" 403 ' in lines:
            reply = '{"category":"suspicious","severity":"medium","confidence":0.5}'
        else:
            reply = '{"category":"normal","severity":"low","confidence":0.9}'
        out.append(reply)
    return out


def keyword_deep_scorer(prompts: list[str]) -> list[str]:
    """Deterministic second opinion for ``keyword_scorer``."""
    reply = '{"threat_type":"probing","severity":"high","confidence":0.85}'
    return [reply for _ in prompts]


def context_scorer(prompts: list[str]) -> list[str]:
    """Stand-in that judges by the context alone: failures there, and five frequent paths or more."""
    out = []
    for prompt in prompts:
        context = prompt.partition("\nContext:\n")[2].rsplit("\nLines:\n", 1)[0]
        if "(status 401:" in context:
            reply = '{"category":"bruteforce","severity":"medium","confidence":0.9}'
        elif context.count(" hits from ") >= 5:
            reply = '{"category":"suspicious","severity":"low","confidence":0.5}'
        else:
            reply = '{"category":"normal","severity":"low","confidence":0.9}'
        out.append(reply)
    return out


_REQUEST = re.compile(r'^(\S+) .*?"\S+ (\S+) HTTP/[^"]*" (\d+) ', re.M)


def naming_scorer(prompts: list[str]) -> list[str]:
    """Stand-in that names what to block, by the status of the first request: addresses, paths, or a zone and a rate."""
    out = []
    for prompt in prompts:
        found = _REQUEST.search(prompt.rsplit("Lines:\n", 1)[-1])
        ip, path, status = found.groups() if found else ("", "", "")
        action, details = {
            "401": ("block_ip", {"ips": [ip, "192.0.2.9", ip]}),
            "403": ("rate_limit", {"path": path, "zone_name": "z403", "rate": "3r/s"}),
            "404": ("block_path", {"paths": [path, "/extra", path]}),
        }.get(status, ("alert_only", {}))
        out.append(json.dumps({
            "category": "malicious" if details else "normal", "severity": "high" if details else "low",
            "confidence": 0.9, "recommended_action": action, "action_details": details}))
    return out
