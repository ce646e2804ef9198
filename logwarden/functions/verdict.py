"""Expressions over severities, categories and actions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..options import ScoreOptions
from . import fixed


def severity_rank(severity: Column) -> Column:
    """low < medium < high < critical as 0..3; unknown labels give null."""
    chain = None
    for rank, name in enumerate(fixed.SEVERITIES):
        hit = severity == name
        chain = F.when(hit, rank) if chain is None else chain.when(hit, rank)
    return chain


def labelled(value: Column, labels: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.create_map(*pairs)[value]


def should_escalate(
    category: Column, confidence: Column, options: ScoreOptions = ScoreOptions()
) -> Column:
    sure = F.coalesce(confidence, F.lit(1.0))
    doubtful = F.coalesce(category.isin("suspicious", "scan"), F.lit(False))
    return (sure < options.escalation_confidence) | (
        doubtful & (sure < options.doubtful_confidence)
    )


_ATTACK = ("bruteforce", "exploit_attempt", "malicious")
_PROBE = ("scan", "suspicious")


def enriched_action(action: Column, category: Column, has_ips: Column) -> Column:
    """Sharpen a passive recommendation by what was found."""
    passive = action.isin("alert_only", "investigate")
    return (
        F.when(~passive | (category == "normal"), action)
        .when(category.isin(*_ATTACK), "block_ip")
        .when(category.isin(*_PROBE) & has_ips, "rate_limit")
        .otherwise(action)
    )


def inferred_action(action: Column, category: Column, severity: Column) -> Column:
    """Action rules are generated for; ``alert_only`` means no rules."""
    grave = severity.isin(*fixed.CRITICAL_SEVERITIES)
    return (
        F.when(~action.isin("alert_only", "investigate"), action)
        .when(grave & category.isin(*_ATTACK), "block_ip")
        .when(grave & category.isin(*_PROBE), "rate_limit")
        .otherwise("alert_only")
    )
