"""Rule-based detection (level 1).

A rule is either a *row* rule (a row matches or not) or an *actor* rule (an
actor qualifies by the number, or the number of distinct paths, of its candidate
rows). Rules are ordered; a row belongs to the first rule that takes it, and an
actor rule takes its candidates only when the actor qualifies.

Whether an actor qualifies is a fact about (scope, actor). So one pass groups the
candidate rows by (scope, actor, path), with the counts each rule would see for
every outcome of the earlier actor rules; a second, much smaller grouping by
(scope, actor) picks the outcome. All findings come from that table: no row is
joined back, and a hot actor is merged before the shuffle.

The outcomes double with every actor rule. Registries with more than ``MOST_CASES`` of them
carry a mask of matching rules with every path instead, and settle one actor rule after the
other on what the earlier ones left (``residual_profile``): linear in the rules, same findings.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.once import computed_once
from ..options import RuleOptions
from ..sources.landing import land
from .noise import any_of

ROW, COUNT, PATHS = "row", "count", "paths"

MOST_CASES = 3  # actor rules whose outcomes are counted side by side
MOST_RULES = 62  # rules that fit a mask

# Fixed texts of the findings.
SUMMARIES = {
    "sqli": "SQL injection attempt detected: %s",
    "traversal": "Directory traversal attempt: %s",
    "bruteforce": "Brute force: %d failed logins from %s to %s",
    "scanner": "Known scanner detected from %s: %s",
    "path_fuzz": "Path fuzzing: %d distinct 404/403 paths from %s",
}
INDICATORS = {
    "sqli": "sqli_pattern_in_%s",
    "traversal": "traversal_in_%s",
    "bruteforce": "%dx_401_from_%s",
    "scanner": "scanner_ua=%s",
    "path_fuzz": "%dx_unique_paths_from_%s",
}


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    matches: Callable[[], Column]
    category: str
    severity: str
    action: str
    threshold: int = 1
    names_agent: bool = False  # the texts quote the first row's user agent
    summary: Callable[[], Column] | None = None
    indicator: Callable[[], Column] | None = None


def _found(column: Column, patterns: Sequence[str]) -> Column:
    return column.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def checked_path(options: RuleOptions) -> Column:
    path = F.col("path")
    return F.coalesce(F.try_url_decode(path), path) if options.decode_path else path


def is_sqli(options: RuleOptions = RuleOptions()) -> Column:
    return _found(checked_path(options), options.sqli_patterns)


def is_traversal(options: RuleOptions = RuleOptions()) -> Column:
    return _found(checked_path(options), options.traversal_patterns)


def is_scanner(options: RuleOptions = RuleOptions()) -> Column:
    names = tuple(name.lower() for name in options.scanner_agents)
    return F.lower("user_agent").rlike(any_of(names))


def is_failed_login(options: RuleOptions = RuleOptions()) -> Column:
    return (
        F.col("status").isin(*fixed.BRUTE_STATUSES)
        & F.rtrim(F.col("path"), F.lit("/")).isin(*options.brute_force_paths)
        & F.upper("method").isin(*fixed.BRUTE_METHODS)
    )


def is_missing_path(options: RuleOptions = RuleOptions()) -> Column:
    return F.col("status").isin(*fixed.FUZZ_STATUSES)


def default_rules(options: RuleOptions = RuleOptions()) -> list[Rule]:
    """Registry in priority order. Callers may insert their own rules."""
    n, who = F.col("n"), F.col("ip")
    first_path, agent = F.col("path"), F.col("user_agent")

    def text(table: dict[str, str], name: str, *columns: Column) -> Callable[[], Column]:
        return lambda: F.format_string(table[name], *columns)

    return [
        Rule("sqli", ROW, lambda: is_sqli(options), "exploit_attempt", "critical", "block_ip",
             summary=text(SUMMARIES, "sqli", F.left(first_path, F.lit(80))),
             indicator=text(INDICATORS, "sqli", F.left(first_path, F.lit(50)))),
        Rule("traversal", ROW, lambda: is_traversal(options), "exploit_attempt", "high",
             "block_ip",
             summary=text(SUMMARIES, "traversal", F.left(first_path, F.lit(80))),
             indicator=text(INDICATORS, "traversal", F.left(first_path, F.lit(50)))),
        Rule("bruteforce", COUNT, lambda: is_failed_login(options), "bruteforce", "high",
             "block_ip", options.brute_force_threshold,
             summary=text(SUMMARIES, "bruteforce", n, who, first_path),
             indicator=text(INDICATORS, "bruteforce", n, who)),
        Rule("scanner", ROW, lambda: is_scanner(options), "scan", "high", "rate_limit",
             names_agent=True,
             summary=text(SUMMARIES, "scanner", who, agent),
             indicator=text(INDICATORS, "scanner", agent)),
        Rule("path_fuzz", PATHS, lambda: is_missing_path(options), "scan", "medium",
             "rate_limit", options.path_fuzz_threshold,
             summary=text(SUMMARIES, "path_fuzz", n, who),
             indicator=text(INDICATORS, "path_fuzz", n, who)),
    ]


def candidates(entries: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Signal rows with one boolean ``_m_<rule>`` per rule."""
    marked = entries.where(~F.col("is_noise")) if "is_noise" in entries.columns else entries
    flags = F.struct(*[F.coalesce(r.matches(), F.lit(False)).alias(r.name) for r in rules])
    return computed_once(marked, "_m", flags).withColumns(
        {f"_m_{r.name}": F.col(f"_m.{r.name}") for r in rules}
    )


def _any_match(rules: Sequence[Rule]) -> Column:
    hit = F.lit(False)
    for rule in rules:
        hit = hit | F.col(f"_m_{rule.name}")
    return hit


def _cases(rules: Sequence[Rule], k: int) -> list[tuple[str, ...]]:
    """Every set of earlier actor rules the actor may have qualified for."""
    earlier = [r.name for r in rules[:k] if r.kind != ROW]
    return [
        chosen for size in range(len(earlier) + 1)
        for chosen in itertools.combinations(earlier, size)
    ]


def _taken_by(rules: Sequence[Rule], k: int, qualified: tuple[str, ...]) -> Column:
    """Row goes to rule ``k`` given the earlier actor rules that qualified."""
    take = F.col(f"_m_{rules[k].name}")
    for earlier in rules[:k]:
        if earlier.kind == ROW or earlier.name in qualified:
            take = take & ~F.col(f"_m_{earlier.name}")
    return take


def _case_name(rule: str, qualified: tuple[str, ...]) -> str:
    return "_".join(["c", rule, *qualified])


def _pick(rules: Sequence[Rule], k: int, field: Callable[[str], Column]) -> Column:
    """Value of the case that holds, once the earlier ``q_<rule>`` flags are known."""
    earlier = [r.name for r in rules[:k] if r.kind != ROW]
    chosen = None
    for case in _cases(rules, k):
        holds = F.lit(True)
        for name in earlier:
            flag = F.col(f"q_{name}")
            holds = holds & (flag if name in case else ~flag)
        value = field(_case_name(rules[k].name, case))
        chosen = F.when(holds, value) if chosen is None else chosen.when(holds, value)
    return chosen


def path_profile(marked: DataFrame, rules: Sequence[Rule], scope: Sequence[str]) -> DataFrame:
    """Candidate rows merged per (scope, actor, path), one count and first row per case.

    Counts and row numbers only, so it is a hash aggregate. The user agent is part of
    the key just for rows whose rule quotes it.
    """
    if _n_actor_rules(rules) > MOST_CASES:
        raise ValueError(f"more than {MOST_CASES} actor rules need residual_profile")
    quoting = [r for r in rules if r.names_agent]
    kinds = [r.kind for r in rules]
    if quoting and PATHS in kinds and kinds.index(PATHS) < max(map(rules.index, quoting)):
        raise ValueError("rules that quote the user agent must come before path rules")
    columns = []
    for k, rule in enumerate(rules):
        for case in _cases(rules, k):
            name, take = _case_name(rule.name, case), _taken_by(rules, k, case)
            columns += [
                F.count_if(take).alias(f"n_{name}"),
                F.min(F.when(take, F.col("seq"))).alias(f"s_{name}"),
            ]
    agent = F.when(_any_match(quoting), F.col("user_agent"))
    return marked.where(_any_match(rules)).groupBy(
        *scope, "actor", "path", agent.alias("user_agent")
    ).agg(*columns)


def actor_profile(paths: DataFrame, rules: Sequence[Rule], scope: Sequence[str]) -> DataFrame:
    """One row per (scope, actor): ``q_<rule>`` qualified, ``n_<rule>`` and first row."""
    columns = []
    for k, rule in enumerate(rules):
        for case in _cases(rules, k):
            name = _case_name(rule.name, case)
            hit = F.col(f"n_{name}") > 0
            first = F.struct(F.col(f"s_{name}").alias("seq"), "path", "user_agent")
            columns += [
                F.sum(f"n_{name}").alias(f"n_{name}"),
                F.count_if(hit).alias(f"p_{name}"),
                F.min(F.when(hit, first)).alias(f"f_{name}"),
            ]
    table = paths.groupBy(*scope, "actor").agg(*columns)
    keep = [*scope, "actor"]
    for k, rule in enumerate(rules):
        measure = "p" if rule.kind == PATHS else "n"
        table = table.withColumns({
            f"n_{rule.name}": _pick(rules, k, lambda c: F.col(f"{measure}_{c}")),
            f"rows_{rule.name}": _pick(rules, k, lambda c: F.col(f"n_{c}")),
            f"f_{rule.name}": _pick(rules, k, lambda c: F.col(f"f_{c}")),
        })
        reached = F.col(f"n_{rule.name}") >= rule.threshold
        table = table.withColumn(f"q_{rule.name}", reached)
        keep += [f"{p}_{rule.name}" for p in ("q", "n", "rows", "f")]
    return table.select(*keep)


def _n_actor_rules(rules: Sequence[Rule]) -> int:
    return sum(r.kind != ROW for r in rules)


def _lowest_bit(mask: Column) -> Column:
    return mask.bitwiseAND(-mask)


def path_masks(marked: DataFrame, rules: Sequence[Rule], scope: Sequence[str]) -> DataFrame:
    """Candidate rows merged per (scope, actor, path, mask): how many, and the first one's number.

    Bit ``k`` of a mask says that rule ``k`` matches and no row rule before it does.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    matching, row_rules = F.lit(0).cast("bigint"), 0
    for k, rule in enumerate(rules):
        matching = matching + F.when(F.col(f"_m_{rule.name}"), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint")
        row_rules |= (rule.kind == ROW) << k
    first = _lowest_bit(F.col("_all").bitwiseAND(F.lit(row_rules).cast("bigint")))
    mask = F.when(first == 0, F.col("_all")).otherwise(F.col("_all").bitwiseAND(first.bitwiseOR(first - 1)))
    agent = F.when(_any_match([r for r in rules if r.names_agent]), F.col("user_agent"))
    return marked.where(_any_match(rules)).withColumn("_all", matching).groupBy(
        *scope, "actor", "path", agent.alias("user_agent"), mask.alias("mask")
    ).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))


def _with_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the other columns of ``facts``; a missing actor is an actor too."""
    same = F.lit(True)
    for key in keys:
        same = same & rows[key].eqNullSafe(facts[key])
    return rows.join(facts, same, "left").select(
        *[rows[c] for c in rows.columns], *[facts[c] for c in facts.columns if c not in keys])


def _with_settled(paths: DataFrame, settled: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """``paths`` with ``settled``: the bits of the actor rules that their actor qualifies for."""
    none = F.lit(0).cast("bigint")
    if settled is None:
        return paths.withColumn("settled", none)
    return _with_facts(paths, settled, keys).withColumn("settled", F.coalesce("settled", none))


def residual_profile(marked: DataFrame, rules: Sequence[Rule], scope: Sequence[str]) -> DataFrame:
    """The table of ``actor_profile`` for any number of actor rules.

    Every actor rule counts the paths that the earlier ones left and adds the actors that qualify to a table of
    one mask per (scope, actor). That table is landed per rule, so plans stay small and nothing is run twice.
    Rows hold counts only of rules that caught the actor.
    """
    keys = [*scope, "actor"]
    paths = land(path_masks(marked, rules, scope), "masks")
    settled, always = None, 0
    for k, rule in enumerate(rules):
        if rule.kind == ROW:
            always |= 1 << k
            continue
        left = _with_settled(paths.where(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0), settled, keys).where(
            F.col("mask").bitwiseAND(F.col("settled")) == 0)
        if rule.kind == PATHS:
            counted = left.select(*keys, "path").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        else:
            counted = left.groupBy(*keys).agg(F.sum("n").alias("n"))
        reached = counted.where(F.col("n") >= rule.threshold).select(
            *keys, F.lit(1 << k).cast("bigint").alias("settled"))
        if settled is not None:
            reached = settled.unionByName(reached).groupBy(*keys).agg(F.bit_or("settled").alias("settled"))
        settled = land(reached, "settled")

    takers = F.col("mask").bitwiseAND(F.col("settled").bitwiseOR(F.lit(always)))
    taken = _with_settled(paths, settled, keys).withColumn("taker", _lowest_bit(takers)).where("taker <> 0")
    per_path = taken.groupBy(*keys, "taker", "path").agg(
        F.sum("n").alias("n"), F.min(F.struct("seq", "path", "user_agent")).alias("first"))
    caught = per_path.groupBy(*keys, "taker").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_paths"), F.min("first").alias("first"))
    columns = []
    for k, rule in enumerate(rules):
        mine = F.col("taker") == (1 << k)
        columns += [
            F.bool_or(mine).alias(f"q_{rule.name}"),
            F.max(F.when(mine, F.col("n_paths" if rule.kind == PATHS else "n_rows"))).alias(f"n_{rule.name}"),
            F.max(F.when(mine, F.col("n_rows"))).alias(f"rows_{rule.name}"),
            F.min(F.when(mine, F.col("first"))).alias(f"f_{rule.name}"),
        ]
    return caught.groupBy(*keys).agg(*columns)


def _profile(marked: DataFrame, rules: Sequence[Rule], scope: Sequence[str]) -> DataFrame:
    if _n_actor_rules(rules) > MOST_CASES:
        return residual_profile(marked, rules, scope)
    return actor_profile(path_profile(marked, rules, scope), rules, scope)


def findings(
    entries: DataFrame,
    scope: Sequence[str],
    options: RuleOptions = RuleOptions(),
    rules: Sequence[Rule] | None = None,
) -> DataFrame:
    """All findings: one per scope for row rules, one per (scope, actor) for actor rules.

    ``entries`` need ``actor``. The addresses and paths of a finding are not
    bounded, so they are the rows of ``finding_actors`` and ``finding_paths``.
    """
    return findings_of(profile(entries, scope, options, rules), scope, options, rules)


def profile(
    entries: DataFrame,
    scope: Sequence[str],
    options: RuleOptions = RuleOptions(),
    rules: Sequence[Rule] | None = None,
) -> DataFrame:
    rules = rules or default_rules(options)
    if not options.enabled:
        entries = entries.where(F.lit(False))
    return _profile(candidates(entries, rules), rules, scope)


def _caught(actors: DataFrame, rules: Sequence[Rule], scope: Sequence[str]) -> DataFrame:
    """Unfold each (scope, actor) row into the rules that caught the actor.

    Columns: rule, scope columns, actor (null for row rules), ip, n, n_rows,
    first(seq, path, user_agent). One pass, whatever the number of rules.
    """
    hits = F.array_compact(F.array(*[
        F.when(
            F.col(f"q_{r.name}"),
            F.struct(
                F.lit(r.name).alias("rule"),
                (F.lit(None).cast("string") if r.kind == ROW else F.col("actor")).alias("actor"),
                F.col("actor").alias("ip"),
                F.col(f"n_{r.name}").alias("n"),
                F.col(f"rows_{r.name}").alias("n_rows"),
                F.col(f"f_{r.name}").alias("first"),
            ),
        )
        for r in rules
    ]))
    return actors.select(*scope, F.explode(hits).alias("_c")).select(*scope, "_c.*")


def findings_of(
    actors: DataFrame,
    scope: Sequence[str],
    options: RuleOptions = RuleOptions(),
    rules: Sequence[Rule] | None = None,
) -> DataFrame:
    """Findings out of the (scope, actor) table of ``profile``."""
    rules = rules or default_rules(options)
    scope = list(scope)
    if options.suppress_fuzz_on_scanner:
        scanned = actors.groupBy(*scope).agg(F.bool_or("q_scanner").alias("_scanned"))
        actors = actors.join(scanned, scope).withColumn(
            "q_path_fuzz", F.col("q_path_fuzz") & ~F.col("_scanned")
        )
    caught = _caught(actors, rules, scope)
    if options.first_only:
        # actor rules too are one finding per scope: the actor seen first
        is_actor = F.col("actor").isNotNull()
        best = caught.where(is_actor).groupBy("rule", *scope).agg(
            F.min_by(F.struct("actor", "ip", "n", "n_rows", "first"), "first").alias("_b")
        ).select("rule", *scope, "_b.*")
        caught = caught.where(~is_actor).unionByName(best)
    merged = caught.groupBy("rule", *scope, "actor").agg(
        F.min(F.struct("first", "ip")).alias("_f"),
        F.sum("n").alias("n"),
        F.sum("n_rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_ips"),
    ).select(
        "rule", *scope, "actor", "n", "n_rows", "n_ips",
        F.col("_f.ip").alias("ip"),
        F.col("_f.first.seq").alias("first_seq"),
        F.col("_f.first.path").alias("path"),
        F.col("_f.first.user_agent").alias("user_agent"),
    )

    def of_rule(value: Callable[[Rule], Column]) -> Column:
        chain = None
        for rule in rules:
            hit = F.col("rule") == rule.name
            chain = F.when(hit, value(rule)) if chain is None else chain.when(hit, value(rule))
        return chain

    return merged.select(
        "rule", *scope, "actor",
        of_rule(lambda r: F.lit(r.category)).alias("category"),
        of_rule(lambda r: F.lit(r.severity)).alias("severity"),
        F.lit(fixed.RULE_CONFIDENCE).alias("confidence"),
        of_rule(lambda r: r.summary()).alias("summary"),
        of_rule(lambda r: r.indicator()).alias("indicator"),
        of_rule(lambda r: F.lit(r.action)).alias("recommended_action"),
        "ip", "n_ips", "path", "n", "n_rows", "first_seq",
        F.lit("local_rules").alias("analyzed_by"),
    )


def finding_actors(
    actors: DataFrame,
    scope: Sequence[str],
    options: RuleOptions = RuleOptions(),
    rules: Sequence[Rule] | None = None,
) -> DataFrame:
    """Addresses of each finding: (rule, scope, actor, ip, ip_seq).

    ``ip_seq`` is the address's first row, the order of the list.
    """
    caught = _caught(actors, rules or default_rules(options), scope)
    return caught.select("rule", *scope, "actor", "ip", F.col("first.seq").alias("ip_seq"))


def finding_paths(
    labelled: DataFrame,
    scope: Sequence[str],
    options: RuleOptions = RuleOptions(),
    rules: Sequence[Rule] | None = None,
) -> DataFrame:
    """Paths of each finding, from the rows of ``label_rows``: (rule, scope, actor, path, path_seq).

    ``path_seq`` is the path's first row, the order of the list. ``actor`` is null for row rules.
    """
    by_actor = [r.name for r in rules or default_rules(options) if r.kind != ROW]
    taken = labelled.where(F.col("label").isNotNull())
    actor = F.when(F.col("label").isin(*by_actor), F.col("actor"))
    return taken.groupBy(
        F.col("label").alias("rule"), *scope, actor.alias("actor"), "path"
    ).agg(F.min("seq").alias("path_seq"))


def scope_actors(entries: DataFrame, found: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Parity list: row-rule findings name every actor of their scope, seen or not."""
    rows = entries.where(~F.col("is_noise")) if "is_noise" in entries.columns else entries
    everyone = rows.groupBy(*scope, "actor").agg(F.min("seq").alias("ip_seq"))
    wide = found.where(F.col("actor").isNull()).select("rule", *scope)
    return everyone.join(wide, list(scope)).select(
        "rule", *scope, F.lit(None).cast("string").alias("actor"),
        F.col("actor").alias("ip"), "ip_seq",
    )


def label_rows(
    entries: DataFrame,
    scope: Sequence[str],
    options: RuleOptions = RuleOptions(),
    rules: Sequence[Rule] | None = None,
) -> DataFrame:
    """Signal rows with ``label``: the rule that took the row, or null.

    Only rows an actor rule may take need the actor table; the others are
    labelled by their own columns and are not shuffled.
    """
    rules = rules or default_rules(options)
    scope = list(scope)
    marked = candidates(entries, rules)
    qualified = _profile(marked, rules, scope).select(
        *scope, "actor", *[f"q_{r.name}" for r in rules if r.kind != ROW]
    )

    label, open_rule = None, F.lit(False)
    for rule in rules:
        take = F.col(f"_m_{rule.name}")
        if rule.kind != ROW:
            take = take & F.coalesce(F.col(f"q_{rule.name}"), F.lit(False))
        label = F.when(take, rule.name) if label is None else label.when(take, rule.name)

    # rows decided without the actor table: no actor rule may come first
    before = F.lit(False)
    for rule in rules:
        if rule.kind == ROW:
            before = before | F.col(f"_m_{rule.name}")
        else:
            open_rule = open_rule | (F.col(f"_m_{rule.name}") & ~before)

    none = {f"q_{r.name}": F.lit(False) for r in rules if r.kind != ROW}
    settled = marked.where(~open_rule).withColumns(none).withColumn("label", label)
    joined = _with_facts(marked.where(open_rule), qualified, [*scope, "actor"])
    contested = joined.withColumn("label", label)
    keep = [*entries.columns, "label"]
    return settled.select(*keep).unionByName(contested.select(*keep))
