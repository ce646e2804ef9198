"""Expressions that read a scorer's JSON reply, whatever shape it came in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed

DETAILS = (
    "struct<ip:string,ips:array<string>,path:string,paths:array<string>,"
    "zone_name:string,rate:string,details:string>"
)


def strip_fences(text: Column) -> Column:
    opened = F.regexp_replace(F.trim(text), r"^```(?:json)?", "")
    return F.trim(F.regexp_replace(opened, r"```$", ""))


def _body(variant: Column) -> Column:
    """The reply object: a list stands for its first element."""
    shape = F.schema_of_variant(variant)
    return (
        F.when(shape.startswith("OBJECT"), variant)
        .when(shape.startswith("ARRAY"), F.try_variant_get(variant, "$[0]", "variant"))
    )


def _text(body: Column, key: str) -> Column:
    """A field only if the reply holds it as a string."""
    field = F.try_variant_get(body, f"$.{key}", "variant")
    return F.when(
        F.schema_of_variant(field) == "STRING", F.try_variant_get(body, f"$.{key}", "string")
    )


def _strings(body: Column, key: str) -> Column:
    """A list field; null entries, which name nothing, are left out."""
    return F.array_compact(F.try_variant_get(body, f"$.{key}", "array<string>"))


def one_of(value: Column, allowed: tuple[str, ...], default: Column) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(default)


def read_reply(df: DataFrame, reply: str, into: str) -> DataFrame:
    """Add struct ``into`` with the reply's typed fields.

    ``ok`` is false when the text is no JSON; absent or badly typed fields are
    null, so callers choose the default. ``details_kind`` is dict, text or none.
    """
    parsed = df.withColumn("_v", F.try_parse_json(strip_fences(F.col(reply)))).withColumn(
        "_b", _body(F.col("_v"))
    )
    body = F.col("_b")
    details = F.try_variant_get(body, "$.action_details", "variant")
    shape = F.schema_of_variant(details)
    empty = F.to_json(details) == "{}"
    nested = lambda key: F.try_variant_get(body, f"$.action_details.{key}", "string")
    listed = lambda key: _strings(body, f"action_details.{key}")
    return parsed.withColumn(
        into,
        F.struct(
            F.col("_v").isNotNull().alias("ok"),
            _text(body, "category").alias("category"),
            _text(body, "severity").alias("severity"),
            F.try_variant_get(body, "$.confidence", "double").alias("confidence"),
            _text(body, "summary").alias("summary"),
            _text(body, "threat_type").alias("threat_type"),
            _text(body, "recommended_action").alias("recommended_action"),
            _strings(body, "indicators").alias("indicators"),
            _strings(body, "mitre_ttps").alias("mitre_ttps"),
            F.when(shape.startswith("OBJECT") & ~empty, "dict")
            .when(shape == "STRING", "text")
            .otherwise("none")
            .alias("details_kind"),
            F.struct(
                nested("ip").alias("ip"),
                listed("ips").alias("ips"),
                nested("path").alias("path"),
                listed("paths").alias("paths"),
                nested("zone_name").alias("zone_name"),
                nested("rate").alias("rate"),
                _text(body, "action_details").alias("details"),
            ).alias("details"),
        ),
    ).drop("_v", "_b")


def fast_assessment(r: str) -> dict[str, Column]:
    """Columns of a first-tier assessment; a reply that is no JSON is a parse error."""
    get = lambda name: F.col(f"{r}.{name}")
    ok = F.coalesce(get("ok"), F.lit(False))
    none = F.expr("cast(array() as array<string>)")
    return {
        "category": one_of(get("category"), fixed.CATEGORIES, F.lit("normal")),
        "severity": one_of(get("severity"), fixed.SEVERITIES, F.lit("low")),
        "confidence": F.coalesce(get("confidence"), F.lit(0.0)),
        "summary": F.when(~ok, "parse error").otherwise(F.coalesce(get("summary"), F.lit(""))),
        "indicators": F.coalesce(get("indicators"), none),
        "recommended_action": one_of(
            get("recommended_action"), fixed.ACTIONS, F.lit("alert_only")
        ),
        "mitre_ttps": F.coalesce(get("mitre_ttps"), none),
        "details_kind": F.coalesce(get("details_kind"), F.lit("none")),
        "details": get("details"),
        "analyzed_by": F.lit("l2_fast"),
    }


def deep_overlay(r: str, fast: str) -> dict[str, Column]:
    """Second-tier columns laid over the first tier's struct ``fast``.

    No usable deep reply keeps the first tier's values.
    """
    get = lambda name: F.col(f"{r}.{name}")
    old = lambda name: F.col(f"{fast}.{name}")
    used = F.coalesce(get("ok"), F.lit(False))
    none = F.expr("cast(array() as array<string>)")

    def choose(new: Column, name: str) -> Column:
        return F.when(used, new).otherwise(old(name))

    return {
        "category": old("category"),
        "severity": choose(
            one_of(get("severity"), fixed.SEVERITIES, old("severity")), "severity"
        ),
        "confidence": choose(F.coalesce(get("confidence"), old("confidence")), "confidence"),
        "summary": choose(
            F.coalesce(get("summary"), get("threat_type"), old("summary")), "summary"
        ),
        "indicators": choose(none, "indicators"),
        "recommended_action": choose(
            one_of(get("recommended_action"), fixed.ACTIONS, F.lit("alert_only")),
            "recommended_action",
        ),
        "mitre_ttps": choose(F.coalesce(get("mitre_ttps"), none), "mitre_ttps"),
        "details_kind": choose(get("details_kind"), "details_kind"),
        "details": choose(get("details"), "details"),
        "analyzed_by": F.when(used, "l2_deep").otherwise(old("analyzed_by")),
    }
