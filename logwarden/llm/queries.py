"""Queries over the synthetic corpus tables: one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logwarden.llm import decontaminate, divergence, html_text, licenses, oracles, packing, quality, runs, secret_scan, sharding, simhash, token_counts, token_store, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("notices")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.spans(table(spark, sf_dir, "documents"))
    base = secret_scan.KINDS[:3]
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    named = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", *[F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in base],
        F.sha2(named(of(*base)), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 8)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.corpus_token_counts(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("matches").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("matches.item", ","), 256).alias("items_sha256"), "contaminated")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Documents of which about a tenth go on in a period from some word on, as the CRC of the id decides."""
    id_crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(id_crc / 10).cast("bigint")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def periodic(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = F.floor((n - a) / (g % 8 + 3)).cast("int") + 1
        again = F.transform(F.sequence(a, n - 1), lambda i: F.get(w, a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a), again), " ")).otherwise("")

    # the one-row array is there so that words are looked for once
    words = F.array(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0))
    planted = F.get(F.transform(words, periodic), 0)
    return docs.select("doc_id", F.when(id_crc % 10 == 0, planted).otherwise(text).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.scan(with_planted_periods(table(spark, sf_dir, "documents")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.expr("(1000 * longest.length) div -longest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_licenses": op2_licenses,
    "op3_simhash": op3_simhash,
    "op4_secrets": op4_secrets,
    "op5_sharding": op5_sharding,
    "op6_token_counts": op6_token_counts,
    "op7_packing": op7_packing,
    "op8_quality": op8_quality,
    "op9_decontamination": op9_decontamination,
    "op10_html": op10_html,
    "op11_runs": op11_runs,
    "op12_divergence": op12_divergence,
    "op13_token_store": op13_token_store,
}

ORACLES: dict[str, str] = {
    "op5_sharding": oracles.OP5,
    "op8_quality": oracles.OP8,
    "op9_decontamination": oracles.OP9,
    "op12_divergence": oracles.OP12,
}
