from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from .test_decontaminate import words_of
from .test_packing import check
from .test_secret_scan import plain
from .test_simhash import brute as brute_components
from tokenizers import Tokenizer

from logwarden.llm import packing, queries, simhash, tokens, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What went into each stage, and what came out of the last."""
    docs = corpus_pipeline.table(spark, SF, "documents")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_keep_the_columns(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_dedup", "decontamination", "secrets", "packing"]
    assert all(s.schema == steps[0].schema for s in steps[:-1])


def rows(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def test_toxicity_drops_what_it_scores(spark, steps):
    model = toxicity.learn(steps[0], corpus_pipeline.table(spark, SF, "labels"))
    lexicon = toxicity.Lexicon(model.terms, model.exceptions)
    want = [i for i, t in rows(steps[0]) if lexicon.density(t or "") < model.threshold]
    assert sorted(i for i, _ in rows(steps[1])) == sorted(want)


def test_one_document_of_each_group_stays(steps):
    groups = brute_components(rows(steps[1]))
    assert sorted(i for i, _ in rows(steps[2])) == sorted({c for _, _, c in groups})


def test_contaminated_documents_go(spark, steps):
    windows = {}
    for r in corpus_pipeline.table(spark, SF, "benchmark").collect():
        words = words_of(r["text"])
        size = min(13, len(words))
        windows.update({tuple(words[k:k + size]): size for k in range(len(words) - size + 1) if size})
    sizes = set(windows.values())
    want = []
    for i, t in rows(steps[2]):
        words = words_of(t)
        hit = {j for n in sizes for k in range(len(words) - n + 1) if tuple(words[k:k + n]) in windows for j in range(k, k + n)}
        if not hit or 20 * len(hit) < len(words):
            want.append(i)
    assert sorted(i for i, _ in rows(steps[3])) == sorted(want)


def test_secrets_are_masked_and_nothing_else_changes(steps):
    before, after = dict(rows(steps[3])), dict(rows(steps[4]))
    assert before.keys() == after.keys()
    for i, text in before.items():
        assert not plain(after[i])
        assert (after[i] == text) == ("[SECRET]" not in after[i])
    assert steps[4].where(F.length("text") != F.col("n_chars")).count() == steps[3].where(F.length("text") != F.col("n_chars")).count()


def test_packing_holds_every_token_and_run_gives_the_same(spark, steps):
    whole = Tokenizer.from_file(tokens.vocabulary_path(packing.VOCABULARY))
    whole.encode_special_tokens = True
    assert check(rows(steps[4]), steps[5].collect(), whole) >= 0
    got = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n"))
    want = steps[5].groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_empty_documents(spark, tmp_path, docs_of):
    for name in ("labels", "benchmark"):
        corpus_pipeline.table(spark, SF, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs_of([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_query_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert set(queries.ORACLES) <= set(__spark_entry__.oracle_sql())


NAMES = ("toxicity", "hash", "chars", "text_", "n_words", "n_hit", "spans", "matches", "item", "count", "row", "key", "fp")


def test_columns_of_any_name_are_kept(spark, docs_of):
    """Names that the stages might use themselves, plain, with underscores and in capitals."""
    rows = [(k, f"plain words of document number {k} token=abcdef{k}12") for k in range(6)] + [(2, "copy"), (2, "copy")]
    names = [f"{u}{n}" for n in NAMES for u in ("", "_", "__")] + ["HASH_", "__KEEP_ID", "best"]
    docs = docs_of(rows).withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert kept and all(r[n] == f"{n}{r['doc_id']}" for r in kept for n in names), name


def test_which_copy_stays_does_not_depend_on_the_run(spark):
    rows = [(1, "same text of all", k) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, other int")
    kept = {simhash.deduplicate(frame.repartition(n)).first()["other"] for n in (1, 3, 7)}
    assert len(kept) == 1
