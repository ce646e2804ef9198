from __future__ import annotations

import pytest


def documents(spark, rows):
    """Documents from (doc_id, text) pairs."""
    return spark.createDataFrame(
        [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda rows: documents(spark, rows)


@pytest.fixture(scope="session")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def corpus_rows(corpus):
    return [(r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").collect()]
