"""The driver's entry module, with and without the corpus operators' libraries."""

from __future__ import annotations

import os
import subprocess
import sys

import __spark_entry__
from logwarden.catalog.queries import QUERIES

BLOCKED = """
import sys
sys.modules["ahocorasick"] = None
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()))
"""


def test_log_queries_need_no_library_of_the_corpus_operators():
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    done = subprocess.run([sys.executable, "-c", BLOCKED], cwd=root, capture_output=True, text=True, check=True)
    queries, oracles = map(int, done.stdout.split())
    assert queries >= oracles >= 78 and queries == len(QUERIES)
