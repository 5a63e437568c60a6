"""Every query of the library against its SQL, and the entry module's contract."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from schemaloom.queries import ORACLE, QUERIES
from tests.helpers import same

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert same(QUERIES[name](spark, SF), ORACLE[name], SF)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() == 11 and "type" in out.columns


def test_contract():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(QUERIES) <= set(queries) and set(oracle) <= set(queries)
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    present = all(os.path.exists(os.path.join(here, x)) for x in ("corpus_pipeline.py", "schemaloom/llm/__init__.py"))
    assert ("pipeline" in queries) == present


def test_imports_without_a_session():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    assert subprocess.run([sys.executable, "-c", code], cwd=here, capture_output=True, check=True)


def test_nothing_else_needs_the_corpus_package():
    here = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "schemaloom")
    for folder, _, files in os.walk(here):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    assert "schemaloom.llm" not in text.read(), f
