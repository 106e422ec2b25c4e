"""Every query of the catalogue against its SQL on the small tables; queries without SQL have tests of their own."""

import os
import subprocess
import sys

import duckdb
import pytest

from quernstone import catalog

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else round(x, 5)
    return [plain(y) for y in x] if isinstance(x, list | tuple) else x


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    want = db.sql(catalog.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(str([plain(r[c]) for c in cols]) for r in df.collect()) == sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_scan_reads_only_what_the_assessment_names(spark):
    plan = catalog.QUERIES["assessment"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "ArrowEvalPython" not in plan and "CartesianProduct" not in plan


WITHOUT = """
import sys
sys.modules["{module}"] = None
import warnings
warnings.simplefilter("ignore")
import __spark_entry__ as e
print(len(e.queries()), any(n.startswith("op") for n in e.queries()))
"""


@pytest.mark.parametrize("module", ["quernstone.llm", "ahocorasick", "corpus_pipeline"])
def test_entry_without_the_text_operators(module):
    out = subprocess.run([sys.executable, "-c", WITHOUT.format(module=module)], capture_output=True, text=True, cwd=ROOT, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == [str(len(catalog.QUERIES)), "False"]
