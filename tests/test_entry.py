"""The driver contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "sum_charge" in df.columns


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_training_data_subpackage():
    code = "import sys; sys.modules['millrace.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'tpch_q1' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
