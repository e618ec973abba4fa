"""The driver's contract, with and without the optional package."""

import subprocess
import sys

import __spark_entry__ as entry
from tests.conftest import ROOT


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_optional_package():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not any(n.startswith('op') and n[2].isdigit() for n in e.queries()); assert len(e.queries()) > 60"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
