"""Every registered query of the engine against its SQL."""

from __future__ import annotations

import subprocess
import sys

import pytest

from skein.plans import catalog
from tests import oracle

SLOW_IN_SQL: set[str] = set()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    out = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLE_SQL:
        assert oracle.rows(out) == oracle.sql_rows(sf_dir, catalog.ORACLE_SQL[name], out.columns)
    else:
        assert out.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_nothing_else_imports_the_training_package():
    code = "import skein.plans.catalog, skein.streaming.index, skein.sources.documents, sys; assert not any(m.startswith('skein.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True)
