"""Every query with SQL gives the SQL's rows on the smallest tables; the others run."""

import pytest

from lumengraph import registry
from tests.conftest import SF
from tests.oracle import same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    same(spark, QUERIES[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry_imports_without_the_training_data_part(tmp_path):
    import shutil
    import subprocess
    import sys

    from tests.conftest import ROOT

    shutil.copytree(ROOT / "lumengraph", tmp_path / "lumengraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'bm25_topk' in e.queries(); assert not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
