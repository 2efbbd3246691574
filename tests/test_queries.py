"""Every registered query against its SQL, and the entry module's contract."""

import pytest
from comparing import assert_equal

import __spark_entry__ as entry
from corpusloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert_equal(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_runs_without_the_subpackage():
    """The rest imports nothing of llm."""
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent
    for f in (root / "corpusloom").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"corpusloom\.llm|import llm", f.read_text()), f


def test_entry_in_a_copy_without_the_subpackage(tmp_path):
    """The entry module gives the other queries; a fault within the subpackage isn't hidden."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(entry.__file__).parent
    skip = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(root / "corpusloom", tmp_path / "corpusloom", ignore=skip)
    shutil.copy(entry.__file__, tmp_path)
    count = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op1_') for n in e.queries()))"
    run = lambda: subprocess.run([sys.executable, "-c", count], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert run().stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES)), "False"]
    (tmp_path / "corpus_pipeline.py").write_text("import a_library_that_is_missing\n")
    assert "a_library_that_is_missing" in run().stderr
