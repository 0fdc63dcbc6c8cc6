"""The registry, and that the library stands without its training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/wakeline", tmp_path / "wakeline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'build_tracks' in n and 'pipeline' not in n and set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(f"{ROOT}/wakeline"):
        if "/llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "wakeline.llm" not in open(f"{folder}/{n}").read(), n


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0 and set(e.oracle_sql()) <= set(e.queries())
