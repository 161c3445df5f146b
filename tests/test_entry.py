import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_returns_slices(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and {"country", "match_bucket", "fold_id", "macro_f05"} <= set(rows[0].asDict())


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_works_without_the_llm_folders(tmp_path):
    shutil.copytree(os.path.join(ROOT, "kinspan"), tmp_path / "kinspan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert n and not [x for x in n if x.startswith('op') or x == 'pipeline']; print(len(n), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
