import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_works_without_the_training_data_operators(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "verbatlas", tmp_path / "verbatlas", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "verbatlas/llm/__pycache__").mkdir(parents=True)  # what a deletion may leave
    code = "import __spark_entry__ as e; q = e.queries(); assert 'token_freq_topk' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_else_imports_them():
    for path in (ROOT / "verbatlas").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "verbatlas.llm" not in path.read_text(encoding="utf-8")


def test_entry(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["token", "freq"] and got.count() == 20
