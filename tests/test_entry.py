import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

REPO = Path(__file__).resolve().parent.parent


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() == 200 and out.where("success").count() == 200


def test_sql_is_for_known_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_without_the_training_subpackage(tmp_path, gone):
    """The rest imports and keeps its queries when the subpackage is gone, with the pipeline's file or without it."""
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", *gone, "__pycache__", "spark-warehouse", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and not any(k.startswith('op') or k == 'pipeline' for k in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"}, timeout=120)
    assert out.returncode == 0, out.stderr


def test_a_broken_subpackage_is_an_error(tmp_path):
    """An import that fails inside the subpackage must not make its queries vanish in silence."""
    import shutil

    copy = tmp_path / "repo"
    if not (REPO / "lodeframe" / "llm").is_dir():
        pytest.skip("the subpackage is gone")
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", ".pytest_cache"))
    (copy / "lodeframe" / "llm" / "spans.py").unlink()
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"}, timeout=120)
    assert out.returncode and "lodeframe.llm.spans" in out.stderr
