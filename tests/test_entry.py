import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_training_data_operators(tmp_path):
    """The library works the same when its optional subpackage, with or without the pipeline, is deleted."""
    shutil.copytree(ROOT / "quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e, bench; q = e.queries(); assert 'simple_paths' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    for pipeline in (False, True):
        if pipeline:
            (tmp_path / "corpus_pipeline.py").write_text("import quarry.llm.common\n")
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "quarry").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "quarry.llm" not in path.read_text(encoding="utf-8")
