"""The training-data subpackage stands alone, and the entry works without it."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "loomspan").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "loomspan").parts:
            assert "loomspan.llm" not in path.read_text(), path


def test_entry_imports_without_the_subpackage(tmp_path):
    # with the pipeline left in place, and without it
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    for path in (ROOT / "loomspan").rglob("*.py"):
        inner = path.relative_to(ROOT)
        if "llm" not in inner.parts:
            (tmp_path / inner).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / inner).write_text(path.read_text())
    (tmp_path / "corpus_pipeline.py").write_text((ROOT / "corpus_pipeline.py").read_text())
    run(tmp_path)
    (tmp_path / "corpus_pipeline.py").unlink()
    run(tmp_path)


def run(tmp_path):
    code = "import __spark_entry__ as e; names = e.queries(); assert 'trace_events' in names and not any(n.startswith('op') for n in names); assert set(e.oracle_sql()) <= set(names)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
