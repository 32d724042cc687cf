import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_the_entry_works_without_the_corpus_operators(tmp_path, left):
    left = [name for name in left if (REPO / name).exists()]
    for name in ("braidwin", "__spark_entry__.py", *left):
        source = REPO / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [k for k in e.queries() if k.startswith('op')])"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[0]) > 50 and "[]" in said.stdout


def test_nothing_else_imports_the_corpus_operators():
    for path in (REPO / "braidwin").rglob("*.py"):
        if "llm" not in path.relative_to(REPO / "braidwin").parts:
            assert "braidwin.llm" not in path.read_text(), path
