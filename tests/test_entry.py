"""The entry without a session, and with parts missing or broken: each in a process of its own."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len([n for n in q if n.startswith('op')]), 'pipeline' in q, len(q))"


def counted(folder: Path) -> list[str]:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


def copied(to: Path) -> Path:
    shutil.copytree(ROOT / "heliotrope", to / "heliotrope", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, to / name)
    return to


def test_queries_need_no_session():
    ops, pipeline, n = counted(ROOT)
    there = (ROOT / "heliotrope" / "llm").is_dir()
    assert (ops, pipeline) == (("10", "True") if there else ("0", "False"))
    assert int(n) > 70


def test_absent_subpackage(tmp_path):
    folder = copied(tmp_path)
    shutil.rmtree(folder / "heliotrope" / "llm", ignore_errors=True)
    ops, pipeline, n = counted(folder)
    assert (ops, pipeline) == ("0", "False") and int(n) > 70


def test_broken_pipeline_hides_no_other_query(tmp_path):
    folder = copied(tmp_path)
    (folder / "corpus_pipeline.py").write_text("raise RuntimeError('broken')\n")
    ops, pipeline, n = counted(folder)
    assert pipeline == "False" and int(n) > 70
    assert ops == ("10" if (ROOT / "heliotrope" / "llm").is_dir() else "0")
