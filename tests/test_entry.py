"""The entry without the llm folders: the driver may take them away, with or without the pipeline's file."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; print(*sorted(e.queries()), sep=chr(10)); print('--'); print(*sorted(e.oracle_sql()), sep=chr(10))"


@pytest.mark.parametrize("gone", [["galleyproof/llm", "tests/llm"], ["galleyproof/llm", "tests/llm", "corpus_pipeline.py"]])
def test_other_queries_stay(tmp_path, gone):
    for name in ("galleyproof", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in gone:
        if (tmp_path / name).is_dir():
            shutil.rmtree(tmp_path / name)
        else:
            (tmp_path / name).unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout
    queries, oracles = (part.split() for part in out.split("--"))
    assert len(queries) > 50 and set(oracles) <= set(queries)
    assert not [q for q in queries if q == "pipeline" or q.startswith("op") and q[2].isdigit()]
