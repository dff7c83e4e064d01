"""The entry points, with and without the optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def names(folder, *deleted):
    shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.txt"))
    for x in deleted:
        shutil.rmtree(folder / x) if (folder / x).is_dir() else (folder / x).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(*q)"
    return set(subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True).stdout.split())


def test_queries_without_the_optional_part(tmp_path):
    without = names(tmp_path / "a", "murmur/llm", "tests/llm")
    assert "dialogue_sentences" in without and "pipeline" not in without and not any(n.startswith("op") for n in without)
    assert names(tmp_path / "b", "murmur/llm", "tests/llm", "corpus_pipeline.py") == without


def test_all_queries_are_registered():
    found = set(__spark_entry__.queries())
    there = (ROOT / "murmur/llm/registry.py").exists()
    numbers = {n[: n.index("_") + 1] for n in found if n.startswith("op")}
    assert numbers == ({f"op{n}_" for n in range(1, 14)} if there else set())
    assert ("pipeline" in found) == (there and (ROOT / "corpus_pipeline.py").exists())
