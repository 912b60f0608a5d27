"""The driver contract with and without the optional folders."""
import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = ("import json, __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); "
       "print(json.dumps([sorted(q), sorted(set(o) - set(q))]))")


def asked(folder):
    import json
    out = subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, timeout=120, check=True)
    return json.loads(out.stdout.splitlines()[-1])


def copy(tmp_path, *left_out):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=lambda d, names: {
        n for n in names if n in {".git", "__pycache__", ".pytest_cache"} or os.path.relpath(os.path.join(d, n), ROOT) in left_out})
    return str(tmp_path / "repo")


def test_without_the_optional_folders(tmp_path):
    names, strays = asked(copy(tmp_path, "recollect/llm", "tests/llm", "corpus_pipeline.py"))
    assert "iron_log" in names and not [n for n in names if n.startswith("op") and n[2].isdigit()] and strays == []


def test_a_pipeline_without_its_package_is_left_out(tmp_path):
    names, strays = asked(copy(tmp_path, "recollect/llm"))
    assert "iron_log" in names and "pipeline" not in names and strays == []
