"""The entry points of copies that lack optional parts."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = """
import json
import __spark_entry__ as entry
names = list(entry.queries())
numbered = [n for n in names if n[:2] == "op" and n[2].isdigit()]
print(json.dumps([len(names), len(numbered), "pipeline" in names, sorted(set(entry.oracle_sql()) - set(names))]))
"""


@pytest.mark.parametrize("without,with_operators", [
    (["defectscope/llm", "tests/llm"], False), (["defectscope/llm", "tests/llm", "corpus_pipeline.py"], False), (["corpus_pipeline.py"], (ROOT / "defectscope/llm").is_dir())])
def test_entry_of_a_copy(tmp_path, without, with_operators):
    from checks import catalog

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__", ".pytest_cache") or str((Path(folder) / n).relative_to(ROOT)) in without])
    said = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, check=False)
    assert said.returncode == 0, said.stderr[-2000:]
    number, numbered, has_pipeline, unknown = json.loads(said.stdout.splitlines()[-1])
    assert unknown == [] and not has_pipeline
    assert number - numbered == len(catalog.QUERIES)
    assert (numbered > 0) == with_operators


def test_other_missing_modules_are_errors(tmp_path):
    """Only an optional part may be missing."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    (copy / "corpus_pipeline.py").write_text("import no_such_module\n")
    said = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, check=False)
    assert said.returncode and "no_such_module" in said.stderr
