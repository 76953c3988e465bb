"""The registered queries load whether or not the text part is there."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(*sorted(e.queries()), '|', *sorted(e.oracle_sql()))"


def loaded(folder):
    out = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    names, oracles = (part.split() for part in out.stdout.split("|"))
    return set(names), set(oracles)


def is_text(name):
    return name == "pipeline" or name.startswith("op")


@pytest.mark.parametrize("left_out", [["trackgrid/llm"], ["trackgrid/llm", "corpus_pipeline.py"]])
def test_entry_without_the_text_part(tmp_path, left_out):
    names, oracles = loaded(REPO)
    copy = tmp_path / "copy"
    skipped = {os.path.join(REPO, path) for path in left_out}
    shutil.copytree(REPO, copy, ignore=lambda folder, files: [f for f in files if os.path.join(folder, f) in skipped or f in (".git", "__pycache__")])
    rest, rest_oracles = loaded(copy)
    assert rest == {n for n in names if not is_text(n)} and len(rest) > 150
    assert rest_oracles == {n for n in oracles if not is_text(n)}
