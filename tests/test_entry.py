"""The entry without the optional training-data operators, in a copy of the repository."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n.startswith('op')), len(e.queries()))"


@pytest.mark.parametrize("left", ["nothing", "empty folder", "broken import"])
def test_entry_without_the_training_operators(scratch, left):
    copy = os.path.join(scratch, "copy")
    ignore = shutil.ignore_patterns(".git", "tests", "__pycache__", *([] if left == "broken import" else ["llm"]))
    shutil.copytree(ROOT, copy, ignore=ignore)
    if left == "empty folder":
        os.makedirs(os.path.join(copy, "quarry", "llm", "__pycache__"))
    if left == "broken import":
        # A library that only the operators use is not installed.
        if not os.path.isdir(os.path.join(copy, "quarry", "llm")):
            pytest.skip("the operators are not there")
        with open(os.path.join(copy, "xxhash.py"), "w") as f:
            f.write("raise ModuleNotFoundError('no xxhash', name='xxhash')\n")
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    names, number = done.stdout.strip().rsplit(" ", 1)
    assert names == "[]" and int(number) > 60


def test_a_missing_module_of_the_rest_is_an_error(scratch):
    copy = os.path.join(scratch, "copy")
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__", "bm25.py"))
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0
