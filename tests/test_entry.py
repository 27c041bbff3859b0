"""The entry without the training-data operators, as on a machine that lacks them."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import warnings; warnings.simplefilter('error'); import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


def _count(folder, code=COUNT):
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()[-3:]


def test_core_queries_stand_alone(tmp_path):
    from squareframe.plans import catalog
    from squareframe.plans.registry import ORACLES

    core = len(catalog.all_queries())
    for keep_pipeline in (False, True):
        folder = str(tmp_path / str(keep_pipeline))
        shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if keep_pipeline else ["corpus_pipeline.py"])))
        assert _count(folder) == [str(core), str(len(ORACLES)), "False"]


def test_a_missing_library_takes_only_the_operators(tmp_path):
    """A library that only those operators need is absent: a warning, and the core queries stay."""
    from squareframe.plans import catalog

    code = "import sys; sys.modules['xxhash'] = None; " + COUNT.replace("simplefilter('error')", "simplefilter('ignore')")
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    n, _, pipeline = _count(str(tmp_path / "r"), code)
    assert (int(n), pipeline) == (len(catalog.all_queries()), "False")
